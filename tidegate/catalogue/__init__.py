"""All queries of the packet engine by name, with the SQL that checks them."""

from __future__ import annotations

from tidegate.catalogue import events, frames, graph, nodes, reports, text

QUERIES = {**frames.QUERIES, **text.QUERIES, **events.QUERIES, **reports.QUERIES, **graph.QUERIES, **nodes.QUERIES}
ORACLE_SQL = {**frames.ORACLE_SQL, **text.ORACLE_SQL, **events.ORACLE_SQL, **reports.ORACLE_SQL, **graph.ORACLE_SQL, **nodes.ORACLE_SQL}
