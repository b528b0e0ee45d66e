"""Exact dedup by content sort.

Sampled splitters range-partition the rows on the first 32 characters of the normalised text and its digest; each partition
is sorted by the normalised text itself (Spark's sort spills to disk), so that equal texts are neighbours, and neighbours
are compared in full. Splitters never carry whole texts: what Spark samples for them is three times 100 rows for each
partition (a million at most), of some 100 bytes each. The row's length and id belong to the splitter's key, so a text that
a third of all rows hold is spread over as many partitions as its rows need. Such a text comes last in the splitter's order
in one partition and first in the next; runs of this kind are joined through one row for each end of a partition (two for
each partition, which is all that the driver ever sees).

Defined results: a null text counts as empty, and all empty texts are one group; a null id sorts first and can be kept;
of rows that repeat in every column one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import cut, fresh

HEAD = 32
_SCHEMA = "doc_id long, head_id long, n long, text_sha256 string, first boolean, pid int, edge string, size long"


def normalised(text: "F.Column") -> "F.Column":
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours, and then the runs that are first and last in the splitters' order, as rows with an edge.
    Holds the ids of one run and one text at a time."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    out: list[tuple] = []
    ids: list = []
    text, sha = None, None
    ends: dict[str, tuple] = {}

    def close() -> None:
        out.extend((i, ids[0], len(ids), sha, k == 0, pid, None, None) for k, i in enumerate(ids))
        key = text[:HEAD], sha
        row = (None, ids[0], len(ids), sha, None, pid)
        if "low" not in ends or key < ends["low"][0]:
            ends["low"] = key, row, len(text)
        if "high" not in ends or key > ends["high"][0]:
            ends["high"] = key, row, len(text)

    for b in batches:
        if not b.num_rows:
            continue
        new_ids, texts, digests = b.column("doc_id").to_pylist(), b.column("norm"), b.column("sha").to_pylist()
        begins = np.ones(b.num_rows, bool)
        begins[1:] = ~np.asarray(pc.equal(texts.slice(1), texts.slice(0, b.num_rows - 1)))
        begins[0] = text is None or texts[0].as_py() != text
        cuts = np.flatnonzero(begins).tolist()
        ids += new_ids[: cuts[0] if cuts else b.num_rows]
        for i, j in zip(cuts, [*cuts[1:], b.num_rows]):
            if text is not None:
                close()
            ids, text, sha = new_ids[i:j], texts[i].as_py(), digests[i]
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
    if text is not None:
        close()
        if ends["low"] == ends["high"]:
            ends = {"both": ends["low"]}
        out += [(*row, edge, size) for edge, (_, row, size) in ends.items()]
    if out:
        yield _batch(out)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every blank is deleted. The row with the most code points in its own text
    stays, then the one with the smallest id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    inside = [F.col("n").desc(), F.col("doc_id")]
    dealt = rows.repartitionByRange(F.substring("norm", 1, HEAD), F.unhex("sha"), *inside).sortWithinPartitions("norm", *inside)
    runs = cut(dealt.select("doc_id", "norm", "sha").mapInArrow(_runs, _SCHEMA))

    # Two rows for each partition at most.
    ends = runs.where("edge is not null").select("pid", "edge", "text_sha256", "size", "head_id", "n").collect()
    rank = {"low": 0, "both": 0, "high": 1}
    chains: list[list] = []
    for e in sorted(ends, key=lambda e: (e.pid, rank[e.edge])):
        last = chains[-1][-1] if chains else None
        if last is not None and (last.text_sha256, last.size) == (e.text_sha256, e.size) and last.pid < e.pid and last.edge != "low" and e.edge != "high":
            chains[-1].append(e)
        else:
            chains.append([e])
    fixes = [(e.pid, e.text_sha256, c[0].head_id, sum(x.n for x in c), k == 0) for c in chains if len(c) > 1 for k, e in enumerate(c)]
    found = runs.where("edge is null")
    if fixes:
        fix = docs.sparkSession.createDataFrame(fixes, "pid int, text_sha256 string, fix_id long, fix_n long, fix_first boolean")
        found = found.join(F.broadcast(fix), ["pid", "text_sha256"], "left")
    else:
        found = found.select("*", F.lit(None).cast("long").alias("fix_id"), F.lit(None).cast("long").alias("fix_n"), F.lit(None).cast("boolean").alias("fix_first"))
    joined = F.col("fix_n").isNotNull()
    return found.select(
        "doc_id",
        F.when(joined, F.col("fix_id")).otherwise(F.col("head_id")).alias("keep_id"),
        F.when(joined, F.col("fix_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("first") & F.coalesce("fix_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that content_sort keeps, with all their columns; of rows repeated in id and text, one."""
    own, kept_id, kept_sha, size, nth = (fresh(docs, n) for n in ("own", "kept_id", "kept_sha", "size", "nth"))
    kept = content_sort(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    rows = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256)).withColumn(size, F.length(F.coalesce(F.col(text_col), F.lit(""))))
    held = rows.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)), "left_semi")
    one = Window.partitionBy(id_col, own).orderBy(F.col(size).desc())
    return held.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*docs.columns)
