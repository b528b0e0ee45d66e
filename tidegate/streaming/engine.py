"""Sessions: pipelines that run as Structured Streaming queries until they are stopped."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegate.plans.compiler import Connection, Node, Pipeline, build
from tidegate.plans.registry import Registry

#: Triggers of the three profiles, from low latency to high throughput.
PROFILES = {"low_latency": "100 milliseconds", "balanced": "1 second", "high_throughput": "10 seconds"}


@dataclass
class Session:
    name: str
    pipeline: Pipeline
    inputs: dict[str, DataFrame]
    checkpoint: str
    profile: str = "balanced"
    sink: str = "memory"
    mode: str = "append"
    queries: dict[str, StreamingQuery] = field(default_factory=dict)
    #: Of each output, how often what it reads from has changed; a checkpoint belongs to one such state.
    edition: dict[str, int] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()

    def drain(self) -> None:
        for q in self.queries.values():
            q.processAllAvailable()

    def stats(self) -> dict[str, dict]:
        return {n: {"state": "Running" if q.isActive else "Failed" if q.exception() else "Stopped", "batches": len(q.recentProgress), "rows": sum(p["numInputRows"] for p in q.recentProgress)} for n, q in self.queries.items()}

    def events(self) -> list[dict]:
        """State and counters of each output as events for clients."""
        return [{"event": kind, "session": self.name, "node": n, **body} for n, s in self.stats().items() for kind, body in (("node_state_changed", {"state": s["state"]}), ("node_stats_updated", {"batches": s["batches"], "rows": s["rows"]}))]


def _upstream(pipeline: Pipeline, name: str) -> tuple:
    """What an output reads from: kinds and connections, without parameters that a running node may change."""
    seen, todo = set(), [name]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [c.source for c in pipeline.connections if c.target == n]
    return tuple(sorted((n, pipeline.nodes[n].kind) for n in seen)), tuple(sorted((c.source, c.output, c.target, c.pin) for c in pipeline.connections if c.target in seen))


class Sessions:
    """Running sessions by name. A session's graph and parameters can be changed while it runs: its queries stop after their
    batch, and go on from their checkpoints with the new plan; an output that reads from other nodes than before, or that is
    kept in memory, begins anew. Rows of other sinks are below the checkpoint folder."""

    def __init__(self, registry: Registry) -> None:
        self.registry = registry
        self.running: dict[str, Session] = {}

    def start(self, pipeline: Pipeline, inputs: dict[str, DataFrame], checkpoint: str, profile: str = "balanced", sink: str = "memory", mode: str = "append") -> Session:
        name = pipeline.name or f"session_{uuid.uuid4().hex[:8]}"
        if name in self.running:
            raise ValueError(f"session {name} runs already")
        session = Session(name, pipeline, inputs, checkpoint, profile, sink, mode)
        self._run(session)
        self.running[name] = session
        return session

    def _run(self, session: Session, only: str | None = None) -> None:
        for node, df in build(session.pipeline, self.registry, session.inputs).items():
            if only not in (None, node):
                continue
            table = f"{session.name}_{node.replace('.', '_')}"
            if session.sink == "memory":  # can't go on from a checkpoint
                session.edition[node] = session.edition.get(node, -1) + 1
            at = f"{session.checkpoint}/{table}-{session.edition.get(node, 0)}"
            writer = df.writeStream.format(session.sink).queryName(table).outputMode(session.mode).option("checkpointLocation", at)
            if session.sink not in ("memory", "console", "noop"):
                writer = writer.option("path", f"{at}-rows")
            session.queries[node] = writer.trigger(processingTime=PROFILES[session.profile]).start()

    def _change(self, name: str, pipeline: Pipeline) -> None:
        session = self.running[name]
        build(pipeline, self.registry, session.inputs)  # what doesn't compile changes nothing
        session.stop()
        old, session.queries = session.queries, {}
        for node in build(pipeline, self.registry, session.inputs):
            own = node.split(".")[0]
            if node in old and _upstream(session.pipeline, own) != _upstream(pipeline, own):
                session.edition[node] = session.edition.get(node, 0) + 1
        session.pipeline = pipeline
        self._run(session)

    def tune(self, name: str, node: str, **params) -> None:
        """New parameters of a running node, beside those that stay."""
        p = self.running[name].pipeline
        self._change(name, replace(p, nodes={**p.nodes, node: replace(p.nodes[node], params={**p.nodes[node].params, **params})}))

    def add(self, name: str, node: str, kind: str, params: dict | None = None, needs: list[str] | None = None, source: DataFrame | None = None) -> None:
        """A new node, that reads from others or from a table of its own."""
        session = self.running[name]
        if node in session.pipeline.nodes:
            raise ValueError(f"node {node} exists")
        if source is not None:
            session.inputs = {**session.inputs, node: source}
        links = [Connection(s, "out", node, f"in_{i}" if len(needs) > 1 else "in") for i, s in enumerate(needs or [])]
        self._change(name, replace(session.pipeline, nodes={**session.pipeline.nodes, node: Node(node, kind, params or {})}, connections=[*session.pipeline.connections, *links]))

    def remove(self, name: str, node: str) -> None:
        """Without a node and its connections; what read from it alone goes too."""
        p = self.running[name].pipeline
        gone = {node}
        while more := {n for n in p.nodes if n not in gone and (fed := [c.source for c in p.connections if c.target == n]) and set(fed) <= gone}:
            gone |= more
        self._change(name, replace(p, nodes={n: x for n, x in p.nodes.items() if n not in gone}, connections=[c for c in p.connections if not {c.source, c.target} & gone]))

    def connect(self, name: str, source: str, target: str, pin: str = "in", output: str = "out") -> None:
        p = self.running[name].pipeline
        self._change(name, replace(p, connections=[*p.connections, Connection(source, output, target, pin)]))

    def disconnect(self, name: str, source: str, target: str) -> None:
        """Without the connections between two nodes; a node that then reads nothing goes."""
        p = self.running[name].pipeline
        left = [c for c in p.connections if (c.source, c.target) != (source, target)]
        self._change(name, replace(p, connections=left)) if any(c.target == target for c in left) else self.remove(name, target)

    def recover(self, name: str, wait: float = 1.0) -> list[str]:
        """Starts failed queries again from their checkpoints, after a fixed wait; the outputs that were."""
        session = self.running[name]
        failed = [n for n, s in session.stats().items() if s["state"] == "Failed"]
        if failed:
            time.sleep(wait)
        for node in failed:
            session.failures[node] = session.failures.get(node, 0) + 1
            self._run(session, node)
        return failed

    def stop(self, name: str, grace: bool = False) -> None:
        """grace: what has arrived is worked off first."""
        session = self.running.pop(name)
        if grace:
            session.drain()
        session.stop()


def run_batch(text: str, registry: Registry, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Compiles a YAML pipeline and returns the DataFrame of each of its ends."""
    from tidegate.plans.compiler import load

    return build(load(text, registry), registry, inputs)
