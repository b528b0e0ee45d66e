"""Node kinds: their pins, their parameters, and the function that turns input DataFrames into output DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase, translate
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.plans.types import Pins

Apply = Callable[[dict[str, DataFrame], dict], dict[str, DataFrame]]


@dataclass
class NodeKind:
    kind: str
    apply: Apply
    pins: Callable[[dict], Pins]
    params: dict[str, object] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    #: Loops through such a node are allowed.
    bidirectional: bool = False

    def config(self, params: dict | None) -> dict:
        """Defaults, overridden; unknown or missing required parameters are errors."""
        given = dict(params or {})
        unknown = set(given) - set(self.params) - set(self.required) - {"num_inputs"}
        if unknown:
            raise ValueError(f"{self.kind}: unknown parameters {sorted(unknown)}")
        missing = [k for k in self.required if k not in given]
        if missing:
            raise ValueError(f"{self.kind}: missing parameters {missing}")
        return {**self.params, **given}


class Registry:
    def __init__(self) -> None:
        self.kinds: dict[str, NodeKind] = {}

    def node(self, kind: str, pins, params: dict | None = None, required: tuple[str, ...] = (), categories: tuple[str, ...] = (), bidirectional: bool = False):
        """Decorator that registers a function (inputs, config) -> outputs."""

        def add(apply: Apply) -> Apply:
            self.kinds[kind] = NodeKind(kind, apply, pins if callable(pins) else lambda _: pins, params or {}, required, categories, bidirectional)
            return apply

        return add

    def unregister(self, kind: str) -> None:
        self.kinds.pop(kind, None)

    def get(self, kind: str) -> NodeKind:
        if kind not in self.kinds:
            raise ValueError(f"unknown node kind {kind}")
        return self.kinds[kind]

    def definitions(self) -> list[dict]:
        """What clients need to draw or check a pipeline."""
        out = []
        for k in sorted(self.kinds.values(), key=lambda k: k.kind):
            pins = k.pins(k.params)
            out.append({"kind": k.kind, "params": k.params, "required": list(k.required), "inputs": [(p.name, [t.kind for t in p.accepts], p.cardinality) for p in pins.inputs], "outputs": [(p.name, p.produces.kind) for p in pins.outputs], "categories": list(k.categories), "bidirectional": k.bidirectional})
        return out


def allowed(kind: str, patterns: list[str]) -> bool:
    """Shell patterns; an empty list denies all."""
    return any(fnmatchcase(kind, p) for p in patterns)


def allowed_column(kind: Column, patterns: list[str]) -> Column:
    """The same for a column of kinds."""
    tests = [kind.rlike(f"^(?:{translate(p).removesuffix('\\Z').removesuffix('\\z')})$") for p in patterns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
