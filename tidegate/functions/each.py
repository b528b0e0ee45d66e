"""Python functions of single values as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Values of an Arrow batch that are Python objects at once; characters, bytes or samples of an array that leaves at once.
READ, VALUES = 64, 1 << 20


def parts(f: Callable, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out, size = [], 0
            for at in range(0, len(b), READ):
                for x in b.slice(at, READ).to_pylist():
                    out.append(None if x is None else f(x))
                    size += 0 if out[-1] is None else len(out[-1])
                    if size > VALUES:
                        yield pa.array(out, kind)
                        out, size = [], 0
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def each(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """f of each value of a column, nulls aside; an array of samples is best given as one of NumPy. A worker holds a few
    values of a batch as Python objects, and what it makes of them leaves in parts, however large the batch is."""

    def column(c: Column | str) -> Column:
        from pyspark.sql.pandas.types import to_arrow_type

        run = parts(f, to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType))
        # Else a condition on what f makes would be moved before it and run f once more.
        return F.arrow_udf(run, kind).asNondeterministic()(c)

    return column
