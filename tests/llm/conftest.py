from __future__ import annotations

import pytest

#: Rows that every operator must bear: nulls, empties, repeats, a clashing extra column.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, start long, rank string"


@pytest.fixture
def frame(spark):
    def make(texts, first=0, lang="en", parts=3):
        rows = [(first + i, t, lang, f"src{i % 3}", None if t is None else len(t), 7, -1, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
