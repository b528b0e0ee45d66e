"""Text packets: previews, redaction, clean-up before speech, and type patterns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that each clean-up keeps, as regular-expression classes.
KEPT = {
    "wide": "A-Za-z0-9 .,!?\\-'\"\\n:;¡¿À-Ÿ",
    "cjk": "A-Za-z0-9 .,!?\\-'\"\\n:;À-Ÿ一-鿿。，！？、；：（）",
    "ascii": "A-Za-z0-9 .,!?\\-'\"\\n:;",
}
# How a sentence may end after each clean-up.
ENDS = {"wide": ".!?", "cjk": ".!?。！？", "ascii": ".!?"}


def preview(text: Column, size: int) -> Column:
    """The first characters, and dots if there are more."""
    if size == 0:
        return F.lit("")
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def redact(text: Column, size: int, suffix: str = "...[truncated]") -> Column:
    """Tests bytes but keeps characters, so a short text of long characters gains the suffix and loses nothing."""
    return F.when(F.octet_length(text) > size, F.concat(F.substring(text, 1, size), F.lit(suffix))).otherwise(text)


def redact_json(size: int, suffix: str = "...[truncated]"):
    """A pandas UDF that redacts every string of a JSON document, at any depth."""
    def walk(v):
        if isinstance(v, str):
            return v[:size] + suffix if len(v.encode()) > size else v
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    def one(s):
        return None if s is None else json.dumps(walk(json.loads(s)), ensure_ascii=False, separators=(",", ":"))

    def redacted(s: pd.Series) -> pd.Series:
        return s.map(one)

    redacted.__annotations__ = {"s": pd.Series, "return": pd.Series}
    redacted = F.pandas_udf(redacted, T.StringType())

    return redacted


def sanitize(text: Column, kind: str = "wide") -> Column:
    """Keeps allowed characters, collapses blanks, and ends with a full stop unless there is an end already."""
    kept = F.regexp_replace(text, f"[^{KEPT[kind]}]+", "")
    flat = F.trim(F.regexp_replace(kept, "\\s+", " "))
    # The text is named once: an expression that several branches name would be worked out for each.
    return F.transform(F.array(flat), lambda t: F.when(F.substring(t, -1, 1).isin(list(ENDS[kind])) | (t == ""), t).otherwise(F.concat(t, F.lit("."))))[0]


def cleaner(kind: str = "wide") -> Callable[[str], str]:
    """sanitize for texts in Python. Of blanks, only spaces and line feeds are allowed characters."""
    dropped, blanks, ends = re.compile(f"[^{KEPT[kind]}]+"), re.compile(" {2,}"), tuple(ENDS[kind])

    def clean(text: str) -> str:
        flat = blanks.sub(" ", dropped.sub("", text).replace("\n", " ")).strip(" ")
        return flat + "." if flat and not flat.endswith(ends) else flat

    return clean


def glob_any(kind: Column, patterns: list[str]) -> Column:
    """`x.*` and `x*` match what begins with x (the first drops two characters, so it matches `xfoo` too); else equality.

    No pattern: everything matches."""
    tests = [kind.startswith(p[:-2]) if p.endswith(".*") else kind.startswith(p[:-1]) if p.endswith("*") else kind == p for p in patterns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def kind_in(kind: Column, kinds: list[str]) -> Column:
    return F.lower(kind).isin([k.lower() for k in kinds])


def stripped(text: Column) -> Column:
    """Without White_Space at both ends (F.trim takes plain blanks alone)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def blank(text: Column) -> Column:
    """Empty, or White_Space alone: such a text isn't translated."""
    return ~text.rlike("(?U)\\S")


def translated(text: Column) -> Column:
    """What is kept of a translator's output: its unknown-token marks go."""
    return stripped(F.replace(text, F.lit("<unk>"), F.lit("")))


def check_languages(source: str, target: str, max_length: int, known: tuple[str, ...] = ("en", "es")) -> None:
    """A translator of two languages takes these, and not the same one twice; its output has 32 to 2048 tokens at most."""
    for name, value in (("source_language", source), ("target_language", target)):
        if value not in known:
            raise ValueError(f"{name} '{value}' is none of {', '.join(known)}")
    if source == target:
        raise ValueError(f"source_language and target_language are both '{source}'")
    if not 32 <= max_length <= 2048:
        raise ValueError(f"max_length {max_length} is not within 32 .. 2048")


def language_tag(text: Column, language: Column) -> Column:
    """The language of a transcription: the configured one, or, if that is `auto`, what the model wrote as <|tag|>."""
    return F.when(language == "auto", F.nullif(F.regexp_extract(text, "<\\|([^|]*)\\|>", 1), F.lit(""))).otherwise(language)


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<\\|[^|]*\\|>", ""))
