"""Secret scans with a token-efficiency test.

Three base patterns find assignments, access keys and hexadecimal runs. Beside them, any run of 20 or more characters of
keys and encodings (letters, digits, + / _ = -) is tokenised with a tiktoken vocabulary: text that people write takes few
tokens for its characters, a random string takes many. What base spans leave of a run is reported as `random` if it yields
fewer than RATIO characters a token, unless it is a known kind of digest or identifier: hexadecimal of a digest's length, a
UUID, a decimal number, words joined by signs, or a date. Where it isn't reported, its parts between / _ = - are tested.

Defined results: a null text counts as empty and has no spans; the same text always gives the same spans; null ids are
kept; other columns are ignored; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.bpe import code_points
from tidegate.llm.common import chunks, slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
HINTS = ("passw", "secret", "token", "api")
RATIO, SHORTEST = 2.2, 20
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
_IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[-+/_=0-9]*")
_SIGNS = re.compile(r"[-+/_=]+")
_FIRST = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}")
_OTHER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PART = re.compile(r"[^/_=-]+")
_HEX = re.compile(r"(?:0x)?([0-9a-f]+|[0-9A-F]+)")
_BLOCK = 1 << 20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    hexa, key = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    hexa[[ord(c) for c in "0123456789abcdef"]] = True
    key[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = True
    return hexa, key


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(member.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist()))


def known(run: str) -> bool:
    """Digests and identifiers, which may look random without being secret."""
    digest = _HEX.fullmatch(run)
    return digest is not None and len(digest[1]) in DIGESTS or _IDENTIFIER.fullmatch(run) is not None


def joined_words(run: str) -> bool:
    """Words and numbers with signs between them; the first is a word. run: without signs at its ends."""
    first, *others = _SIGNS.split(run)
    return _FIRST.fullmatch(first) is not None and all(_OTHER.fullmatch(p) for p in others)


def random_run(run: str, codec) -> bool:
    bare = run.strip("=-_/+")
    if len(bare) < SHORTEST or known(bare):
        return False
    if _PART.fullmatch(bare) is None and joined_words(bare):
        return False  # its words are tested one by one
    return len(bare) / len(codec.encode_ordinary(bare)) < RATIO


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Stretches that spans cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def random_spans(text: str, runs: list[tuple[int, int]], base: list[tuple[str, int, int]], codec) -> list[tuple[str, int, int]]:
    """Spans of runs of key characters: of each piece that base spans leave of a run, the whole or else parts."""
    out, held, k = [], merged(base), 0
    for a, b in runs:
        while k < len(held) and held[k][1] <= a:
            k += 1
        if known(text[a:b].strip("=-_/+")):
            continue
        pieces, j = [], k
        while j < len(held) and held[j][0] < b:
            pieces.append((a, held[j][0]))
            a, j = held[j][1], j + 1
        for i, j in [*pieces, (a, b)]:
            if j - i < SHORTEST:
                continue
            if random_run(text[i:j], codec):
                out.append(("random", i, j))
            else:
                out += [("random", i + m.start(), i + m.end()) for m in _PART.finditer(text[i:j]) if m.end() - m.start() < j - i and random_run(m[0], codec)]
    return out


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    found = [("hex", a, b) for a, b in hexes]
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in HINTS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def scan(texts: list[str], codec) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    hexa, key = _tables()
    out = []
    for i, j in chunks(texts, _BLOCK):
        lengths = np.fromiter(map(len, texts[i:j]), np.int64, j - i) + 1
        starts = np.append(0, np.cumsum(lengths))
        points = code_points("\n".join(texts[i:j]))
        split: list[tuple[list, list]] = [([], []) for _ in range(j - i)]
        for which, member, least in ((0, hexa, 16), (1, key, SHORTEST)):
            found = runs(member[points], least)
            doc = np.searchsorted(starts, [a for a, _ in found], side="right") - 1
            for k, (a, b) in zip(doc.tolist(), found):
                split[k][which].append((a - int(starts[k]), b - int(starts[k])))
        for text, (hexes, others) in zip(texts[i:j], split):
            base = base_spans(text, hexes)
            more = random_spans(text, others, base, codec)
            out.append((base, sorted(base + more, key=lambda s: (s[1], ORDER[s[0]], s[2]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = scan([t or "" for t in b.column(1).to_pylist()], encoding(vocabulary, pattern))
            n = lambda kind, k: pa.array([sum(s[0] == kind for s in x[k]) for x in got], pa.int64())
            columns = {"doc_id": b.column(0), "n_assign": n("assign", 0), "n_access": n("access", 0), "n_hex": n("hex", 0), "base_sha256": pa.array([hashlib.sha256(joined(x[0]).encode()).hexdigest() for x in got], pa.string()), "spans": pa.array([joined(x[1]) for x in got], pa.string()), "n_random": n("random", 1)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
