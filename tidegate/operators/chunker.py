"""Text chunking for streams of packets: by sentences, clauses or words.

A buffer gathers a stream's texts. The boundaries are tried in their order, and the first occurrence of the first one found
cuts; what a stream leaves in the buffer at its end is emitted as it is."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidegate.operators.ordering import fold

# Boundaries in the order in which they are tried, and what may end a buffer.
SENTENCES = [". ", ".\n", "! ", "!\n", "? ", "?\n", "。", "！", "？"]
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")
CLAUSES = [*SENTENCES, ", ", ",\n", "; ", ";\n", " - ", " – ", " — ", ": ", ":\n"]
CLAUSE_ENDS = (*SENTENCE_ENDS, ",", ";", ":")


class Chunker:
    def __init__(self, mode: str = "sentences", min_length: int = 10, words: int = 5) -> None:
        if mode not in ("sentences", "clauses", "words"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.min_length, self.words = mode, min_length, words
        self.boundaries, self.ends = (CLAUSES, CLAUSE_ENDS) if mode == "clauses" else (SENTENCES, SENTENCE_ENDS)
        #: N blanks, none of them the buffer's first character.
        self.nth_blank = re.compile(r"(?s:.)(?:\S*\s){%d}" % words)
        self.blanks = re.compile(r"\s*")

    def feed(self, buffer: str, text: str) -> tuple[str, list[str]]:
        """The new buffer, and the chunks that the text completes."""
        if not text:
            return buffer, []
        return (self._words if self.mode == "words" else self._marks)(buffer + text)

    def _marks(self, buffer: str) -> tuple[str, list[str]]:
        out, at, mark = [], 0, 0
        left = len(buffer.encode())
        while left >= self.min_length:
            # A boundary that the rest lacks stays absent, so the search never goes back in the list.
            while mark < len(self.boundaries) and (found := buffer.find(self.boundaries[mark], at)) < 0:
                mark += 1
            if mark == len(self.boundaries):
                if buffer.endswith(self.ends):
                    return "", [*out, buffer[at:]]
                break
            end = found + len(self.boundaries[mark])
            left -= len(buffer[at:end].encode())
            out.append(buffer[at:end].strip())
            at = end
        return buffer[at:], out

    def _words(self, buffer: str) -> tuple[str, list[str]]:
        out, at = [], 0
        left = len(buffer.split())
        while left >= self.words:
            found = self.nth_blank.match(buffer, at)
            if found:
                out.append(found[0].strip())
                left -= len(found[0].split())
                at = self.blanks.match(buffer, found.end()).end()
                continue
            if len(re.findall(r"\s", buffer[at + 1 :])) == self.words - 1 and at < len(buffer):
                out.append(buffer[at:])
                at = len(buffer)
            break
        return buffer[at:], out


def chunks(df: DataFrame, stream: str, order: list[str], text: str, mode: str = "sentences", min_length: int = 10, words: int = 5, flush: bool = True, clean: Callable[[str], str] | None = None, made: Callable[[str], object] | None = None, made_kind: str = "string") -> DataFrame:
    """stream, chunk_no (from 1), chunk. flush: what a stream leaves in the buffer is its last chunk. clean: what becomes of a
    text before it is added; made: what becomes of a chunk, a value of made_kind. Both run where texts are cut, so texts
    travel once."""
    chunker = Chunker(mode, min_length, words)
    clean, made = clean or (lambda t: t), made or (lambda c: c)

    def step(state, row):
        key, buffer, n = state or (None, "", 0)
        if row is None:
            return None, [(key, n + 1, made(buffer))] if buffer and flush else []
        buffer, cut = chunker.feed(buffer, clean(row[text] or ""))
        # One by one: what is made of all chunks of a long text needn't be held.
        return (row[stream], buffer, n + len(cut)), ((row[stream], n + k + 1, made(c)) for k, c in enumerate(cut))

    kind = dict(df.dtypes)[stream]
    rows = df.select(*dict.fromkeys([stream, *order, text]))
    return fold(rows, [stream], order, step, f"{stream} {kind}, chunk_no long, chunk {made_kind}")
