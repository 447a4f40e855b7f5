"""Splitting oversized items at natural boundaries, by agglomerative merging.

The atoms of a text are its lines; a line over the limit falls into sentences, words and at last fixed cuts. Between
neighbouring atoms lies a boundary of some strength. The pairs wait in a heap, weakest boundary first, and are merged
while the result fits, so that what remains are the strongest boundaries that the limit allows. A result fits if it
leaves room for the overlap with the piece before; only a line or a stretch of lines that is whole within the limit
stays whole, and its piece then repeats less. What kind of boundary a text had to be cut at is read off the boundaries
that remain.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of the boundary between two atoms.
CUT, WORD, SENTENCE, LINE, BEFORE_BLANK, BLANK = 0, 1, 2, 3, 4, 5
#: What a text was cut at, by the weakest boundary that remains.
KINDS = {CUT: "inside", WORD: "inside", SENTENCE: "inside", LINE: "line", BEFORE_BLANK: "blank", BLANK: "blank"}

_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t]+|(?<=[。！？；])")
_WORD = re.compile(r"[ \t,]+")
_BLANK_CHARS = " \t\r\n"


def _hard(text: str, start: int, end: int, limit: int) -> Iterator[int]:
    """Cuts of a stretch without any space, not before a combining mark or within a line end."""
    at = start
    while end - at > limit:
        cut = at + limit
        for back in range(min(32, limit - 1)):
            c = text[cut - back]
            if not unicodedata.combining(c) and c not in "‍️\n" and text[cut - back - 1] != "‍":
                cut -= back
                break
        yield cut
        at = cut


def _inside(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """(position, strength) of the boundaries within one line over the limit, so that no atom exceeds ``limit``."""
    found: list[tuple[int, int]] = []
    for m in _SENTENCE.finditer(text, start, end):
        if start < m.end() < end:
            found.append((m.end(), SENTENCE))
    edges = [start, *(p for p, _ in found), end]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a <= limit:
            continue
        words = [m.end() for m in _WORD.finditer(text, a, b) if a < m.end() < b]
        found += [(p, WORD) for p in words]
        inner = [a, *words, b]
        for x, y in zip(inner, inner[1:], strict=False):
            found += [(p, CUT) for p in _hard(text, x, y, limit)]
    return sorted(found)


@dataclass(frozen=True)
class Piece:
    """``text[start:end]``, of which ``text[start:core]`` repeats the piece before; ``closes`` is the strength of the boundary at its end, null at the text's end."""

    start: int
    core: int
    end: int
    closes: int | None


def _atoms(text: str, limit: int, overlap: int) -> tuple[list[int], list[int], list[bool]]:
    """Ends of the atoms, strength of the boundary after each but the last, and whether what lies around that boundary is whole within the limit."""
    ends: list[int] = []
    strength: list[int] = []
    whole: list[bool] = []
    stretch = 0  # number of the first atom of the open stretch
    size = 0

    def close() -> None:
        # boundaries within the stretch: its lines may be joined without room for the overlap if all of them fit
        if size <= limit:
            for i in range(stretch, len(ends) - 1):
                whole[i] = whole[i] or strength[i] == LINE

    was_blank = None
    for m in _LINE.finditer(text):
        a, b = m.span()
        blank = text[a:b].strip(_BLANK_CHARS) == ""
        if ends:
            if blank and not was_blank:
                close()
            strength.append(BLANK if was_blank and not blank else BEFORE_BLANK if blank else LINE)
            whole.append(blank)
        if not blank and was_blank in (True, None):
            stretch, size = len(ends), 0
        size += 0 if blank else b - a
        if b - a > limit:
            for p, s in _inside(text, a, b, max(limit - overlap, limit // 2, 1)):
                ends.append(p)
                strength.append(BEFORE_BLANK if blank else s)
                whole.append(blank)
        ends.append(b)
        was_blank = blank
    if was_blank is False:
        close()
    return ends, strength, whole


def _overlap_start(text: str, core: int, room: int) -> int:
    """Where the repetition of at most ``room`` characters before ``core`` begins: at a line, else at a word."""
    if room <= 0:
        return core
    first = core - room
    window = text[first:core]
    if first == 0 or text[first - 1] == "\n":
        return first
    if "\n" in window[:-1]:
        return first + window.find("\n") + 1
    space = re.search(r"[ \t]", window[:-1])
    if space:
        return first + space.end()
    while first < core and (unicodedata.combining(text[first]) or text[first] in "‍️"):
        first += 1
    return first


def split_text(text: str, limit: int = 1200, overlap: int = 200) -> list[Piece]:
    """The pieces of a text, in order.

    ``text[core:end]`` of all pieces together is the text; ``text[start:core]``, at most ``overlap`` characters,
    repeats the end of the piece before, from a line's or at least a word's beginning on where there is one.
    No piece is longer than ``limit``. Empty text has no piece.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [Piece(0, 0, len(text), None)]
    ends, strength, whole = _atoms(text, limit, overlap)
    starts = [0, *ends[:-1]]
    n = len(ends)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and right[i] == j and ends[j] - starts[i] == size):
            continue
        if size + (0 if i == 0 or whole[j - 1] else overlap) > limit:
            continue
        ends[i], right[i], alive[j] = ends[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[right[i] - 1], ends[right[i]] - starts[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[i - 1], ends[i] - starts[left[i]], left[i], i))
    pieces = []
    before = 0
    for i in range(n):
        if alive[i]:
            core, end = starts[i], ends[i]
            start = _overlap_start(text, core, min(overlap, limit - (end - core), core - before))
            pieces.append(Piece(start, core, end, strength[right[i] - 1] if end < len(text) else None))
            before = core
    return pieces


def boundary_kind(pieces: list[Piece]) -> str | None:
    """``blank`` if a text was cut at blank lines only, ``line`` if some cut parts two lines, ``inside`` if one parts a line.

    As weaker boundaries are merged first, and a stretch of lines between blank lines or a line that is within the
    limit is never parted, that is: ``blank`` if no stretch exceeds the limit, else ``line`` if no line does, else ``inside``.
    """
    return KINDS[min(p.closes for p in pieces[:-1])] if len(pieces) > 1 else None


_SCHEMA = (
    "chunk_id long, ordinal int, symbol string, start_line long, end_line long, "
    "piece string, n_overlap int, boundary string"
)


def _split_frames(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for chunk, symbol, first, text in zip(frame["chunk_id"], frame["symbol"], frame["start_line"], frame["content"], strict=True):
                pieces = split_text(text, limit, overlap)
                kind = boundary_kind(pieces)
                breaks = np.array([m.start() for m in re.finditer("\n", text)])
                known = first is not None and first == first and first > 0
                for ordinal, p in enumerate(pieces):
                    a = int(first + np.searchsorted(breaks, p.start)) if known else 0
                    b = int(first + np.searchsorted(breaks, p.end - 1)) if known else 0
                    out.append((chunk, ordinal, symbol, a, b, text[p.start : p.end], p.core - p.start, kind))
            yield pd.DataFrame(out, columns=["chunk_id", "ordinal", "symbol", "start_line", "end_line", "piece", "n_overlap", "boundary"])

    return run


def split_oversized(chunks: DataFrame, limit: int = 1200, overlap: int = 200, keep_small: bool = False) -> DataFrame:
    """Pieces of the chunks whose content exceeds ``limit`` characters (code points).

    Columns: chunk_id, ordinal (from 0), symbol, start_line, end_line, piece, n_overlap (characters that the piece
    shares with the one before), boundary (see :func:`boundary_kind`). ``keep_small`` adds the other chunks as one
    piece each, boundary null, without a detour through Python.

    Defined cases: repeated rows of an id count once; null and empty content has no piece; a null symbol stays null;
    start_line null or not positive means unknown and gives 0 for both lines. end_line is that of the piece's last
    character and never of the chunk, so an end_line in the input isn't read. Extra columns are never read.
    """
    rows = chunks.select(
        F.col("id").alias("chunk_id"), "symbol", F.col("start_line").cast("double").alias("start_line"), "content"
    ).filter("content IS NOT NULL AND content <> '' AND chunk_id IS NOT NULL")
    large = rows.filter(F.char_length("content") > limit)
    one = large.groupBy("chunk_id").agg(F.max(F.struct("content", "symbol", "start_line")).alias("r")).select("chunk_id", "r.*")
    pieces = one.select("chunk_id", "symbol", "start_line", "content").mapInPandas(_split_frames(limit, overlap), _SCHEMA)
    if not keep_small:
        return pieces
    small = rows.filter(F.char_length("content") <= limit)
    known = F.col("start_line") > 0
    lines = F.char_length("content") - F.char_length(F.regexp_replace(F.expr("substring(content, 1, char_length(content) - 1)"), "\n", "")) - 1
    whole = small.dropDuplicates(["chunk_id"]).select(
        "chunk_id",
        F.lit(0).alias("ordinal"),
        "symbol",
        F.when(known, F.col("start_line")).otherwise(0).cast("long").alias("start_line"),
        F.when(known, F.col("start_line") + lines).otherwise(0).cast("long").alias("end_line"),
        F.col("content").alias("piece"),
        F.lit(0).alias("n_overlap"),
        F.lit(None).cast("string").alias("boundary"),
    )
    return pieces.unionByName(whole)
