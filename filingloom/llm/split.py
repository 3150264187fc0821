"""Splitting oversized texts at natural boundaries (problem 1).

Method: balanced targets. The least number of pieces that can hold the text is computed, cuts are placed
so that all pieces are equally long, each cut is snapped to the strongest boundary near its target (section
before paragraph before sentence before line, then the nearest), and when a piece would break the limit the
count of pieces is raised by one and the cuts are placed again.

A text is handled on its own, in one Arrow batch: no shuffle. Texts that can't be too long by their number
of characters are never sent to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, LINE, SENTENCE, PARAGRAPH, SECTION = range(5)
KINDS = ("word", "line", "sentence", "paragraph", "section")

# The code points with the Unicode property White_Space, and those of them that end a line.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_ENDS = "".join(map(chr, [10, 13, 0x85, 0x2028, 0x2029]))
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_HEADING = re.compile(r"#{1,6}\s|(?:part|item)\s+[0-9ivx]+[a-z]?\b", re.I)
_BLANK_LINE = re.compile(f"(?:\r\n|[{LINE_ENDS}])[^\\S\n\r]*(?:\r\n|[{LINE_ENDS}])|{chr(0x2029)}")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")


def boundary(text: str, end: int, start: int) -> int:
    """Strength of the gap ``text[end:start]`` between two words."""
    gap = text[end:start]
    broken = any(c in gap for c in LINE_ENDS)
    if broken and _HEADING.match(text, start):
        return SECTION
    if broken and _BLANK_LINE.search(gap):
        return PARAGRAPH
    if _SENTENCE_END.search(text, max(0, end - 6), end):
        return SENTENCE
    return LINE if broken else PLAIN


def place(strength, n: int, limit: int, overlap: int, reach: float) -> list[tuple[int, int]]:
    """Word ranges of the pieces of a text of ``n`` words; ``strength(i)`` is that of the gap before word ``i``."""
    if n <= limit:
        return [(0, n)]
    count = 1 + -(-(n - limit) // (limit - overlap))
    while True:
        length = (n + overlap * (count - 1)) / count  # of each piece, its overlap included
        near = max(1, int(reach * length))
        begin, last, pieces = 0, 0, []
        for i in range(1, count):
            target = round(i * (length - overlap) + overlap)
            # new words in every piece, a whole overlap for the next one, no piece over the limit
            low = max(last + 1, target - near, overlap + 1)
            high = min(begin + limit, target + near, n - 1)
            if low > high:
                break
            cut = max(range(low, high + 1), key=lambda c: (strength(c), -abs(c - target), -c))
            pieces.append((begin, cut))
            begin, last = max(0, cut - overlap), cut
        else:
            if n - begin <= limit:
                return [*pieces, (begin, n)]
        count += 1


def split_text(text: str, limit: int = 1000, overlap: int = 50, reach: float = 0.15) -> list[tuple[int, int, int, int, str]]:
    """``(start, end, words, overlap words, kind of boundary at the end)`` of the pieces; positions are code points.

    The first piece starts at 0 and the last ends with the text; a piece ends where the next word starts, so
    the pieces without their overlaps, put together, are the text.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n, 0, "end")]
    known: dict[int, int] = {}

    def strength(i: int) -> int:
        if i not in known:
            known[i] = boundary(text, spans[i - 1][1], spans[i][0])
        return known[i]

    pieces, done = [], 0
    for a, b in place(strength, n, limit, overlap, reach):
        pieces.append((spans[a][0] if a else 0, spans[b][0] if b < n else len(text), b - a, done - a if a else 0, KINDS[strength(b)] if b < n else "end"))
        done = b
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 50, with_text: bool = True, reach: float = 0.15) -> DataFrame:
    """``(key, piece, pieces, start, end, words, overlap, boundary[, text])``: the pieces of every text of more than ``limit`` words.

    ``piece`` counts from 0; each piece after the first begins with the last ``overlap`` words of the one
    before. Texts within the limit, empty, blank and null ones aren't oversized and give no rows; one word is
    never cut, however long. Of equally strong boundaries the one nearest the target is taken, of two as near
    the earlier. A null key stays null; each input row is split on its own, so repeated rows give repeated
    pieces; an empty table gives an empty one; other columns are ignored. ``overlap`` must be below ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = df.schema[key].dataType.simpleString()
    columns = ["k", "piece", "pieces", "start", "end", "words", "overlap", "boundary"] + ["text"] * with_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["k"], frame["t"]):
                pieces = split_text(t, limit, overlap, reach)
                if len(pieces) > 1:
                    rows += [(k, i, len(pieces), a, b, w, o, s, *([t[a:b]] if with_text else [])) for i, (a, b, w, o, s) in enumerate(pieces)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"k": frame["k"].dtype}) if not rows or out["k"].dtype != frame["k"].dtype else out

    schema = f"k {kind}, piece int, pieces int, start int, end int, words int, overlap int, boundary string" + ", text string" * with_text
    # more than limit words need more than 2 * limit characters
    long = df.select(df[key].alias("k"), df[text].alias("t")).where(F.length("t") > 2 * limit)
    return long.mapInPandas(run, schema).withColumnRenamed("k", key)
