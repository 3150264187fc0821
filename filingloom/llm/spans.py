"""Long exact spans shared between records (problem 4).

Method. Sliding sentence spans (hash every run of consecutive sentences, join globally, cover) can't give the
required result on its own: a shared passage of 300 characters may begin and end inside sentences and hold no
whole run of them, as the excerpts around keywords do. So the units are cut by the text itself instead of by
full stops, which keeps the method's shape: every place of a text belongs to the unit whose anchor is the
smallest hash of ``ANCHOR`` characters within the window of ``length`` characters that starts there (winnowing).
Two equal windows have the same anchor at the same distance, wherever they stand, so equal passages are cut into
equal units except at their two ends, and no window of ``length`` characters is ever missed.

1. Every unit is hashed as a whole and by its anchor; one shuffle by anchor joins them globally.
2. A unit that occurs in another record as a whole is shared, without looking at its text.
3. Of the units that only share their anchor, the windows are compared exactly, within the anchor's group.
4. The windows found are merged into the longest unbroken runs of each record.

Groups are streamed or aggregated, never paired: the cost of a group is the number of its units, however many
records share a passage. A group of many different units goes through an aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.words import mix
from filingloom.sources.tables import written

#: Characters of an anchor.
ANCHOR = 80
#: Places that are hashed at once; a power of two, for the position is kept in the low bits of a hash.
BLOCK_BITS = 20
BLOCK = (1 << BLOCK_BITS) - 1
#: Units of one anchor that one task compares; larger groups are aggregated instead.
GROUP_UNITS = 2000

_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the code points, and the powers of the base and of its inverse."""
    codes = mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(11))
    inverse = pow(_BASE, -1, 1 << 64)
    powers = []
    for b in (_BASE, inverse):
        p = np.full(BLOCK + 2, b, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return codes, powers[0], powers[1]


class Hashes:
    """Hashes of all substrings of up to ``BLOCK`` code points."""

    def __init__(self, text: str):
        codes, up, self.down = _tables()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes[points] * up[: self.n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """One hash for each place at which a window of ``width`` starts."""
        n = self.n - width + 1
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def units(texts: list[str], length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(text number, anchor hash, unit hash, first window, last window)`` of the units of texts that fit one block together."""
    h = Hashes("".join(texts))
    n = h.n - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sizes = np.array([len(t) for t in texts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    grams = h.windows(anchor)
    low = np.uint64(BLOCK)
    order = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    best = sliding_minimum(order, length - anchor + 1)[:n]
    places = np.flatnonzero(np.arange(n) + length <= ends[:n])
    at = (low - (best[places] & low)).astype(np.int64)
    if not len(places):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(places) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(places) - 1]])
    start, stop, at = places[first], places[last], at[first]
    whole = h.between(start, stop + length)
    form = ((at - start).astype(np.uint64) << np.uint64(32)) + (stop - start).astype(np.uint64)
    number = np.searchsorted(np.cumsum(sizes), start, "right")
    base = (np.cumsum(sizes) - sizes)[number]
    return number, grams[at].view(np.int64), mix(whole + mix(form)).view(np.int64), start - base, stop - base


def blocks(texts: list[str], length: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in blocks of at most ``BLOCK`` characters: numbers, offsets and parts; parts of a long text overlap so that every window is in one."""
    held: tuple[list[int], list[int], list[str]] = ([], [], [])
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), BLOCK - length + 1):
            part = t if len(t) <= BLOCK else t[at : at + BLOCK]
            if size + len(part) > BLOCK:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (i, at, part)):
                column.append(value)
            size += len(part)
            if len(t) <= BLOCK:
                break
    if held[0]:
        yield held


def _all_units(records: DataFrame, length: int) -> DataFrame:
    """``(anchor, unit, rec, lo, hi)``: the units of every record of at least ``length`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            recs = b.column(0).to_numpy(zero_copy_only=False)
            for numbers, offsets, parts in blocks(b.column(1).to_pylist(), length):
                number, anchor, unit, lo, hi = units(parts, length)
                shift = np.array(offsets, np.int64)[number]
                rec = recs[np.array(numbers, np.int64)[number]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, unit, rec, (lo + shift).astype(np.int32), (hi + shift).astype(np.int32))], ["anchor", "unit", "rec", "lo", "hi"])

    return records.where(F.length("t") >= length).mapInArrow(run, "anchor long, unit long, rec long, lo int, hi int")


def _shared_windows(recs: np.ndarray, others: np.ndarray, starts: np.ndarray, texts: list[str], length: int) -> list[tuple[int, int, int]]:
    """``(rec, start, end)`` of the runs of windows, of the units of one anchor, that occur in another record too."""
    found: dict[int, list[int]] = {}
    hashed = [Hashes(t).windows(length).tolist() for t in texts]
    for r, o, windows in zip(recs, others, hashed):
        for w in windows:
            pair = found.get(w)
            if pair is None:
                found[w] = [r, o]
            else:
                if r < pair[0]:
                    pair[0] = r
                if o > pair[1]:
                    pair[1] = o
    out = []
    for r, o, at, windows in zip(recs, others, starts, hashed):
        if r != o:  # shared as a whole, known already
            continue
        flags = np.array([found[w][0] != found[w][1] for w in windows], np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
        out += [(r, at + int(a), at + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2])]
    return out


def _compare_groups(slices: DataFrame, length: int) -> DataFrame:
    """Step 3 for groups of up to ``GROUP_UNITS`` units: rows arrive sorted by anchor, one group is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(group: pd.DataFrame) -> list[tuple[int, int, int]]:
            return _shared_windows(group["rec"].tolist(), group["other"].tolist(), group["lo"].tolist(), group["t"].tolist(), length)

        def frame(rows: list[tuple[int, int, int]]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["rec", "s", "e"])

        for f in frames:
            if not len(f):
                continue
            f = pd.concat([*held, f], ignore_index=True) if held else f
            last = f["anchor"].iloc[-1]
            ready, held = f[f["anchor"] != last], [f[f["anchor"] == last]]
            yield frame([row for _, g in ready.groupby("anchor", sort=False) for row in done(g)])
        if held:
            yield frame(done(held[0]))

    return slices.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "rec long, s int, e int")


def _compare_large(slices: DataFrame, length: int) -> DataFrame:
    """Step 3 for large groups: every window is a row, and windows are counted by an aggregate with map-side combine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for anchor, rec, other, lo, t in zip(f["anchor"], f["rec"], f["other"], f["lo"], f["t"]):
                w = Hashes(t).windows(length).view(np.int64)
                yield pd.DataFrame({"anchor": anchor, "w": w, "rec": rec, "other": other, "s": np.arange(lo, lo + len(w), dtype=np.int32)})

    rows = slices.select("anchor", "rec", "other", "lo", "t").mapInPandas(run, "anchor long, w long, rec long, other long, s int")
    shared = rows.groupBy("anchor", "w").agg(F.min("rec").alias("a"), F.max("other").alias("b")).where("a < b").select("anchor", "w")
    return rows.where("rec = other").join(shared, ["anchor", "w"]).select("rec", "s", (F.col("s") + length).alias("e"))


def shared_spans(records: DataFrame, length: int = 300) -> DataFrame:
    """``(rec, span_start, span_end)`` of ``records (rec LONG, t STRING)``: where a record's text is shared.

    One row for each longest unbroken run of characters that is covered by passages of ``length`` or more
    characters found exactly so in another record; passages that overlap or touch make one run. Positions are
    code points from 0, the end is exclusive; text is taken as it is. Rows of one ``rec`` count as one record:
    a repeated row shares nothing with itself. Null and empty texts, texts of fewer than ``length``
    characters and null ``rec`` give no rows; an empty table gives an empty one. ``length`` must be greater
    than ``ANCHOR``.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be more than {ANCHOR}")
    records = records.where("rec is not null and t is not null")
    found = written(_all_units(records, length))
    # anchors of two records or more; reduced on the map side, so a hot passage is a few rows a task
    anchors = found.groupBy("anchor").agg(F.min("rec").alias("k1"), F.max("rec").alias("k2")).where("k1 < k2").select("anchor")
    # a hot anchor is split over tasks by the skew join: the other side has one row for it
    met = written(found.join(anchors, "anchor"))
    by_unit = met.groupBy("anchor", "unit").agg(F.min(F.struct("rec", "lo")).alias("first"), F.max("rec").alias("other"), F.count("*").alias("n"))
    by_unit = by_unit.withColumn("whole", F.col("first.rec") < F.col("other"))
    # units whose text is needed: those found in one record only, and one of each that several have
    groups = by_unit.groupBy("anchor").agg(F.sum(F.when(F.col("whole"), 1).otherwise(F.col("n"))).alias("group"), F.min("whole").alias("alone"))
    met = met.join(by_unit.drop("n"), ["anchor", "unit"]).join(groups, "anchor")
    needed = ~F.col("alone") & (F.col("group") > 1) & (~F.col("whole") | (F.struct("rec", "lo") == F.col("first")))
    met = written(met.select("anchor", "rec", "lo", "hi", "other", "whole", needed.alias("needed"), "group"))
    whole = met.where("whole").select("rec", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    places = met.where("needed").groupBy("rec").agg(F.collect_list(F.struct("anchor", "other", "lo", "hi", "group")).alias("u"))
    texts = records.where(F.length("t") >= length).dropDuplicates(["rec"])
    slices = texts.join(places, "rec").select("rec", F.explode("u").alias("u"), "t")
    slices = slices.select("rec", "u.*", F.substring("t", F.col("u.lo") + 1, F.col("u.hi") - F.col("u.lo") + length).alias("t"))
    small, large = slices.where(F.col("group") <= GROUP_UNITS).drop("group"), slices.where(F.col("group") > GROUP_UNITS).drop("group")
    parts = [_compare_groups(small, length)]
    if met.where(F.col("needed") & (F.col("group") > GROUP_UNITS)).limit(1).count():
        parts.append(_compare_large(large, length))
    covered = reduce(DataFrame.unionByName, parts, whole)
    before = F.max("e").over(Window.partitionBy("rec").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    runs = covered.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("s")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy("rec").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("rec", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")
