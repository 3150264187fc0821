"""Evaluation passages inside a corpus (problem 7).

Method: CGK random-walk embedding with repeated bit sampling. A window of ``words`` words is read by a
random walk: at step ``j`` the walk writes the word under its pointer and moves on by one bit that depends
on step and word only. Windows at a small edit distance fall into step again, so their walks differ at few
steps. Each repetition draws its own walk and samples ``bits`` of its steps; windows that agree on the sample are
candidates, and the word-level edit distance decides. Equal windows walk alike, so with ``max_edits`` 0 one
repetition has recall 1; with edits, :func:`repetitions` finds the number that reaches a target recall by walking over
edited windows. A walk over a text isn't stopped at the window's end, for an inserted or dropped word moves that end; the
distance is that to the nearest run of words that begins at the walk's start.

The held-out items are a stated query set. Long passages are cut into overlapping segments, and segments are indexed
in blocks of bounded bytes, each block being one pass over the corpus: with more than one, a block's hits are
written before the next is made, so the driver and the tasks hold one block at a time, whatever the number of items.
The corpus is never shuffled; only found pairs are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.words import mix, words as split_words
from filingloom.sources.tables import written

#: Bytes of one index, and words of a segment of a passage.
BLOCK_BYTES, SEGMENT_WORDS = 64 << 20, 2_000
#: Steps that are sampled when edits are allowed, and repetitions that may be needed.
EDIT_BITS, MOST_REPETITIONS = 6, 400


def _steps(words: int, max_edits: int) -> int:
    """Steps of a walk that may be sampled: all that read a whole window, or few enough to stay within it."""
    return words * 3 // 2 if max_edits else 3 * words


@lru_cache(maxsize=32)
def repetitions(words: int, max_edits: int, bits: int, target_recall: float) -> int:
    """Repetitions after which a window with ``max_edits`` edits has been a candidate with probability ``target_recall``.

    Found by walking over 400 windows with substituted, inserted and dropped words at random places; the same in every run.
    """
    if max_edits == 0:
        return 1
    rng = np.random.default_rng(11)
    pairs = []
    for i in range(400):
        own = list(range(2, words + 2))
        text = own + list(range(10_000, 10_000 + words + max_edits))
        for e in range(max_edits):
            at, kind = int(rng.integers(0, words)), int(rng.integers(0, 3))
            text[at : at + (kind != 1)] = [20_000 + i + 1000 * e] * (kind != 2)
        pairs.append((own, text[: 2 * words]))
    flat = np.array([w for own, text in pairs for w in own + [1] * words + text], np.int64)
    starts = np.arange(2 * len(pairs), dtype=np.int64) * (2 * words)
    hit = np.zeros(len(pairs))
    for r in range(1, MOST_REPETITIONS + 1):
        moves, sample = _draw(40_000, words, max_edits, bits, rng)
        sign = _walk(flat, starts, np.where(np.arange(len(starts)) % 2, len(flat), starts + words), moves, sample)
        hit = np.maximum(hit, sign[::2] == sign[1::2])
        if hit.mean() >= target_recall:
            return r
    raise ValueError(f"{words} words with {max_edits} edits need more than {MOST_REPETITIONS} repetitions of {bits} bits; take fewer bits")


def _draw(vocabulary: int, words: int, max_edits: int, bits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One random word of bits for every vocabulary word (bit j moves the walk at step j), and the sampled steps."""
    steps = _steps(words, max_edits)
    moves = rng.integers(0, 1 << 63, (vocabulary + 2, -(-steps // 63)), np.int64)
    return moves, np.sort(rng.choice(steps, min(bits, steps), replace=False))


def _walk(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, moves: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Hash of the sampled steps of the walk from each start; from ``ends`` on the walk reads a word that no text has."""
    pad, chosen = len(moves) - 1, set(sample.tolist())
    at = starts.copy()
    sign = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return sign
    top = len(flat) - 1
    for j in range(max(chosen) + 1):
        under = np.where(at < ends, flat[np.minimum(at, top)], pad)
        if j in chosen:
            sign = sign * np.uint64(0x9E3779B97F4A7C15) + under.astype(np.uint64) + np.uint64(1)
        at += (moves[under, j // 63] >> (j % 63)) & 1
    return mix(sign)


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word-level Levenshtein distance of two short id arrays."""
    return _rows(a, b)[-1]


def _rows(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The distances of ``a`` to each beginning of ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row


def distance_from(window: np.ndarray, text: np.ndarray, max_edits: int) -> int:
    """The least distance of a window to a run of words that begins where ``text`` does."""
    row = _rows(window, text[: len(window) + max_edits])
    return min(row[max(0, len(window) - max_edits) :], default=len(window))


class WindowIndex:
    """All windows of the items, hashed by sampled steps of their walks. Word 0 stands for every word no item has."""

    def __init__(self, items: list[tuple[int, str | None]], words: int, max_edits: int, bits: int, rounds: int, seed: int = 7):
        self.words, self.max_edits = words, max_edits
        vocabulary: dict[str, int] = {}
        rows, owners = [], []
        for key, passage in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(passage)]
            for i in range(len(ids) - words + 1):
                rows.append(ids[i : i + words])
                owners.append(key)
        self.vocabulary = vocabulary
        self.windows = np.array(rows, np.int32).reshape(-1, words)
        self.owners = np.array(owners, np.int64)
        rng = np.random.default_rng(seed)
        self.draws = [_draw(len(vocabulary), words, max_edits, bits, rng) for _ in range(rounds)]
        flat = self.windows.ravel()
        starts = np.arange(len(self.windows), dtype=np.int64) * words
        self.tables = []
        for draw in self.draws:
            sign = _walk(flat, starts, starts + words, *draw)
            order = np.argsort(sign, kind="stable").astype(np.int32)
            self.tables.append((sign[order], order))

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item, first word) of every place at which a run of words is within ``max_edits`` of an item's window."""
        none = np.zeros(0, np.int64)
        if not len(self.windows):
            return none, none, none
        get, edits = self.vocabulary.get, self.max_edits
        lists = [split_words(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(map(get, chain.from_iterable(lists), _zeros()), np.int32, int(sizes.sum()))
        least = self.words - edits
        n = len(flat) - least + 1
        if n <= 0 or least <= 0:
            return none, none, none
        text = np.repeat(np.arange(len(lists)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        # a run with more unknown words than edits can't be near any item
        starts = np.flatnonzero((unknown[least:] - unknown[:n] <= edits) & (text[:n] == text[least - 1 :]))
        ends = first[text[starts] + 1] if edits else starts + self.words
        places, windows = [], []
        for draw, (signs, order) in zip(self.draws, self.tables):
            sign = _walk(flat, starts, ends, *draw)
            low = np.searchsorted(signs, sign, "left")
            counts = np.searchsorted(signs, sign, "right") - low
            some = np.flatnonzero(counts)
            if len(some):
                many = counts[some]
                place = np.repeat(some, many)
                within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                places.append(place)
                windows.append(order[np.repeat(low[some], many) + within].astype(np.int64))
        if not places:
            return none, none, none
        # each pair once, whatever the number of repetitions that found it
        both = np.unique(np.concatenate(places) * len(self.windows) + np.concatenate(windows))
        place, window = both // len(self.windows), both % len(self.windows)
        s = starts[place]
        if edits:
            near = np.array([distance_from(self.windows[w], flat[a:e], edits) <= edits for w, a, e in zip(window.tolist(), s.tolist(), ends[place].tolist())], bool)
        else:
            near = (flat[s[:, None] + np.arange(self.words)] == self.windows[window]).all(axis=1)
        hits = np.stack([text[s[near]], self.owners[window[near]], s[near] - first[text[s[near]]]], axis=1)
        found = np.unique(hits, axis=0)
        return found[:, 0], found[:, 1], found[:, 2]


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def _segments(items: DataFrame, item_key: str, passage: str, words: int) -> DataFrame:
    """``(i, p, n)``: the passages in segments of at most ``SEGMENT_WORDS`` words (or twice a window) that share ``words`` - 1, with the number of windows of each."""
    size = max(SEGMENT_WORDS, 2 * words)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, p in zip(f["i"], f["p"]):
                w = split_words(p)
                for at in range(0, len(w) - words + 1, size - words + 1):
                    part = w[at : at + size]
                    rows.append((i, " ".join(part), len(part) - words + 1))
            yield pd.DataFrame(rows, columns=["i", "p", "n"])

    chosen = items.select(items[item_key].cast("long").alias("i"), items[passage].alias("p")).where("i is not null and p is not null").distinct()
    return chosen.mapInPandas(run, "i long, p string, n int")


def leaked_windows(
    docs: DataFrame,
    items: DataFrame,
    key: str,
    text: str,
    item_key: str,
    passage: str,
    words: int = 12,
    max_edits: int = 0,
    bits: int | None = None,
    target_recall: float = 0.95,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(key, item_key, first_word)``: every place of a text from which a run of words is at most ``max_edits`` word edits from a window of ``words`` words of an item.

    An edit is a word substituted, inserted or dropped. Words are runs of letters and digits, lower-cased. With
    ``max_edits`` 0 all such places are found, else each window with a probability of ``target_recall`` at least. Null and
    empty texts and passages, and those of fewer than ``words`` words (texts: less ``max_edits``), give no row; a null
    key of either side gives no row; repeated rows of the corpus or of the items give no repeated rows; ties
    don't arise, every item is reported; an empty table of either side gives an empty result; other columns are ignored.
    """
    if not 0 <= max_edits < words:
        raise ValueError("max_edits must be at least 0 and below words")
    spark = docs.sparkSession
    bits = bits if bits is not None else 24 if max_edits == 0 else EDIT_BITS
    rounds = repetitions(words, max_edits, bits, target_recall)
    chosen = written(_segments(items, item_key, passage, words))
    # a window, and its place and hash in each table
    total = (chosen.agg(F.sum("n")).first()[0] or 0) * (4 * words + 12 * rounds)
    blocks = max(1, math.ceil(total / block_bytes))
    source = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).where("k is not null and t is not null")

    def one(block: int) -> DataFrame:
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(WindowIndex(sorted((r.i, r.p) for r in part.select("i", "p").collect()), words, max_edits, bits, rounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    cut = b.slice(at, 2000)
                    number, item, first = index.value.search(cut.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([cut.column(0).take(pa.array(number)), pa.array(item), pa.array(first)], ["k", "i", "w"])

        found = source.mapInArrow(run, "k long, i long, w long")
        if blocks == 1:
            return found
        found = written(found)
        index.destroy()
        return found

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    return found.distinct().toDF(key, item_key, "first_word")


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, passage: str, words: int = 12, **options) -> DataFrame:
    """``(key, item_key, windows)``: each text with each item it leaks, and at how many places a window of ``words`` words begins.

    Cases as in :func:`leaked_windows`.
    """
    return leaked_windows(docs, items, key, text, item_key, passage, words, **options).groupBy(key, item_key).agg(F.count("*").alias("windows"))
