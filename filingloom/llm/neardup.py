"""Near-duplicate texts (problem 5).

Method: bottom-k sketches from one hash function, inverted lists of MinHash bands, an estimate from the
union sketch, exact Jaccard on what remains.

A text's shingles (runs of consecutive words) are hashed once; the smallest values, in order, are
its sketch, of short texts all values. Filings are written from stock phrases, so a single retained value may stand in
most texts and its list would pair everything with everything. Texts of 100 shingles or more are therefore listed by bands
of MinHash values, each band a key: two texts share one with a probability that depends on their Jaccard similarity
alone, not on what else the table holds, and rows and bands are set so that a pair at the threshold is missed with a
probability of at most ``MISSED``. Texts of under 100 shingles list the first ``n - ceil(J n) + 1`` of all their values, a
prefix filter that misses nothing whatever the order, as long as it is one for all texts: here rare values first, in the
order of their hashes, and then the stock values, the most frequent last, so that lists stay short. Of what meets in
those lists, pairs are left out that can't reach the threshold by their lengths, by the place of the value in both, or by
the least number of values that only one of them has, which bit maps of the sets tell. Bands of
length overlap by the factor J, so the two texts of a pair always meet in one band.

Stock values are those in at least one in two hundred of the texts listed by value, which have a bounded number of
values each; so there is a bounded number of stock values, whatever the size of the collection, and they can be broadcast.

Texts with equal shingle sets are one class. A task lists a class once, whatever copies of it the task reads,
so a group of copies is reduced before the shuffle and never fills a list. Lists are joined, never collected;
adaptive execution splits a hot one over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.words import mix, words
from filingloom.sources.tables import cut, small, written

#: Values of a long text's sketch; they estimate a candidate pair's Jaccard.
ESTIMATE = 64


#: Share of the texts listed by value from which on a value is stock, and texts that it must at least be in.
STOCK_SHARE, STOCK_LEAST = 0.005, 50
#: Words of 64 bits of the bit map of a text listed by value; a power of two.
MAP_WORDS = 4
#: Shingles from which on a text is listed by MinHash bands.
LONG = 100
#: Probability that two texts right at the threshold have no band in common, and bands that may be used to keep to it.
MISSED, MOST_BANDS = 5e-5, 128


def bands(threshold: float) -> list[tuple[int, int, int, str]]:
    """``(band, least shingles, most shingles, keys)``: what texts of a length list.

    The shorter text of a pair is in one band's core, and the longer has at most 1 / threshold of its shingles.
    """
    cores = [(1, 30, "prefix"), (30, LONG, "prefix"), (LONG, None, "minhash")]
    return [(i, low, 1 << 60 if high is None else math.ceil(high / threshold) + 1, kind) for i, (low, high, kind) in enumerate(cores)]


def _listed_by_value(threshold: float) -> int:
    """Shingles below which a text is in a band with a prefix filter."""
    return max(high for _, _, high, kind in bands(threshold) if kind == "prefix")


def minhash_shape(threshold: float) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band for which at most ``MOST_BANDS`` bands keep to ``MISSED`` at the threshold."""
    for rows in range(32, 0, -1):
        hit = threshold**rows
        needed = math.ceil(math.log(MISSED) / math.log1p(-hit)) if hit < 1 else 1
        if needed <= MOST_BANDS:
            break
    return needed, rows


_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingler:
    """64-bit hashes of the distinct shingles of texts, sorted; words are hashed once and remembered up to a bound."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def word(self, w: str) -> int:
        import xxhash

        h = self.known.get(w)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [words(t) for t in texts]
        flat = np.fromiter(map(self.word, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))
        n = len(flat) - self.size + 1
        with np.errstate(over="ignore"):
            all_runs = mix(sum((flat[i : i + n] * _SEEDS[i] for i in range(self.size)), np.zeros(max(n, 0), np.uint64))) if n > 0 else flat[:0]
        out, at = [], 0
        for w in lists:
            out.append(np.unique(all_runs[at : at + max(0, len(w) - self.size + 1)]))
            at += len(w)
        return out


def minhash_bands(sets: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The keys of the MinHash bands of non-empty sets, one row a set.

    Fast similarity sketches: in each round every value falls into one bin by a hash of its own, and a bin that is
    still empty keeps the smallest. Two sets agree in a bin with probability J, as in MinHash with one
    hash function a bin, but a set of many values fills all bins within a few rounds.
    """
    count, rows = shape
    bins = count * rows
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least, empty = np.full(len(sets) * bins, np.iinfo(np.uint64).max, np.uint64), np.ones(len(sets) * bins, bool)
    with np.errstate(over="ignore"):
        for i in range(1, 1 << 20):
            h = mix(flat ^ mix(np.uint64(i) * _SEEDS[11]))
            at = own * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            free = empty[at]
            np.minimum.at(least, at[free], h[free])
            empty[at[free]] = False
            short = empty.reshape(len(sets), bins).any(axis=1)
            if not short.any():
                break
            flat, own = flat[short[own]], own[short[own]]
        values = least.reshape(len(sets), count, rows)
        return mix(np.sum(mix(values) * _SEEDS[:rows], axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * _SEEDS[12])


def keys_of(sketch: np.ndarray, rank: np.ndarray, n: int, threshold: float, minhash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the inverted lists of a text of ``n`` shingles, and how many shingles the text can have in common with one that it meets there first.

    ``rank`` is 0 for the rare values of its sketch and orders the stock ones; ``minhash`` are the bands of a long text.
    """
    out, rest = [sketch[:0]], [np.zeros(0, np.int32)]
    for band, low, high, kind in bands(threshold):
        if not low <= n < high:
            continue
        if kind == "prefix":
            keys = sketch[np.argsort(rank, kind="stable")[: n - math.ceil(threshold * n - 1e-9) + 1]]
            rest.append(np.arange(n, n - len(keys), -1, dtype=np.int32))
        else:
            keys = minhash
            rest.append(np.full(len(keys), n, np.int32))
        out.append(mix(keys + np.uint64(band)))
    return np.concatenate(out), np.concatenate(rest)


def bit_maps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``MAP_WORDS`` words for each set: a bit for each of its values, by their lowest bits."""
    out = np.zeros((len(counts), MAP_WORDS), np.uint64)
    word = (values >> np.uint64(6) & np.uint64(MAP_WORDS - 1)).astype(np.int64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(counts)), counts), word), np.uint64(1) << (values & np.uint64(63)))
    return out


_TOP = np.uint64(1 << 63)  # turned by the top bit, signed longs are in the order of the hashes


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketches(df: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """``(id, n, same, sketch, minhash)`` of every text with at least one shingle.

    ``same`` identifies the set of shingles: texts with one value of it are copies for this purpose. Of the
    copies that a task reads only the first has its ``sketch``, and its ``minhash`` bands if it is long.
    """
    shape = minhash_shape(threshold)
    # shorter texts are listed by their values and keep all of them
    whole = _listed_by_value(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, listed, none = Shingler(size), set(), np.zeros(0, np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = shingler.sets(part.column(1).to_pylist())
                keep = [i for i, s in enumerate(sets) if len(s)]
                sets = [sets[i] for i in keep]
                with np.errstate(over="ignore"):
                    same = np.array([mix(np.sum(mix(s ^ _SEEDS[9]), keepdims=True) + np.uint64(len(s)))[0] for s in sets], np.uint64)
                new = []
                for c in same.tolist():
                    new.append(c not in listed)
                    if len(listed) < 5_000_000:  # a bound on memory only
                        listed.add(c)
                first = _lists([s[: (len(s) if len(s) < whole else ESTIMATE) * n] ^ _TOP for s, n in zip(sets, new)])
                long = [n and len(s) >= LONG for s, n in zip(sets, new)]
                found = iter(minhash_bands([s for s, n in zip(sets, long) if n], shape))
                minhash = _lists([next(found) if n else none for n in long])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), pa.array([len(s) for s in sets], pa.int32()), pa.array(same.view(np.int64)), first, minhash], ["id", "n", "same", "sketch", "minhash"])

    rows = df.select(df[key].cast("long").alias("id"), df[text].alias("t")).where("id is not null and t is not null")
    return rows.mapInArrow(run, "id long, n int, same long, sketch array<long>, minhash array<long>")


def stock_values(made: DataFrame, threshold: float) -> np.ndarray:
    """Values in at least ``STOCK_SHARE`` of the distinct sets of texts listed by value, the least frequent first.

    Copies that several tasks have listed count once. Which values are stock decides how long lists are, never which
    pairs are found.
    """
    listed = made.where((F.size("sketch") > 0) & (F.col("n") < _listed_by_value(threshold))).select("same", "sketch").dropDuplicates(["same"])
    least = max(STOCK_LEAST, STOCK_SHARE * listed.count())
    found = listed.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    return np.array([v for _, v in sorted((r.c, r.v) for r in found.collect())], np.int64)


def inverted_lists(made: DataFrame, threshold: float) -> DataFrame:
    """``(same, key, n, rest, w0, w1, ...)`` of every class with each list it is in.

    ``rest`` is the number of shingles it can share with a text that it meets there first; the words of the bit map
    are 0 for texts that are listed by MinHash bands only.
    """
    whole = _listed_by_value(threshold)
    words_of_map = [f"w{i}" for i in range(MAP_WORDS)]
    by_count = stock_values(made, threshold)
    by_value = np.argsort(by_count)
    stock = made.sparkSession.sparkContext.broadcast((by_count[by_value], by_value + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = stock.value
        for b in batches:
            same, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            flat = b.column(2).flatten().to_numpy()
            rank = np.zeros(len(flat), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                rank = np.where(values[at] == flat, ranks[at], 0)
            flat = flat.view(np.uint64) ^ _TOP
            ends = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            most = b.column(3).flatten().to_numpy().view(np.uint64)
            long = np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            found = [keys_of(flat[x:y], rank[x:y], n, threshold, most[u:v]) for x, y, n, u, v in zip(ends, ends[1:], sizes.tolist(), long, long[1:])]
            out = np.concatenate([*(k for k, _ in found), np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            rest = np.concatenate([*(r for _, r in found), np.zeros(0, np.int32)]).astype(np.int32)
            row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
            maps = bit_maps(flat, np.diff(ends))
            maps[sizes >= whole] = 0
            columns = [same[row], out, sizes[row], rest, *maps[row].T.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["same", "key", "n", "rest", *words_of_map])

    kinds = ", ".join(["same long, key long, n int, rest int", *(f"{w} long" for w in words_of_map)])
    return made.where(F.size("sketch") > 0).select("same", "n", "sketch", "minhash").mapInArrow(run, kinds)


def _may_reach(threshold: float) -> Column:
    """Whether the texts ``a`` and ``b`` that meet in a list may be a pair; of a pair, the rows of the list that it meets in first hold.

    A pair shares at least t / (1 + t) of its added lengths, and at most the rest of them is in one text only.
    """
    shared = F.least("a.rest", "b.rest") >= F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-6)
    apart = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(MAP_WORDS)), F.lit(0))
    # a map of only one of the two tells nothing: the other is listed by MinHash bands only
    mapped = F.greatest("a.n", "b.n") < _listed_by_value(threshold)
    return shared & (~mapped | (apart <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6))


def _union_estimate(threshold: float) -> float:
    """The least estimate that is kept: four standard deviations of a sketch of 64 below the threshold."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / ESTIMATE)


#: Shingles, and texts, of a block: a cell of two blocks is what a task holds while it verifies.
BLOCK_SHINGLES, BLOCK_TEXTS, LEAST_BLOCKS = 2_000_000, 2_000, 16


class ExactSets:
    """Sets of shingles as sorted arrays of exact codes, comparable within one instance."""

    def __init__(self, size: int):
        self.size, self.bits, self.numbers, self.sets = size, 63 // size, {}, {}

    def add(self, key: int, text: str) -> None:
        numbers = self.numbers
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.uint64)
        n = len(ids) - self.size + 1
        if len(numbers) <= 1 << self.bits:
            code = sum((ids[i : i + n] << np.uint64(self.bits * i) for i in range(self.size)), np.zeros(n, np.uint64)) if n > 0 else ids[:0]
        else:  # rows of word numbers, compared as bytes
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, self.size)) if n > 0 else np.zeros((0, self.size), np.uint64)
            code = rows.view(f"V{8 * self.size}").ravel()
        self.sets[key] = np.unique(code)

    def jaccard(self, a: int, b: int) -> float:
        x, y = self.sets[a], self.sets[b]
        if x.dtype != y.dtype:  # the words outgrew the packed form between the two
            return self._by_rows(x, y)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0

    def _by_rows(self, x: np.ndarray, y: np.ndarray) -> float:
        tuples = lambda s: {tuple((int(v) >> self.bits * i) & ((1 << self.bits) - 1) for i in range(self.size)) for v in s} if s.dtype == np.uint64 else {tuple(np.frombuffer(v.tobytes(), np.uint64).tolist()) for v in s}
        a, b = tuples(x), tuples(y)
        return len(a & b) / len(a | b) if a or b else 0.0


def verified(texts: DataFrame, likely: DataFrame, shingles: int, count: int, size: int, threshold: float) -> DataFrame:
    """``(key_a, key_b, jaccard)`` of the pairs ``likely (a, b)`` that reach the threshold exactly, with ``texts (id, t)``.

    Ids are dealt into blocks, so large (``shingles`` and ``count`` of all ids) that two of them fit in a task. A cell is a pair of
    blocks; a text is sent once to each cell that has a pair of it, not once for each pair, so the texts of a family of m
    near-copies are sent as often as there are blocks. In a cell each text is split once. Of several
    texts of one id the smallest counts.
    """
    blocks = max(LEAST_BLOCKS, -(-shingles // BLOCK_SHINGLES), -(-count // BLOCK_TEXTS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = likely.withColumn("cell", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    sides = small(pairs.select(F.explode(F.array("a", "b")).alias("id"), "cell").distinct())
    rows = texts.join(sides, "id").select("cell", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "t")
    rows = rows.unionByName(pairs.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("t")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, sets = None, {}, ExactSets(size)
        for f in frames:
            found = []
            for c, kind, a, b, t in zip(f["cell"].tolist(), f["kind"].tolist(), f["a"].tolist(), f["b"].tolist(), f["t"]):
                if c != cell:
                    cell, held, sets = c, {}, ExactSets(size)
                if kind == 0:
                    held[a] = min(t, held[a]) if a in held else t
                    continue
                for k in (a, b):
                    if k not in sets.sets:
                        sets.add(k, held.pop(k))
                j = sets.jaccard(a, b)
                if j >= threshold - 1e-12:
                    found.append((a, b, j))
            yield pd.DataFrame(found, columns=["key_a", "key_b", "jaccard"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInPandas(run, "key_a long, key_b long, jaccard double")


def _classes(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(same, class)`` and ``members (id, class)`` out of sketches."""
    ids = made.select("id", "same")
    firsts = ids.groupBy("same").agg(F.min("id").alias("class"))
    return firsts, ids.join(firsts, "same").groupBy("id").agg(F.min("class").alias("class"))


def classes(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(id, class)``: the smallest id with the same set of shingles, without any search for near-duplicates. Cases as in :func:`near_duplicates`."""
    return _classes(written(sketches(df, key, text, size, threshold).select("id", "same")))[1]


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """``pairs (key_a, key_b, jaccard)`` between representatives of different shingle sets, and ``members (id, class)``.

    ``class`` is the smallest id with the same set of shingles; every text with a shingle is in ``members``. A
    pair is there if the exact Jaccard similarity of the two sets of ``size`` consecutive words (runs of letters
    and digits, lower-cased) is at least ``threshold``. Pairs of texts of under 100 shingles are all found; longer ones come
    from MinHash bands and an estimate, so that a pair exactly at the threshold is missed with a probability of about
    one in ten thousand, whatever else the table holds, and one well above it practically never.
    Null and empty texts, texts of fewer than ``size`` words and null keys have no row; rows of one key count
    once, and if their texts differ the key is in the class of the smallest; an empty table gives empty ones;
    other columns are ignored.
    """
    made = written(sketches(df, key, text, size, threshold))
    firsts, members = _classes(made)
    # one shuffle by key serves both sides of the join and the removal of classes that several tasks have listed
    lists = inverted_lists(made, threshold).repartition("key").dropDuplicates(["key", "same"])
    met = lists.alias("a").join(lists.alias("b"), F.col("a.key") == F.col("b.key")).where(F.expr("a.same < b.same") & _may_reach(threshold))
    met = met.select(F.col("a.same").alias("a"), F.col("b.same").alias("b")).distinct()
    whole = _listed_by_value(threshold)
    values = made.where(F.size("sketch") > 0).select("same", "n", "sketch").dropDuplicates(["same"])
    pairs = met.join(values.toDF("a", "na", "sa"), "a").join(values.toDF("b", "nb", "sb"), "b")
    # the smallest values of the union are the sketch of the union; the share of it in both sketches estimates Jaccard;
    # of two texts that keep all their values it is exact
    sample = F.when(F.greatest("na", "nb") < whole, 2 * whole).otherwise(ESTIMATE)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), F.lit(1), sample)
    estimate = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    likely = pairs.where(estimate >= _union_estimate(threshold)).select("a", "b", (F.col("na") + F.col("nb")).alias("n"))
    a, b = firsts.toDF("a", "ca"), firsts.toDF("b", "cb")
    likely = written(likely.join(a, "a").join(b, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "n").where("a < b"))
    # the shingles of all pairs are at least those of all texts in pairs; so many blocks are enough
    total = made.agg(F.sum("n").alias("n"), F.count("*").alias("c")).crossJoin(likely.agg(F.sum("n").alias("pn"), F.count("*").alias("pc"))).first()
    texts = df.select(df[key].cast("long").alias("id"), df[text].alias("t")).where("id is not null and t is not null")
    shingles, count = min(total.n or 0, total.pn or 0), min(total.c, 2 * total.pc)
    return verified(texts, likely.select("a", "b"), shingles, count, size, threshold), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(key_a, key_b)`` of every pair of ids, key_a < key_b: members of one class, and of two classes that are a pair."""
    a, b = members.toDF("x", "ca"), members.toDF("y", "cb")
    copies = a.join(b, (F.col("ca") == F.col("cb")) & (F.col("x") < F.col("y")))
    near = pairs.select("key_a", "key_b").join(a, F.col("key_a") == F.col("ca")).join(b, F.col("key_b") == F.col("cb"))
    return copies.select("x", "y").unionByName(near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).toDF("key_a", "key_b")


def components(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """``(id, group)`` of the ids in ``pairs``: the smallest id of their connected component.

    Alternating large-star and small-star steps on the links, each a group-by with a map-side minimum; the links
    stay distributed and are checkpointed, only the count of changed links comes to the driver. A hot id is a
    star, and a star is what the steps make: they never pair the neighbours of an id with each other. The steps end when no link
    changes, after about the square of the logarithm of the largest component; links that still change after ``rounds`` are an error.
    """
    links = cut(pairs.toDF("u", "v").where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked to the smallest of u's neighbourhood
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        small_least = large.where("v < u").groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("v < u").join(small_least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = cut(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("group"))).groupBy("id").agg(F.min("group").alias("group"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class, group, links)`` of every text that has a near-duplicate or a copy.

    ``links`` counts the classes that the text's class is a pair with; ``group`` is the smallest id connected to it.
    """
    found = components(pairs.select("key_a", "key_b"))
    degree = pairs.select(F.explode(F.array("key_a", "key_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    out = members.join(sizes, "class").join(found.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    return out.where("copies > 1 or group is not null").select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
