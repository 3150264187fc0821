import itertools
import random

import pytest

from filingloom.llm.words import words
from filingloom.llm.neardup import ExactSets, all_pairs, bands, components, groups, near_duplicates, sketches, stock_values


def brute(rows, threshold, size):
    sets = {}
    for k, t in rows:
        w = words(t)
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if s and k is not None:
            sets[k] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def texts(rng, lengths, copies):
    vocab = [f"w{i}" for i in range(2000)]
    stock = [" ".join(rng.choices(vocab, k=8)) for _ in range(60)]
    rows = []
    for n in lengths:
        base = " ".join(" ".join([rng.choice(stock), *rng.choices(vocab, k=4)]) for _ in range(n)).split()
        rows.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.03, 0.06])))):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            rows.append(", ".join(w).upper())
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("threshold, size", [(0.6, 3), (0.8, 5)])
def test_against_brute_force(spark, threshold, size):
    rng = random.Random(2)
    rows = texts(rng, [2, 3, 5, 8, 10, 14, 20, 30, 40, 80], 6)
    rows += [(500, None), (501, ""), (502, "a b"), (None, rows[0][1]), rows[0], (503, rows[0][1]), (504, "one two three four five six"), (505, "One two three four FIVE, six")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, t string, key string")
    pairs, members = near_duplicates(df, "id", "t", threshold, size)
    found = [tuple(r) for r in all_pairs(pairs, members).collect()]
    want = brute(rows, threshold, size)
    assert len(found) == len(set(found)) and set(found) <= want and len(set(found)) >= 0.97 * len(want)
    assert {(504, 505), (1, 503)} <= set(found)
    got = {r["id"]: r["group"] for r in groups(pairs, members).collect()}
    assert all(got[a] == got[b] for a, b in found) and set(got) == {x for p in found for x in p}


def test_hot_group_of_copies_makes_one_class(spark):
    rows = [(i, "the same long text of a filing " * 3) for i in range(300)]
    pairs, members = near_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(4), "id", "t", 0.6, 3)
    assert pairs.count() == 0 and {r["class"] for r in members.collect()} == {0} and members.count() == 300


def test_family_whose_own_values_are_stock(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=500)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(12):
            w[rng.randrange(500)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choices(vocab, k=400))) for i in range(150)]
    pairs, members = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6, 3)
    want = brute(rows, 0.6, 3)
    assert len(want) > 10000 and len({(r.key_a, r.key_b) for r in pairs.collect()} & want) >= 0.99 * len(want)


def test_empty_and_bands(spark):
    pairs, members = near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert pairs.collect() == [] == members.collect()
    for n in (1, 29, 30, 99, 100, 224, 225, 5000):
        for m in range(n, int(n / 0.6) + 1):
            assert any(low <= n and m < high for _, low, high, *_ in bands(0.6))


def family(rng, words, copies, dropped):
    """Copies of one text, of which each lacks its own passages; pairs fall on both sides of 0.6."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        while len(w) > words * (1 - dropped):
            at = rng.randrange(len(w))
            del w[at : at + rng.randint(1, max(2, words // 20))]
        rows.append((i, " ".join(w)))
    return rows


def recall(spark, rows):
    pairs, members = near_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", 0.6, 3)
    found, want = {tuple(r) for r in all_pairs(pairs, members).collect()}, brute(rows, 0.6, 3)
    assert found <= want and len(want) > 1000
    return len(found) / len(want)


def test_large_family_near_the_threshold(spark):
    assert recall(spark, family(random.Random(5), 400, 200, 0.2)) >= 0.999


@pytest.mark.parametrize("words, dropped", [(80, 0.12), (110, 0.12), (60, 0.08)])
def test_large_family_of_short_texts(spark, words, dropped):
    assert recall(spark, family(random.Random(6), words, 200, dropped)) == 1


def test_stock_values_count_distinct_sets(spark):
    family_of = lambda n: [(i, f"one two three four five six seven own{i} text{i} here") for i in range(n)]
    copies = [(1000 + i, t) for i, (_, t) in enumerate(family_of(40) * 3)]
    stock = lambda rows, parts: stock_values(sketches(spark.createDataFrame(rows, "id long, t string").repartition(parts), "id", "t", 3, 0.6), 0.6).tolist()
    assert stock(copies, 1) == stock(copies, 4) == [] and len(stock(family_of(60), 4)) == 5


@pytest.mark.parametrize("copies", [49, 51])
def test_recall_is_the_same_on_both_sides_of_stock(spark, copies):
    rows = family(random.Random(7), 60, copies, 0.05) + [(1000 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(500)]
    pairs, members = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6, 3)
    assert {tuple(r) for r in all_pairs(pairs, members).collect()} == brute(rows, 0.6, 3)


@pytest.mark.parametrize("bits", [2, 21])
def test_exact_sets_whatever_the_number_of_words(bits):
    texts_of = {1: "a b c a b d", 2: "a b c a", 3: "a b c d e f g h", 4: "x y z a b c d e", 5: "a b", 6: ""}
    sets = ExactSets(3)
    sets.bits = bits
    for k, t in texts_of.items():
        sets.add(k, t)
    grams = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in texts_of.items()}
    for a, b in itertools.combinations(texts_of, 2):
        x, y = grams[a], grams[b]
        assert sets.jaccard(a, b) == (len(x & y) / len(x | y) if x | y else 0.0), (a, b)


def test_components_that_do_not_settle_are_an_error(spark):
    chain_of = spark.createDataFrame([(i, i + 1) for i in range(40)], "key_a long, key_b long")
    assert {r.group for r in components(chain_of).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain_of, rounds=1)
