import random

import pytest

from filingloom.llm.leaks import WindowIndex, distance_from, edit_distance, leaked_windows, leaks, repetitions
from filingloom.llm.words import words


def brute(docs, items, n):
    grams = {}
    for k, p in items:
        w = words(p)
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    found = set()
    for k, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            found |= {(k, m) for m in grams.get(tuple(w[i : i + n]), ()) if k is not None and m is not None}
    return found


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 20, 30])))) for i in range(12)]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=40)
        if i % 3 == 0:
            p = words(rng.choice(items)[1])
            w[10:10] = p[: rng.randint(1, len(p))]
        docs.append((i, ", ".join(w).upper()))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "x " * 20000), docs[0]]
    items += [(50, None), (51, ""), (None, "a b"), items[1]]
    got = leaks(*frames(spark, docs, items), "doc_id", "text", "item_id", "passage", 12, block_bytes=block).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(brute(docs, items, 12))


def near(docs, items, n, edits):
    """Every place from which a run of words is within the edits of a window, by plain distances."""
    import numpy as np

    number = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)])
    found = set()
    for i, p in items:
        p = ids(p)
        for k, t in docs:
            t = ids(t)
            for a in range(len(t)):
                for x in range(len(p) - n + 1):
                    runs = [t[a : a + m] for m in range(n - edits, n + edits + 1) if a + m <= len(t)]
                    if any(edit_distance(p[x : x + n], r) <= edits for r in runs):
                        found.add((k, i, a))
    return found


def edited(rng, w, kind):
    w, at = list(w), rng.randrange(len(w))
    w[at : at + (kind != "insertion")] = ["changed"] * (kind != "deletion")
    return w


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
@pytest.mark.parametrize("edits", [1, 2])
def test_edits_reach_the_target_recall(spark, kind, edits):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(150)]
    docs = []
    for i, p in items:
        w = p.split()
        for _ in range(edits):
            w = edited(rng, w, kind)
        docs.append((i, " ".join(rng.choices(vocab, k=15) + w + rng.choices(vocab, k=15))))
    got = leaked_windows(*frames(spark, docs, items), "doc_id", "text", "item_id", "passage", 20, max_edits=edits, target_recall=0.95)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len({(i, i) for i, _ in items} & found) >= 0.9 * len(items) and all(a == b for a, b in found)


def test_edits_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=14))) for i in range(5)]
    docs = [(i, " ".join(rng.choices(vocab, k=5) + edited(rng, edited(rng, words(rng.choice(items)[1]), "insertion"), "deletion") + rng.choices(vocab, k=5))) for i in range(25)]
    want = near(docs, items, 10, 2)
    got = {tuple(r) for r in leaked_windows(*frames(spark, docs, items), "doc_id", "text", "item_id", "passage", 10, max_edits=2, target_recall=0.99).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


def test_distances_and_repetitions():
    import numpy as np

    a = np.arange(10)
    assert distance_from(a, np.concatenate([a[:4], a[5:], a]), 2) == 1 and distance_from(a, np.insert(a, 3, 99), 2) == 1
    assert distance_from(a, a[:8], 2) == 2 and distance_from(a, a[:0], 2) == 10
    assert repetitions(20, 0, 12, 0.95) == 1 and 1 < repetitions(16, 2, 6, 0.9) <= repetitions(16, 2, 6, 0.99)
    with pytest.raises(ValueError):
        repetitions(12, 6, 24, 0.99)


def test_long_passages_are_cut_into_segments(spark):
    rng = random.Random(9)
    long = [f"a{rng.random()}".replace(".", "") for _ in range(6000)]
    docs = [(i, " ".join(long[at : at + 30])) for i, at in enumerate(range(0, 5970, 7))]
    got = leaks(*frames(spark, docs, [(1, " ".join(long))]), "doc_id", "text", "item_id", "passage", 12, block_bytes=100_000).collect()
    assert len(got) == len(docs) and {r.windows for r in got} == {19}


def test_a_text_does_not_run_into_the_next():
    index = WindowIndex([(1, "a b c d e f")], 4, 1, 4, 30)
    assert len(index.search(["a b", "c d x y"])[0]) == 0 and set(index.search(["a b c", None, "c d q f"])[0].tolist()) == {0, 2}


def test_empty_tables_and_clashing_columns(spark):
    docs, items = frames(spark, [], [])
    assert leaks(docs, items, "doc_id", "text", "item_id", "passage").collect() == []
    p = " ".join(f"v{i}" for i in range(12))
    docs = spark.createDataFrame([(1, p, "q", 3)], "doc_id long, text string, passage string, item_id long")
    items = spark.createDataFrame([(7, p, "q")], "item_id long, passage string, text string")
    assert [tuple(r) for r in leaks(docs, items, "doc_id", "text", "item_id", "passage").collect()] == [(1, 7, 1)]
