import random

import numpy as np
import pytest

from filingloom.llm import spans
from filingloom.llm.spans import shared_spans, sliding_minimum


def brute(rows, length):
    texts = {r: t for r, t in rows if r is not None and t is not None}
    seen = {}
    for r, t in texts.items():
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], set()).add(r)
    out = set()
    for r, t in texts.items():
        run = None
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                if run and p <= run[1]:
                    run = (run[0], p + length)
                else:
                    out |= {(r, *run)} if run else set()
                    run = (p, p + length)
        out |= {(r, *run)} if run else set()
    return out


def got(spark, rows, length):
    found = [tuple(r) for r in shared_spans(spark.createDataFrame(rows, "rec long, t string"), length).collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_rows(seed, n=40):
    rng = random.Random(seed)
    letters = "ab \n.é漢" + chr(0x1F4C8)
    passages = ["".join(rng.choices(letters, k=rng.randint(90, 400))) for _ in range(8)] + ["-" * 300, "ab" * 200]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            t += "".join(rng.choices(letters, k=rng.randint(0, 60))) + (p if rng.random() < 0.5 else p[a:b])
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed, large", [(1, False), (2, False), (3, True)])
def test_against_brute_force(spark, monkeypatch, seed, large):
    if large:
        monkeypatch.setattr(spans, "GROUP_UNITS", 3)
    rows = random_rows(seed) + [(90, None), (91, ""), (92, "short"), (None, "-" * 300)]
    rows += rows[:3]  # repeated rows are one record
    assert got(spark, rows, 120) == brute(rows, 120) != set()


def test_text_beyond_a_block(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=1_200_000))
    at = spans.BLOCK - 400
    rows = [(1, long), (2, "x" + long[at : at + 900] + "y"), (3, long[:300])]
    assert got(spark, rows, 300) == {(1, at, at + 900), (2, 1, 901), (1, 0, 300), (3, 0, 300)}


def test_nothing_shared(spark):
    assert got(spark, [], 300) == set()
    assert got(spark, [(1, "a" * 5000), (1, "a" * 5000)], 300) == set()
    assert got(spark, [(1, "a" * 299), (2, "a" * 299)], 300) == set()
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame([], "rec long, t string"), 80)


def test_hot_passage(spark):
    rng = random.Random(5)
    p = "".join(rng.choices("abcdef ", k=500))
    rows = [(i, "".join(rng.choices("uvwxyz", k=i % 50)) + p) for i in range(200)]
    assert got(spark, rows, 300) == {(i, i % 50, i % 50 + 500) for i in range(200)} or got(spark, rows, 300) == brute(rows, 300)


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 997).astype(np.uint64)
    for w in (1, 2, 50, 996, 997):
        assert (sliding_minimum(x, w) == np.lib.stride_tricks.sliding_window_view(x, w).min(axis=1)).all()
