import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingloom.llm.split import split_oversized, split_text

GAPS = [" ", " ", "\n", "\n\n", "\r\n \r\n", ". ", " ", ".\n\nItem 7. ", "　", "\x1f"]


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    whole, before = "", None
    for start, end, n, shared, _ in pieces:
        piece = text[start:end]
        real = _words(piece)
        assert len(real) == n <= limit or len(pieces) == 1
        if before is not None:
            assert shared == min(overlap, len(before)) and real[:shared] == before[-overlap:] if overlap else shared == 0
            assert n > shared
            # what comes after the overlap continues the text
        whole += text[len(whole) : end]
        before = real
    assert whole == text and pieces[0][0] == 0
    return pieces


def _words(t):
    out, cur = [], ""
    for c in t:
        if c.isspace() and not "\x1c" <= c <= "\x1f":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] * bool(cur)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 400), st.integers(0, 10**6), st.sampled_from([(20, 5), (50, 0), (7, 6), (100, 10)]))
def test_pieces(n, seed, sizes):
    rng = random.Random(seed)
    text = rng.choice(["", "\n ", "# "]) + "".join(f"w{i}" + rng.choice(GAPS) for i in range(n))
    pieces = check(text, *sizes)
    assert (len(pieces) > 1) == (len(_words(text)) > sizes[0])


def test_natural_boundaries_and_balance():
    text = "\n\n".join("Alpha beta gamma delta epsilon zeta. " * 20 for _ in range(10))
    pieces = check(text, 1000, 50)
    assert [p[4] for p in pieces] == ["paragraph", "end"]
    assert abs(pieces[0][2] - pieces[1][2]) < 200


def test_rows(spark):
    big = " ".join(["word"] * 1001)
    rows = [(1, big, "a"), (2, " ".join(["word"] * 1000), "b"), (3, None, "c"), (4, "", "d"), (5, "x" * 9000, "e"), (1, big, "a"), (None, big, "f")]
    got = split_oversized(spark.createDataFrame(rows, "id long, t string, piece string"), "id", "t").collect()
    assert sorted((str(r.id), r.piece) for r in got) == [("1", 0), ("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert all(r.words <= 1000 and r.text for r in got)
    assert split_oversized(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "id long, t string"), "id", "t", 10, 10)
