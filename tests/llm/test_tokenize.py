import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from filingloom.llm.tokenize import DEFAULT_VOCABULARY, PRE_TOKEN, TrieEncoder, decode, encode_corpus, encoder


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    offsets, flat = encoder(DEFAULT_VOCABULARY).encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab -1\n 'st漢é", max_size=80))
def test_equals_plain_bpe_and_round_trips(text):
    ranks = encoder(DEFAULT_VOCABULARY).ranks
    enc = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    (ids,) = encode([text])
    assert ids == enc.encode_ordinary(text)
    assert decode(ids) == text


def test_long_and_special(plain):
    texts = ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "é" * 900, "", None, "-" * 2001]
    assert encode(texts) == [plain.encode_ordinary(t) if t else [] for t in texts]


def test_shared_prefixes_are_encoded_once():
    e = TrieEncoder(DEFAULT_VOCABULARY)
    e.learn({"restructure", "restructured", "restructuring", "rest"})
    assert {w: b"".join(next(k for k, v in e.ranks.items() if v == i) for i in ids).decode() for w, ids in e._words.items()} == {w: w for w in e._words}


def test_rows(spark):
    rows = [(1, "Net sales rose.", "x"), (2, None, "y"), (3, "", "z"), (1, "Net sales rose.", "x"), (None, "a", None)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    found = sorted(((r.doc_id, r.ids) for r in got.collect()), key=str)
    assert len(found) == 5 and [i for k, i in found if k in (2, 3)] == [[], []]
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
