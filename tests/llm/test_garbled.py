import random

import pytest

from filingloom.llm import garbled as g

GOOD = "piñata Brümelle Straße façade résumé Þórvik Ørsund naïve coöp Müllerau “adjusted” company’s £ ½ • à São Zürnau crème".split()
RUSSIAN = "Кроме того выручка сегмента увеличилась после роста тарифов прибыль сократилась".split()
DECOYS = ["├── │ └── Θ ≈ αβγ", "NÃO SÃO SITUAÇÃO Âge ÂME", "\\u00e9 &eacute; %C3%A9", "Δπ сектор 東部 مبيعات दर 📈", "ﬁnance Ⅷ cöordinate", "a b\xa0c​ d"]


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        words = rng.choices(RUSSIAN, k=12) if i % 5 == 0 else ["plain", "words", "of", "a", "filing"] * 3 + rng.choices(GOOD, k=3)
        if i % 7 == 0:
            words += DECOYS[i % len(DECOYS)].split(" ")
        rng.shuffle(words)
        rows.append([i, " ".join(words), rng.choice(["a", "b", None])])
    cases = {}

    def garble(i, encode, decode, times=1, errors="strict"):
        t = rows[i][1]
        for _ in range(times):
            t = "".join(c if c < "\x80" else _try(c, encode, decode, errors) for c in t)
        if t != rows[i][1]:
            cases[i], rows[i][1] = rows[i][1], t

    for i in range(1, 900, 30):
        garble(i, "utf-8", "cp1252")
    for i in range(2, 900, 60):
        garble(i, "utf-8", "latin-1", 2)
    for i in range(4, 900, 60):
        garble(i, "utf-8", "mac_roman")
    for i in range(6, 900, 60):
        garble(i, "cp1252", "cp437")
    for i in range(5, 900, 100):
        garble(i, "koi8_r", "cp1251")
    lost = 7
    rows[lost][1] = rows[lost][1].replace("plain", "pl" + g.LOST + "in", 1)
    return rows, cases, lost


def _try(c, encode, decode, errors):
    try:
        return c.encode(encode).decode(decode)
    except UnicodeError:
        return c


@pytest.fixture(scope="module")
def result(spark):
    rows, cases, lost = corpus()
    extra = [(2000, None, "a"), (2001, "", "a"), (2002, " \t ", "a"), (None, "Ã©", "a"), (2003, "x" * 200000, "a"), tuple(rows[1])]
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, *extra]], "doc_id long, text string, source string, chain string")
    return rows, cases, lost, g.repaired(df, "doc_id", "text", "source").collect()


def test_found(result):
    rows, cases, lost, got = result
    found = {r.doc_id for r in got}
    want = set(cases) | {lost}
    assert len(found & want) >= 0.97 * len(want), sorted(want - found)
    assert len(found - want) <= 2, [rows[i] for i in found - want]


def test_repaired(result):
    rows, cases, lost, got = result
    by = {r.doc_id: r for r in got}
    right = [by[i].repaired == t for i, t in cases.items() if i in by]
    assert sum(right) >= 0.9 * len(right)
    assert not by[lost].complete and all(r.posterior > 0.5 for r in got)


def test_undo():
    for encoding in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250"):
        undo = dict(g.chains())[f"utf-8 as {encoding}"]
        for word in ("naïve", "Ørsund", "“x”"):
            try:
                bad = word.encode("utf-8").decode(encoding)
            except UnicodeDecodeError:
                continue
            assert undo(bad) == word
    once = "é".encode().decode("cp1252")
    assert dict(g.chains())["utf-8 as cp1252"](once.encode().decode("cp1252")) == "é"
    assert dict(g.chains())["utf-8 as gbk"]("companyâ".replace("â", "’s".encode().decode("gbk"))) == "company’s"
    assert dict(g.chains())["utf-8 as gbk"](g.LOST) is None


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert g.repaired(df, "doc_id", "text", "source").collect() == []


def test_pairs_are_whole_or_refused(spark, monkeypatch):
    texts = spark.createDataFrame([("façade naïve Ørsund",), ("façade сектор",)], "t string")
    whole = g.count_pairs(texts)
    monkeypatch.setattr(g, "MOST_PAIRS", len(whole))
    assert whole["fa"] == 2 and g.count_pairs(texts) == whole
    monkeypatch.setattr(g, "MOST_PAIRS", len(whole) - 1)
    with pytest.raises(ValueError):
        g.count_pairs(texts)


@pytest.mark.parametrize("times", [1, 2, 6, 9])
@pytest.mark.parametrize("encoding", ["cp1252", "mac_roman", "cp437"])
def test_undone_however_often(times, encoding):
    undo = dict(g.chains())[f"utf-8 as {encoding}"]
    word = "r\xe9sum\xe9"
    for _ in range(times):
        word = word.encode("utf-8").decode(encoding)
    assert undo(word) == "r\xe9sum\xe9"


@pytest.mark.parametrize("cells", [2, 20])
def test_columns_are_words_of_their_own_whatever_their_number(cells):
    assert g._foreign("|".join(["cr\xe8me", "plain"] * cells)) == g._foreign(" ".join(["cr\xe8me", "plain"] * cells))
    # the second half of a character of Shift JIS
    garbled_word = "\u30dd".encode("cp932").decode("cp1252")
    assert g._foreign(garbled_word) == [garbled_word] and "|" in garbled_word


def test_em_settles_or_is_an_error(spark, monkeypatch):
    rows, _, _ = corpus()
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, source string")
    loose = {r.k for r in g.garbled(df, "doc_id", "text", "source", tolerance=1e-2)[0].collect()}
    tight = {r.k for r in g.garbled(df, "doc_id", "text", "source", tolerance=1e-5)[0].collect()}
    assert loose == tight
    monkeypatch.setattr(g, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        g.garbled(df, "doc_id", "text", "source", tolerance=1e-9)
