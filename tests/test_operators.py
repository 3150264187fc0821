import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from filingloom.functions import text as T
from filingloom.functions.dictionary import INDUSTRIAL, tracked
from filingloom.operators import asof, chunks, history, keywords, metrics, pipeline, reports, retrieval, scores, sections, status, wordsets


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("  one   two  ", 2), ("a\xa0b\x1cc", 3)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.col("t")), text) == n


def test_text_functions(spark):
    assert one(spark, T.line_count(F.col("t")), "\n a\r\nb\n\nc \n") == 4
    assert one(spark, T.paragraphs(F.col("t")), "a\n \nb\n\n\n\n c ") == ["a", "b", "c"]
    assert one(spark, T.term_count(F.col("t"), "fine"), "Fine refine finefine") == 4
    assert one(spark, T.title_case(F.col("t")), "item_1a") == "Item 1A"
    assert one(spark, T.context_sentences(F.col("t"), ["debt"]), "We owe. Debt rose! No. Debt rose! debt? Debt fell.") == ["Debt rose!", "debt?", "Debt fell."]
    assert one(spark, T.clean_section(F.col("t")), " a\n\n\n\nb.\nApple Inc | 2024 Form 10-K | 12\nc|---|---|") == "a\n\nb.\nc"


def loop_chunks(paras, size, overlap, least):
    out, cur, wc = [], [], 0
    for p in paras:
        n = len(p.split())
        if wc + n > size and cur:
            out.append("\n\n".join(cur))
            last = cur[-1].split()
            cur = [cur[-1]] if len(last) <= overlap else [" ".join(last[-overlap:])]
            wc = len(cur[0].split())
        cur.append(p)
        wc += n
    return out + (["\n\n".join(cur)] if wc >= least and cur else [])


@pytest.mark.parametrize("sizes", [(50, 5, 10), (20, 10, 1), (8, 3, 8)])
def test_chunks_against_a_loop(spark, sizes):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        paras = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n\n".join(paras)))
    got = chunks.chunk_rows(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", *sizes).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.chunk_id)):
        by.setdefault(r.id, []).append(r.chunk)
    for i, t in rows:
        assert by.get(i, []) == loop_chunks([p for p in t.split("\n\n") if p], *sizes)


def loop_bounds(text, pattern):
    ms = list(re.finditer(pattern, text, re.I))
    start = next((m.start() for m in ms if len(text[m.end() : m.start() + 1000].strip()) > 200), None)
    if start is None:
        if len(ms) != 1:
            return None
        start = ms[0].start()
    rest = text[start + 1000 + 0 :]
    for m in re.finditer(r"(?:^|\n)\s*I[Tt][Ee][Mm]\s+\d+[A-Za-z]?\.", rest):
        if len(rest[m.start() : m.start() + 500].strip()) > 200:
            return start, start + 1000 + m.start()
    return start, min(len(text), start + 50_000)


def test_sections_against_a_loop(spark):
    rng = random.Random(3)
    heads = ["Item 1A. Risk Factors", "ITEM 7 - Management's Discussion and Analysis", "Item 8. Financial Statements", "Item 9. Controls"]
    rows = []
    for i in range(40):
        t = "Contents\n" + "\n".join(h for h in heads if rng.random() < 0.7) + "\n\n"
        for h in heads:
            if rng.random() < 0.85:
                t += "\n" * rng.randint(0, 3) + h + "\n\n" + " ".join("words" for _ in range(rng.choice([3, 60, 400, 900]))) + "\n"
        rows.append((i, t))
    got = {(r.id, r.section): (r.a, r.b) for r in sections.extract(spark.createDataFrame(rows, "id int, t string"), ["id"], "t").collect()}
    patterns = {k: p.replace("(?iU)", "") for k, p in sections.HEADINGS.items()}
    for i, t in rows:
        for s, p in patterns.items():
            assert got.get((i, s)) == loop_bounds(t, p), (i, s)
    wide = spark.createDataFrame([(1, "Item 7. Management Discussion of Results\n" + "words " * 300)], "id int, t string")
    assert sections.extract(wide, ["id"], "t").count() == 0 and sections.extract(wide, ["id"], "t", sections.WIDER_HEADINGS).count() == 1


def test_signals_and_replies(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.2, -0.2, -0.5, -0.51, None, float("nan"))], "x double")
    assert [r.s for r in df.select(scores.signal(F.col("x")).alias("s")).collect()] == ["STRONG_BUY", "BUY", "HOLD", "SELL", "STRONG_SELL", None, None]
    replies = ['```json\n{"outlook": "very_bullish", "confidence": "high"}\n```', '{"outlook": "bearish", "confidence": "x"}', '{"outlook": "neutral"}', "nonsense", None]
    got = [r.r.score for r in spark.createDataFrame([(x,) for x in replies], "t string").select(scores.reply_score(F.col("t")).alias("r")).collect()]
    assert got == [0.6, -0.16, 0.0, 0.0, 0.0]


def test_blend(spark):
    rows = [(0.28, -0.05, None), (0.5, None, None), (None, None, None), (2.0, 2.0, None)]
    got = scores.blend(spark.createDataFrame(rows, "a double, b double, c double"), {"a": 0.6, "b": 0.4, "c": 0.0}).collect()
    assert [None if r.score is None else round(r.score, 6) for r in got] == [0.148, 0.5, None, 1.0]
    assert [r.components_agree for r in got] == [False, True, None, True]


def test_keyword_history(spark):
    d = [dt.date(2020 + i, 1, 1) for i in range(5)]
    n = {"emerges": [0, 0, 0, 5, 5], "spikes": [1, 1, 1, 6, 3], "declines": [6, 6, 6, 2, 6], "vanishes": [6, 6, 6, 0, 0]}
    rows = [("T", day, g, "bear", c) for g, cs in n.items() for day, c in zip(d, cs)] + [("U", d[0], "x", "bull", 1)]
    df = spark.createDataFrame(rows, "ticker string, filing_date date, grp string, polarity string, n int")
    found = {(r.grp, r.filing_date.year): (r.type, r.severity) for r in keywords.anomalies(df, "ticker", "filing_date").collect()}
    assert found[("emerges", 2023)] == ("emergence", "high") and found[("spikes", 2023)] == ("spike", "high") and found[("declines", 2023)] == ("decline", "medium")
    assert not any(g == "vanishes" for g, _ in found)
    ahead = {r.grp: r.delta for r in keywords.deltas(df, "ticker", "filing_date").where("filing_date = '2020-01-01'").collect()}
    assert ahead["emerges"] == -1.0 and ahead["x"] is None
    assert len({g for g, _, _ in tracked()}) == 20 and keywords.sizes(tracked()) == {"bear": 13, "bull": 7} and INDUSTRIAL


def test_shift_keeps_plain_doubles(spark):
    rows = [("T", dt.date(2023, 1, 20), s, x) for s, x in (("item_1a", -0.1), ("item_7", 0.35), ("item_8", 0.1))] + [("T", dt.date(2024, 1, 15), s, x) for s, x in (("item_1a", -0.3), ("item_7", 0.5), ("item_8", 0.2))]
    rows += [("G", dt.date(2020 + i, 1, 1), "item_7" if i != 1 else "item_8", float(i)) for i in range(3)]
    got = history.shifts(spark.createDataFrame(rows, "ticker string, filing_date date, section string, score double"), "ticker", ["filing_date"]).collect()
    assert {(r.section, r.severity, r.direction) for r in got} == {("item_1a", "medium", "negative"), ("item_7", "medium", "positive")}


def test_year_over_year_trend_extremes(spark):
    rows = [("T", dt.date(2023, 2, 15), 0.15, 0.1, 0.25, None, 12000, "HOLD"), ("T", dt.date(2024, 2, 20), 0.28, 0.1, 0.35, 0.2, 13000, "BUY"), ("One", dt.date(2024, 1, 1), 0.1, None, None, None, 0, "HOLD")]
    df = spark.createDataFrame(rows, "ticker string, filing_date date, overall double, item_1a double, item_7 double, item_8 double, words int, signal string")
    (y,) = history.year_over_year(df, "ticker", "filing_date").collect()
    assert round(y.overall_delta, 9) == 0.13 and y.item_8_delta == 0.2 and y.signal_changed and y.words_delta == 1000
    t = {r.ticker: r.trend for r in history.trend(df, "ticker", "filing_date").collect()}
    assert t == {"T": "improving", "One": "stable"}
    e = {r.ticker: r for r in history.extremes(df, "ticker", "filing_date").collect()}
    assert round(e["T"]["mean"], 9) == 0.215 and e["T"].rise_date == dt.date(2024, 2, 20) and e["One"].rise is None
    w = {r.ticker: r.change_pct for r in history.word_change(df, ["ticker"], "filing_date").collect()}
    assert round(w["T"], 1) == 8.3 and w["One"] is None
    c = {r.ticker: r.filing_date.year for r in history.of_year_or_latest(df, "ticker", "filing_date", 2023).collect()}
    assert c == {"T": 2023, "One": 2024}


def test_asof_against_a_loop(spark):
    rng = random.Random(8)
    base = dt.date(2023, 1, 1)
    series = {(e, base + dt.timedelta(rng.randrange(500))): rng.random() for e in "abc" for _ in range(30)}
    targets = [(i, rng.choice(["a", "b", "c", "none", None]), base + dt.timedelta(rng.randrange(-30, 560)) if i % 9 else None) for i in range(300)]
    s = spark.createDataFrame([(e, d, v) for (e, d), v in series.items()], "ticker string, d date, close double")
    t = spark.createDataFrame(targets, "id int, ticker string, at date")
    for one_task in (1_000_000, 5):  # sorted in one task, and by months
        got = {r.id: (r.fd, r.fv) for r in asof.forward_asof(t, s, "ticker", "at", "d", "close", "fd", "fv", one_task=one_task).collect()}
        assert len(got) == 300
        for i, e, at in targets:
            later = sorted((d, v) for (x, d), v in series.items() if x == e and at is not None and d >= at)
            assert got[i] == (later[0] if later else (None, None)), (i, e, at)


BACKTEST = [("STRONG_BUY", 0.6, 15.2, "up"), ("BUY", 0.3, 8.1, "up"), ("BUY", 0.25, -5.3, "down"), ("HOLD", 0.05, 1.2, "flat"), ("SELL", -0.3, -12.0, "down"), ("STRONG_SELL", -0.55, 22.0, "up"), ("HOLD", 0.0, 3.5, "up")]


def test_metrics(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(BACKTEST + [("BUY", 0.3, None, "unknown")])], "signal string, score double, ret double, direction string, id int")
    m = metrics.summary(df).first()
    assert (m.total, m.scorable, m.hit_rate, m.directional_accuracy) == (8, 7, 4 / 7, 3 / 5)
    p = {r.signal: r.precision for r in metrics.precision_by_signal(df).collect()}
    assert p["STRONG_BUY"] == 1.0
    r = {r.signal: (round(r.avg_ret, 9), r.n) for r in metrics.return_by_signal(df).collect()}
    assert r["BUY"] == (1.4, 2)
    assert sum(x.n for x in metrics.confusion(df).collect()) == 7 and metrics.confusion(df).count() == 9
    assert [x.id for x in metrics.worst_misses(df, "id").collect()] == [5, 2]
    grid = metrics.threshold_grid(df).collect()
    assert len(grid) == 64 and metrics.first_best(metrics.threshold_grid(df)).count() == 1
    assert metrics.weight_cells(spark).count() == 171
    none = df.where("direction = 'unknown'")
    assert metrics.first_best(metrics.threshold_grid(none)).count() == 0 and metrics.summary(none).first().hit_rate == 0


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0, 0.1])], "id int, v array<float>")
    got = [(r.q_key, r.id) for r in retrieval.cosine_topk(v.where("id = 1"), v, "id", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 2), (1, 6)]
    q = spark.createDataFrame([(1, "net sales rose"), (2, ""), (3, None)], "q int, t string")
    d = spark.createDataFrame([(1, "Sales rose"), (2, "nothing"), (3, None)], "id int, text string")
    assert [(r.q_key, r.id, round(r.share, 3)) for r in retrieval.keyword_topk(q, d, "q", "t", "id", "text").collect()] == [(1, 1, 0.667)]
    assert one(spark, retrieval.expansions(F.col("t")), "revenue risk") == ["revenue risk", "sales risk", "top line risk"]
    assert [one(spark, retrieval.is_follow_up(F.col("t")), x) for x in ("Items", "what about x", "sales")] == [True, True, False]
    r = retrieval.rerank(spark.createDataFrame([(1, "a", "aa", 1), (1, "a", "b", 2)], "g int, q string, t string, id int"), "g", "q", "t", "id", lambda a, b: b.str.len().astype(float), 1)
    assert [x.id for x in r.collect()] == [1]
    assert retrieval.embed(d, "text", lambda ts: [[float(len(t))] for t in ts]).count() == 3


def test_status(spark):
    a = spark.createDataFrame([("T", 1, "x"), ("T", 2, "y"), (None, 3, "z")], "k string, v int, p string")
    assert {(r.k, r.v) for r in status.upsert(a, a.limit(0), ["k"], ["v"]).collect()} == {("T", 2), (None, 3)}
    assert status.not_done(a, spark.createDataFrame([("T",)], "k string"), ["k"]).count() == 1
    s = status.stage_status({"one": a.where("v = 1"), "two": a}, ["k"]).collect()
    assert {(r.k, r.has_one, r.has_two) for r in s} == {("T", True, True), (None, False, True)}
    listed = status.add_to_list(a.where("v = 1").select("k"), spark.createDataFrame([("T",), ("U",), ("U",)], "k string"), "k")
    assert sorted(r.k for r in listed.collect()) == ["T", "U"]
    assert status.remove_from_list(listed, listed.where("k = 'T'"), "k").count() == 1


def test_section_weight_grid_shares_weights_among_sections_present(spark):
    rows = [(0.3, None, None, "up"), (None, -0.3, None, "up"), (None, None, None, "up"), (0.3, 0.3, -0.3, "down"), (0.9, 0.9, 0.9, "flat")]
    df = spark.createDataFrame(rows, "a double, b double, c double, direction string")
    cells = {(r.w1, r.w2): (r.hits, r.total) for r in metrics.section_weight_grid(df, ["a", "b", "c"]).collect()}
    # one section alone has all the weight, whatever the cell; of three the last has .9, then .05
    assert len(cells) == 171 and cells[0.05, 0.05] == (2, 3) and cells[0.05, 0.9] == (1, 3)


def test_keyword_dispatch_by_history(spark):
    words = [("fall", "fall", "bear"), ("rise", "rise", "bull")]
    rows = [(t, dt.date(2020 + y, 1, 1), g, p, n) for t, years in (("A", 2), ("B", 3)) for y in range(years) for g, p, n in (("fall", "bear", 1), ("rise", "bull", 3 if y else 1))]
    df = keywords.deltas(spark.createDataFrame(rows, "ticker string, filing_date date, grp string, polarity string, n int"), "ticker", "filing_date")
    got = {(r.ticker, r.filing_date.year): (r.mode, r.score) for r in keywords.dispatched_score(df, ["ticker", "filing_date"], words).collect()}
    assert got["A", 2020] == ("absolute", 0.0) and got["A", 2021] == ("absolute", 0.25)
    assert got["B", 2020] == ("delta", -0.6) and len(got) == 5


def test_threshold_grid_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(round(rng.uniform(-0.6, 0.6), 2), rng.choice(["up", "down", "flat", "unknown"])) for _ in range(400)] + [(None, "up")]
    df = spark.createDataFrame([("HOLD", x, None, d) for x, d in rows], "signal string, score double, ret double, direction string")
    for r in metrics.threshold_grid(df).collect():
        sides = [(1 if x >= r.buy else -1, d) for x, d in rows if x is not None and d in ("up", "down") and (x >= r.buy or x < r.sell)]
        assert (r.hits, r.total) == (sum((s == 1) == (d == "up") for s, d in sides), len(sides))


def test_recommendations(spark):
    rows = [("HOLD" if i % 2 else "BUY", 0.3, 1.0, "up") for i in range(6)]
    df = spark.createDataFrame(rows, "signal string, score double, ret double, direction string")
    r = metrics.recommend(metrics.threshold_grid(df), "t", metrics.original_accuracy(df)).first()
    assert (r.data_points, r.accuracy, r.original, r.adopt) == (6, 1.0, 1.0, False)
    few = df.limit(4)
    r = metrics.recommend(metrics.threshold_grid(few), "t", metrics.original_accuracy(few)).first()
    assert (r.data_points, r.best_cell, r.improvement, r.adopt) == (4, None, None, False)


def test_positions_and_newest(spark):
    rows = [("T", dt.date(2020, 1 + i % 12, 1 + i // 12), i) for i in range(60)] + [("U", dt.date(2020, 1, 1), 99), (None, dt.date(2020, 1, 1), 98)]
    df = spark.createDataFrame(rows, "ticker string, d date, id int")
    at = {r.id: (r["at"], r.of) for r in history.positions(df, "ticker", "d", "id").collect()}
    order = sorted((d, i) for t, d, i in rows if t == "T")
    assert all(at[i] == (n, 60) for n, (_, i) in enumerate(order)) and at[99] == (0, 1) and 98 not in at
    got = {(r.ticker, r.nth): (r.id, r.of) for r in history.newest(df, "ticker", "d", "id", k=2).collect() if r.ticker}
    assert got == {("T", 1): (order[-1][1], 60), ("T", 2): (order[-2][1], 60), ("U", 1): (99, 1)}


def test_fallback_by_entity(spark):
    e = spark.createDataFrame([("A", 1)], "ticker string, x int")
    f = spark.createDataFrame([("A", 2), ("B", 3)], "ticker string, x int")
    assert {(r.ticker, r.x) for r in metrics.with_fallback(e, f, "ticker").collect()} == {("A", 1), ("B", 3)}


@pytest.mark.parametrize("rows", [1000, 2])
def test_searches_in_blocks(spark, rows):
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(40)], "id int, v array<double>, g int")
    q = v.where("id % 4 = 0")
    plain = lambda **k: {(r.q_key, r.id, r["rank"]) for r in retrieval.cosine_topk(q, v, "id", "v", 3, **k).collect()}
    want = set()
    data = [(r.id, r.v) for r in v.collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i, a in data:
        if i % 4 == 0:
            best = sorted(((-cos(a, b), j) for j, b in data if j != i and cos(a, b) > 0))[:3]
            want |= {(i, j, n) for n, (_, j) in enumerate(best, 1)}
    assert plain(rows=rows) == want
    d = spark.createDataFrame([(i, f"w{i % 5} w{i % 7}") for i in range(30)], "id int, t string")
    ask = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(6)], "q int, t string")
    found = retrieval.keyword_topk(ask, d, "q", "t", "id", "t", 2, rows=rows).collect()
    assert len(found) == 12 and all(r.share > 0 for r in found)


@pytest.mark.parametrize("kind, rows", [("int", 1000), ("string", 1000), ("int", 7)])
def test_vector_search_meets_pairs_in_batches(spark, monkeypatch, kind, rows):
    """To the last bit as over all pairs, without a join of them: ties, repeated keys, lengths, nulls, numbers that are none, and no query at all."""
    from filingloom.operators import nearest

    monkeypatch.setattr(nearest, "PAIRS", 50)
    monkeypatch.setattr(nearest, "LEAST", 2)
    rng, nan, far = random.Random(3), float("nan"), float("inf")
    vector = lambda i: [rng.choice([-1.0, 0.1, 0.3, 1.0, 2.0]) if i % 2 else rng.gauss(0, 1) for _ in range(3 + (i % 5 == 0))]
    data = [(i % 290, vector(i)) for i in range(300)] + [(None, [1.0, 1.0, 1.0]), (40, None), (44, []), (48, [1.0, None, 2.0]), (52, [0.0] * 3), (56, [nan, 1.0, 1.0]), (301, [far, 1.0, 1.0])]
    rng.shuffle(data)
    v = spark.createDataFrame(data, "id int, v array<float>").repartition(3).select(F.col("id").cast(kind), "v").cache()
    q = v.where("id % 4 = 0 or id is null")
    got = retrieval.cosine_topk(q, v, "id", "v", 4, rows=rows)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    share = retrieval.dot(F.col("a"), F.col("v")) / (retrieval.norm(F.col("a")) * retrieval.norm(F.col("v")))
    pairs = q.select(F.col("id").alias("q_key"), F.col("v").alias("a")).join(v, F.col("q_key") != F.col("id")).select("q_key", "id", share.alias("similarity")).where("similarity > 0")
    want = retrieval.top(pairs, "q_key", "similarity", "id", 4)
    assert got.dtypes == want.dtypes
    plain = lambda df: sorted((r.q_key, r["rank"], r.id, repr(r.similarity)) for r in df.collect())
    assert plain(want) and plain(got) == plain(want)
    assert retrieval.cosine_topk(q.limit(0), v, "id", "v").count() == retrieval.cosine_topk(q, v.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("rows", [1000, 7])
def test_keyword_search_looks_once_through_a_text(spark, rows):
    """As over all pairs, without a join of questions and texts: ties, unspaced texts, words of any length, wide spaces, repeated questions and keys."""
    rng = random.Random(9)
    parts = ["a", "ab", "note", "item", "é", "売上高", "1?", "$5", "section_dump", "zq", "İx", "the"]
    text = lambda n, sep: sep.join(rng.choice(parts) + rng.choice(["", "", "s", "A", ","]) for _ in range(rng.randrange(n)))
    texts = [(i % 290, text(12, rng.choice([" ", "", "|", "\u3000", "\n"]))) for i in range(300)] + [(None, "the note"), (999, None), (998, " ")]
    asked = [(i % 35, text(7, rng.choice([" ", "\u2003"]))) for i in range(40)] + [(99, None), (98, "  "), (97, "nowhere")]
    rng.shuffle(texts)
    d = spark.createDataFrame(texts, "id int, t string").repartition(3)
    q = spark.createDataFrame(asked, "q int, t string")
    got = retrieval.keyword_topk(q, d, "q", "t", "id", "t", 4, rows=rows)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    low = lambda df: [tuple(r) for r in df.select(df.columns[0], F.lower("t")).collect()]
    every = {}
    for k, w in low(q):
        w = set((w or "").split())
        every.setdefault(k, []).extend((-sum(x in t for x in w) / len(w), i is not None, i) for i, t in low(d) if w and t is not None and any(x in t for x in w))
    want = sorted((k, n, -s, i or -1) for k, hits in every.items() for n, (s, _, i) in enumerate(sorted(hits)[:4], 1))
    assert want and sorted((r.q_key, r["rank"], r.share, r.id or -1) for r in got.collect()) == want


def test_kinds_of_texts_are_met_in_rounds(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    sets = [(n, sorted(rng.sample(words, rng.randrange(1, 6)))) for n in range(50)]
    texts = [(i, " ".join(rng.sample(words, 9))) for i in range(200)] * 2
    rng.shuffle(texts)
    want = {n: sorted((-sum(x in t for x in w), i) for i, t in texts if any(x in t for x in w))[:3] for n, w in sets}
    for kinds, seen in ((4096, 500_000), (5, 3)):
        monkeypatch.setattr(wordsets, "KINDS", kinds)
        monkeypatch.setattr(wordsets, "SEEN", seen)
        best, found = wordsets.Best(sets, 3), wordsets.finder(w for _, ws in sets for w in ws)
        for i, t in texts:
            best.add(i, found(t))
        got = {}
        for n, i, hits in best.rows():
            got.setdefault(n, []).append((-hits, i))
        assert got == want


def test_answers(spark):
    ask = spark.createDataFrame([(1, "debt"), (2, "nothing"), (3, "broken")], "q int, question string")
    hits = spark.createDataFrame([(q, n, f"T 2024 s{n}", "text " * 200, 1.0 / n) for q in (1, 3) for n in (1, 2, 3, 4)], "q int, rank int, head string, text string, share double")
    run = lambda f: {r.q: r for r in retrieval.answers(ask, hits, "q", "question", F.col("head"), "text", "share", f).collect()}
    plain = run(None)
    assert (plain[2].answer, plain[2].method, plain[2].sources) == (retrieval.NOTHING, "nothing", [])
    assert plain[1].method == "excerpts" and plain[1].answer.count("**T 2024") == 3 and [s.score for s in plain[1].sources] == [1.0, 0.5, 0.3333, 0.25]
    told = run(lambda: lambda prompt: 1 / 0 if "broken" in prompt else prompt)
    assert told[1].method == "model" and told[1].answer.count("[T 2024") == 4 and told[3].method == "excerpts" and told[2].method == "nothing"
    turns = spark.createDataFrame([(1, 1, "user", "sales?"), (1, 2, "assistant", "Up."), (1, 3, "user", "and why"), (2, 1, "assistant", "Hello")], "c int, n int, role string, t string")
    grown = {(r.c, r.n): r.expanded for r in retrieval.with_history(turns, "c", "n", "t", "role").collect()}
    assert grown[1, 3] == "sales? and why" and {r.c: r.history for r in retrieval.history_window(turns, "c", "n", "t", 2, role="role").collect()} == {1: "Assistant: Up.\nUser: and why", 2: "Assistant: Hello"}


def test_signals_of_keywords(spark):
    rows = [("T", dt.date(2024, 1, 1), f"g{i}", "bear" if i % 2 else "bull", d) for i, d in enumerate([0.6, -0.9, 3.0, 0.1, -0.2, 5.0, None, -0.35])]
    got = keywords.delta_signals(spark.createDataFrame(rows, "ticker string, d date, grp string, polarity string, delta double"), ["ticker", "d"], 4).orderBy("rank").collect()
    assert [(r.grp, r.type) for r in got] == [("g5", "risk_increase"), ("g2", "opportunity_increase"), ("g1", "risk_decrease"), ("g0", "opportunity_increase")]


def test_pipeline_status(spark):
    d = dt.date(2024, 1, 1)
    key = lambda *rows: spark.createDataFrame([(t, d) for t in rows], "t string, d date")
    f = spark.createDataFrame([("a", d, "x"), ("b", d, "x"), ("c", d, None), ("e", d, "x")], "t string, d date, text string")
    got = {r.t: r for r in pipeline.filing_status(f, "text", key("a", "b", "c"), key("a", "b", "c"), key("a"), ["t", "d"]).collect()}
    assert got["a"].message == "Completed: parse, sections, sentiment, ensemble" and got["b"].success and got["b"].message == "Completed: parse, sections, sentiment"
    assert got["c"].message == "Pipeline failed at parsing" and not got["c"].success and got["e"].message == "Completed: parse"
    (c,) = pipeline.company_status(spark.createDataFrame([(1, True), (1, False)], "t int, success boolean"), "t").collect()
    assert (c.processed, c.failed, c.total, c.success, c.message) == (1, 1, 2, True, "Processed 1/2 filings")


def test_reports(spark):
    df = spark.createDataFrame([(*r, i, "a" if i % 2 else "b") for i, r in enumerate(BACKTEST)], "signal string, score double, ret double, direction string, id int, mode string")
    text = reports.backtest_report(df, "id", "BACKTEST", {"Tickers": "AB"})
    assert "Directional accuracy:   60.0%" in text and "STRONG_BUY" in text and "WORST MISSES" in text and "  5: signal STRONG_SELL" in text
    assert "WORST MISSES" not in reports.backtest_report(df.where("direction = 'flat'"), "id", "BACKTEST", {})
    assert "Winner: b" in reports.comparison_report(df, "mode", "MODELS") and "N/A" in reports.comparison_report(df.limit(1), "mode", "MODELS")


def test_display_and_numbers(spark):
    df = spark.createDataFrame([(1, "supply_chain", "", "high", ["x" * 401, None, "b", "c", "d"]), (2, None, "new_keyword", None, None)], "id int, keyword string, type string, severity string, contexts array<string>")
    a, b = history.shown(df).orderBy("id").collect()
    assert (a.title, a.category, a.severity_reason, a.contexts) == ("Supply Chain", "General", "Severity: high", ["x" * 400 + "...", "b", "c"])
    assert (b.title, b.category, b.severity, b.contexts) == ("Anomaly Detected", "New Keyword", "medium", [])
    n = spark.createDataFrame([(0.1234, "000320"), (None, "000")], "x double, t string").select(T.signed(F.col("x")).alias("a"), T.per_cent(F.col("x")).alias("b"), T.without_zeros(F.col("t")).alias("c"), T.stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("d")).collect()
    assert [tuple(r) for r in n] == [("+0.123", "12.3%", "320", "20240102_030405"), ("N/A", "N/A", "0", "20240102_030405")]


def test_settings_and_shell(spark, tmp_path, capsys):
    from filingloom import __main__ as shell
    from filingloom.settings import Settings

    assert Settings(checkpoint_dir="/x").problems() == [] and len(Settings(section_weights={"a": 0.5}, chunk_overlap=900).problems()) == 3
    assert shell.main(["list"]) == 0 and "signal_hist" in capsys.readouterr().out
    assert shell.main(["run", "nope", "/x"], spark) == 2


def test_lookup_prefers_details(spark):
    f = spark.createDataFrame([(1, " ab "), (2, "CD"), (3, "XX"), (4, None)], "id int, ticker string")
    details, cached = spark.createDataFrame([("AB", "Able")], "ticker string, company_name string"), spark.createDataFrame([("AB", "able"), ("cd", "Cold")], "ticker string, company_name string")
    assert {r.id: r.company_name for r in retrieval.company_lookup(f, "ticker", details, cached).collect()} == {1: "Able", 2: "Cold", 3: None, 4: None}


@pytest.mark.parametrize("probes, least", [(24, 1.0), (8, 0.9)])
def test_approximate_search_against_brute_force(spark, probes, least):
    from filingloom.operators import ann

    rng = random.Random(9)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [m + rng.gauss(0, 0.6) for m in middles[0 if i % 3 == 0 else i % 30]]) for i in range(1500)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (0, rows[0][1])]
    v = spark.createDataFrame(rows, "id int, v array<double>")
    q = v.where("id % 50 = 0")
    exact = retrieval.cosine_topk(q.where("id < 5000").dropDuplicates(["id"]), v.where("id < 5000"), "id", "v", 5)
    found = ann.ann_topk(q.dropDuplicates(["id"]), v, "id", "v", 5, probes=probes, clusters=24)
    assert ann.recall(found, exact, "id") >= least
    assert ann.ann_topk(q, v.where("id > 4999"), "id", "v").count() == 0
