"""Keyword scores over the tracked dictionary, their blend with recorded sentiment, and outcomes of both by ticker.

The recorded sentiment of a filing is ``overall.compound`` of the newest sentiment record of its ticker and date. There are no
prices among the test tables: the series of a ticker is the length of its filings, day by day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.functions.dictionary import tracked
from filingloom.operators import asof, history, keywords, metrics, pipeline, scores
from filingloom.plans.analytics import _ANOM, _FZ, _KEYED, _SC, _SEC, _SIGNAL, _SUMMARY, _anomalies, _dated, _filings, _known, _scored, query, r6
from filingloom.sources.tables import table, written

_TRACKED = tracked()
_N = keywords.sizes(_TRACKED)

# ---- keywords over the tracked dictionary ----------------------------------------------------------------------

_TK = f"""tt(grp, term, polarity) AS (VALUES {", ".join(f"('{g}', '{t.lower()}', '{p}')" for g, t, p in _TRACKED)}), {_SEC},
tk AS (SELECT ticker, filing_date, grp, polarity, sum((length(lower(t)) - length(replace(lower(t), term, ''))) // length(term))::BIGINT AS n FROM sec, tt WHERE {_KEYED} GROUP BY ALL),
ab AS (SELECT ticker, filing_date, sum(n) FILTER (WHERE polarity = 'bear')::BIGINT AS bear, sum(n) FILTER (WHERE polarity = 'bull')::BIGINT AS bull,
  count(*) FILTER (WHERE polarity = 'bear' AND n > 0) AS bear_active, count(*) FILTER (WHERE polarity = 'bull' AND n > 0) AS bull_active FROM tk GROUP BY ALL),
absol AS (SELECT *, greatest(-1.0, least(1.0, coalesce(CASE WHEN bear + bull > 0 THEN 0.5 * (bull / {_N["bull"]}.0 - bear / {_N["bear"]}.0) / (bull / {_N["bull"]}.0 + bear / {_N["bear"]}.0) END, 0.0)))::DOUBLE AS absolute FROM ab),
h AS (SELECT *, count(*) OVER w - 1 AS history, (sum(n) OVER w - n) / nullif(count(*) OVER w - 1, 0)::DOUBLE AS mean FROM tk WINDOW w AS (PARTITION BY ticker, grp)),
dl AS (SELECT *, CASE WHEN mean = 0 AND n > 0 THEN 1.0 WHEN mean > 0 THEN (n - mean) / mean END AS delta FROM h),
pu AS (SELECT *, CASE WHEN delta > 0.5 THEN least(delta, 3.0) WHEN delta < -0.3 THEN -least(abs(delta), 2.0) ELSE 0.0 END AS push FROM dl),
ds AS (SELECT ticker, filing_date, max(history) AS history, sum(CASE WHEN polarity = 'bear' AND push > 0 THEN push WHEN polarity = 'bull' AND push < 0 THEN -push ELSE 0 END)::DOUBLE AS down,
  sum(CASE WHEN polarity = 'bull' AND push > 0 THEN push WHEN polarity = 'bear' AND push < 0 THEN -push ELSE 0 END)::DOUBLE AS up FROM pu GROUP BY ALL),
disp AS (SELECT ticker, filing_date, history, CASE WHEN history >= 2 THEN 'delta' ELSE 'absolute' END AS mode, round(CASE WHEN history >= 2 THEN coalesce(CASE WHEN up + down <> 0 THEN 0.6 * (up - down) / (up + down) END, 0) ELSE absolute END, 4) AS score FROM ds JOIN absol USING (ticker, filing_date))"""


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return _known(_dated(s, d, _TRACKED))


def _dispatched(s: SparkSession, d: str) -> DataFrame:
    """Keyword score of each ticker and date, to four places as the blend takes it."""
    found = keywords.dispatched_score(keywords.deltas(_mentions(s, d), "ticker", "filing_date"), ["ticker", "filing_date"], _TRACKED)
    return found.withColumn("score", F.round("score", 4))


@query(f"WITH {_TK} SELECT ticker, filing_date, bear AS bear_mentions, bull AS bull_mentions, bear_active, bull_active, round(absolute, 6) AS score FROM absol")
def kw_absolute(s: SparkSession, d: str) -> DataFrame:
    """Mentions and active groups of each polarity for each ticker and date, and the score without history."""
    of = lambda p: F.sum(F.when(F.col("polarity") == p, F.col("n")))
    active = lambda p: F.count_if((F.col("polarity") == p) & (F.col("n") > 0))
    c = _mentions(s, d).groupBy("ticker", "filing_date").agg(of("bear").alias("bear_mentions"), of("bull").alias("bull_mentions"), active("bear").alias("bear_active"), active("bull").alias("bull_active"))
    return r6(c.withColumn("score", keywords.absolute_score(F.col("bear_mentions"), F.col("bull_mentions"), _TRACKED)))


@query(f"WITH {_TK} SELECT ticker, filing_date, history, mode, score + 0.0 AS score FROM disp")
def kw_dispatch(s: SparkSession, d: str) -> DataFrame:
    """Keyword score of each ticker and date: by change from two other dates on, else absolute."""
    return r6(_dispatched(s, d))


@query(f"""WITH {_TK}, sg AS (SELECT ticker, filing_date, grp, CASE polarity WHEN 'bear' THEN 'risk' ELSE 'opportunity' END || CASE WHEN delta > 0.5 THEN '_increase' ELSE '_decrease' END AS type, round(delta, 6) AS delta
  FROM dl WHERE (delta > 0.5 OR delta < -0.3) AND history >= 2)
SELECT ticker, filing_date, grp, type, delta + 0.0 AS delta, row_number() OVER (PARTITION BY ticker, filing_date ORDER BY abs(delta) DESC, grp) AS rank FROM sg
QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY abs(delta) DESC, grp) <= 5""")
def kw_signals(s: SparkSession, d: str) -> DataFrame:
    """The five groups that moved most for each ticker and date with a history."""
    moved = keywords.deltas(_mentions(s, d), "ticker", "filing_date").where("history >= 2")
    return r6(keywords.delta_signals(moved, ["ticker", "filing_date"]))


# ---- recorded sentiment and the blend -----------------------------------------------------------------------------

_SENT = f"""p0 AS (SELECT upper(trim(ticker)) AS ticker, filing_date, loaded_at, record_id, ltrim(payload, chr(65279)) AS p FROM raw_records WHERE stage = 'sentiment' AND payload IS NOT NULL),
p1 AS (SELECT * REPLACE (CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN ltrim(p::JSON ->> '$', chr(65279)) ELSE p END AS p) FROM p0),
se AS (SELECT ticker, filing_date, try_cast(p ->> '$.overall.compound' AS DOUBLE) AS score, loaded_at, record_id FROM p1 WHERE json_valid(p) AND {_KEYED}),
sent AS (SELECT ticker, filing_date, arg_max(score, (loaded_at, record_id)) AS finbert FROM se WHERE score IS NOT NULL GROUP BY ALL)"""
_BLEND = f"""{_TK}, {_SENT}, bl AS (SELECT ticker, filing_date, finbert, score AS keywords FROM sent LEFT JOIN disp USING (ticker, filing_date)),
en AS (SELECT *, CASE WHEN keywords IS NULL THEN greatest(-1.0, least(1.0, finbert)) ELSE 0.6 * greatest(-1.0, least(1.0, finbert)) END AS finbert_part, 0.4 * keywords AS keywords_part,
  (keywords IS NULL OR (finbert > 0 AND keywords > 0) OR (finbert < 0 AND keywords < 0) OR (finbert = 0 AND keywords = 0)) AS components_agree FROM bl),
ez AS (SELECT *, greatest(-1.0, least(1.0, finbert_part + coalesce(keywords_part, 0))) AS score FROM en)"""


def _record(payload: Column) -> Column:
    """The record of a payload as a variant; null where there is none."""
    bom = chr(0xFEFF)
    value = F.try_parse_json(F.regexp_replace(payload, f"^{bom}", ""))
    return F.try_parse_json(F.regexp_replace(F.try_variant_get(value, "$", "string"), f"^{bom}", ""))


def _sentiment(s: SparkSession, d: str) -> DataFrame:
    """``(ticker, filing_date, finbert)``: recorded sentiment, the newest record of each ticker and date that has one."""
    raw = table(s, d, "raw_records", "record_id", "ticker", "filing_date", "loaded_at", "stage", "payload").where("stage = 'sentiment'")
    rows = raw.select(F.upper(F.trim("ticker")).alias("ticker"), "filing_date", "loaded_at", "record_id", F.try_variant_get(_record(F.col("payload")), "$.overall.compound", "double").alias("finbert"))
    return _known(rows.where("finbert is not null")).groupBy("ticker", "filing_date").agg(F.max_by("finbert", F.struct("loaded_at", "record_id")).alias("finbert"))


def _blended(s: SparkSession, d: str) -> DataFrame:
    kw = _dispatched(s, d).select("ticker", "filing_date", F.col("score").alias("keywords"))
    return scores.blend(_sentiment(s, d).join(kw, ["ticker", "filing_date"], "left"), {"finbert": 0.6, "keywords": 0.4})


@query(f"WITH {_BLEND} SELECT ticker, filing_date, round(finbert, 6) AS finbert, round(keywords, 6) AS keywords, round(finbert_part, 6) AS finbert_part, round(keywords_part, 6) AS keywords_part, round(score, 6) AS score, components_agree, {_SIGNAL('score')} AS signal FROM ez")
def ensemble(s: SparkSession, d: str) -> DataFrame:
    """Recorded sentiment and keyword score of each filing blended, weights shared out anew where there is no keyword score."""
    return r6(_blended(s, d).withColumn("signal", scores.signal(F.col("score"))))


@query(f"WITH {_BLEND} SELECT ticker, filing_date, 'finbert' AS component, round(finbert_part, 6) AS part FROM ez UNION ALL SELECT ticker, filing_date, 'keywords', round(keywords_part, 6) FROM ez")
def contributions(s: SparkSession, d: str) -> DataFrame:
    """What each component adds to the blend."""
    return r6(_blended(s, d).select("ticker", "filing_date", F.expr("stack(2, 'finbert', finbert_part, 'keywords', keywords_part) as (component, part)")))


@query(f"WITH {_BLEND} SELECT s.ticker, s.filing_date, {_SIGNAL('s.finbert')} AS signal, {_SIGNAL('z.score')} AS blended, {_SIGNAL('s.finbert')} IS DISTINCT FROM {_SIGNAL('z.score')} AS differs FROM sent s LEFT JOIN ez z ON z.ticker = s.ticker AND z.filing_date = s.filing_date AND z.keywords IS NOT NULL")
def signal_vs_blend(s: SparkSession, d: str) -> DataFrame:
    """The signal of every recorded sentiment beside the blended one, where both components are there."""
    e = _blended(s, d).where("keywords is not null").select("ticker", "filing_date", scores.signal(F.col("score")).alias("blended"))
    own = _sentiment(s, d).select("ticker", "filing_date", scores.signal(F.col("finbert")).alias("signal"))
    return own.join(e, ["ticker", "filing_date"], "left").withColumn("differs", ~F.col("signal").eqNullSafe(F.col("blended")))


_YB = f"""{_BLEND}, y0 AS (SELECT ticker, filing_date, finbert, CASE WHEN keywords IS NOT NULL THEN score END AS blended FROM ez),
y1 AS (SELECT *, lag(finbert) OVER w AS f0, lag(blended) OVER w AS b0, row_number() OVER w AS n FROM y0 WINDOW w AS (PARTITION BY ticker ORDER BY filing_date))"""


@query(f"WITH {_YB} SELECT ticker, filing_date, round(finbert - f0, 6) AS overall_delta, round(blended - b0, 6) AS blended_delta, {_SIGNAL('finbert')} <> {_SIGNAL('f0')} AS signal_changed FROM y1 WHERE n > 1")
def yoy_blended(s: SparkSession, d: str) -> DataFrame:
    """Recorded sentiment and blend of each filing against the ticker's filing before, the blend only where both have one."""
    f = _blended(s, d).select("ticker", "filing_date", F.col("finbert").alias("overall"), F.when(F.col("keywords").isNotNull(), F.col("score")).alias("blended"), *[F.lit(None).cast("double").alias(x) for x in history.SECTIONS], F.lit(0).alias("words"))
    y = history.year_over_year(f.withColumn("signal", scores.signal(F.col("overall"))), "ticker", "filing_date", blended="blended")
    return r6(y.select("ticker", "filing_date", "overall_delta", "blended_delta", "signal_changed"))


# ---- histories ----------------------------------------------------------------------------------------------------


@query(f"WITH {_FZ} SELECT ticker, filing_id, filing_date, round(overall, 6) AS overall, signal, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY ticker) AS of FROM fz WINDOW w AS (PARTITION BY ticker ORDER BY filing_date, filing_id)")
def score_history(s: SparkSession, d: str) -> DataFrame:
    """Every ticker's results in order of their dates."""
    return r6(history.positions(_known(_filings(s, d)).select("ticker", "filing_id", "filing_date", "overall", "signal"), "ticker", "filing_date", "filing_id"))


@query(f"""WITH {_SC}, s1 AS (SELECT ticker, section, filing_date, avg(score) AS score FROM sc WHERE {_KEYED} GROUP BY ALL)
SELECT ticker, section, filing_date, round(score, 6) AS score, {_SIGNAL('round(score, 9)')} AS signal, round(score - lag(score) OVER (PARTITION BY ticker, section ORDER BY filing_date), 6) AS change FROM s1""")
def section_history(s: SparkSession, d: str) -> DataFrame:
    """Each section of a ticker date by date, with the change from the date before that has the section."""
    rows = _known(_scored(s, d)).groupBy("ticker", "section", "filing_date").agg(F.avg("score").alias("score"))
    run = F.concat_ws("\x1f", "ticker", "section")
    out = history.previous_in(rows.withColumn("_run", run).withColumnRenamed("_run", "run"), "run", ["filing_date"], F.col("score"), "before")
    return r6(out.select("ticker", "section", "filing_date", "score", scores.signal(F.round("score", 9)).alias("signal"), (F.col("score") - F.col("before")).alias("change")))


_SHIFTED = f"""{_ANOM}, scx AS (SELECT s.section_id, s.filing_id, s.ticker, s.filing_date, s.section, greatest(-1.0, least(1.0, coalesce(CASE WHEN u + v > 0 THEN 0.5 * (u - v) / (u + v) END, 0.0)))::DOUBLE AS score FROM (
  SELECT section_id, filing_id, ticker, filing_date, section, sum(n) FILTER (WHERE polarity = 'bear') / (SELECT count(DISTINCT grp) FROM terms WHERE polarity = 'bear')::DOUBLE AS v, sum(n) FILTER (WHERE polarity = 'bull') / (SELECT count(DISTINCT grp) FROM terms WHERE polarity = 'bull')::DOUBLE AS u FROM kw GROUP BY ALL) s),
s1 AS (SELECT ticker, filing_date, section, avg(score) AS score FROM scx WHERE {_KEYED} GROUP BY ALL),
no AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date) AS no FROM (SELECT DISTINCT ticker, filing_date FROM s1)),
sh AS (SELECT a.ticker, a.filing_date, a.section, a.score - b.score AS delta FROM (SELECT * FROM s1 JOIN no USING (ticker, filing_date)) a JOIN (SELECT * FROM s1 JOIN no USING (ticker, filing_date)) b ON a.ticker = b.ticker AND a.section = b.section AND a.no = b.no + 1),
al AS (SELECT ticker, filing_date, 0 AS source, section AS subject, 'sentiment_shift' AS type, CASE WHEN abs(round(delta, 9)) >= 0.3 THEN 'high' ELSE 'medium' END AS severity FROM sh WHERE abs(round(delta, 9)) >= 0.15
  UNION ALL SELECT ticker, filing_date, 1, grp, type, severity FROM b WHERE {_KEYED})"""


@query(f"{_SHIFTED} SELECT ticker, filing_date, type, subject, severity, row_number() OVER (PARTITION BY ticker, filing_date ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, source, subject) AS pos FROM al")
def anomaly_order(s: SparkSession, d: str) -> DataFrame:
    """Shifts of sections and keyword anomalies of each filing in one list, the severe ones first, shifts before keywords."""
    rows = _known(_scored(s, d)).groupBy("ticker", "filing_date", "section").agg(F.avg("score").alias("score"))
    shifted = history.shifts(rows.withColumn("score", F.col("score")), "ticker", ["filing_date"], threshold=0.0).withColumn("delta", F.round("delta", 9)).where("abs(delta) >= 0.15")
    shifted = shifted.select("ticker", "filing_date", F.lit(0).alias("source"), F.col("section").alias("subject"), F.lit("sentiment_shift").alias("type"), F.when(F.abs("delta") >= 0.3, "high").otherwise("medium").alias("severity"))
    found = _known(_anomalies(s, d)).select("ticker", "filing_date", F.lit(1).alias("source"), F.col("grp").alias("subject"), "type", "severity")
    w = Window.partitionBy("ticker", "filing_date").orderBy(history.severity_rank(F.col("severity")), "source", "subject")
    return shifted.unionByName(found).select("ticker", "filing_date", "type", "subject", "severity", F.row_number().over(w).alias("pos"))


# ---- outcomes of signals by ticker ----------------------------------------------------------------------------------

_BOTH = f"""{_BLEND}, ser AS (SELECT ticker, filing_date AS d, max(length(full_document))::DOUBLE AS close FROM (SELECT upper(trim(ticker)) AS ticker, filing_date, full_document FROM filings WHERE full_document IS NOT NULL) WHERE {_KEYED} GROUP BY ALL),
own AS (SELECT ticker, filing_date, 'finbert' AS model, round(finbert, 4) AS score, {_SIGNAL('finbert')} AS signal FROM sent),
mix AS (SELECT ticker, filing_date, 'ensemble' AS model, round(score, 4) AS score, {_SIGNAL('score')} AS signal FROM ez WHERE keywords IS NOT NULL),
sig AS (SELECT 'finbert' AS mode, * FROM own UNION ALL SELECT 'ensemble', * FROM mix UNION ALL SELECT 'ensemble', own.* FROM own WHERE ticker NOT IN (SELECT ticker FROM mix)),
ba AS (SELECT sig.*, close AS base, (filing_date + 365)::DATE AS due FROM sig ASOF LEFT JOIN ser ON sig.ticker = ser.ticker AND sig.filing_date <= ser.d),
ou AS (SELECT ba.*, close AS future FROM ba ASOF LEFT JOIN ser ON ba.ticker = ser.ticker AND ba.due <= ser.d),
re AS (SELECT *, CASE WHEN base <> 0 THEN (future - base) / base END AS ret FROM ou),
bk AS (SELECT *, CASE WHEN ret IS NULL THEN 'unknown' WHEN ret > 0.02 THEN 'up' WHEN ret < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM re),
sm AS (SELECT *, CASE WHEN signal LIKE '%BUY' THEN 1 WHEN signal LIKE '%SELL' THEN -1 ELSE 0 END AS s, CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'flat' THEN 0 END AS m FROM bk)"""


def _series(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "filings", "ticker", "filing_date", "full_document").where("full_document is not null")
    f = _known(f.select(F.upper(F.trim("ticker")).alias("ticker"), "filing_date", F.length("full_document").cast("double").alias("close")))
    return f.groupBy("ticker", F.col("filing_date").alias("d")).agg(F.max("close").alias("close"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    """Signals of both modes: the blend's where a ticker has any, else its recorded sentiment's."""
    e = _blended(s, d)
    named = lambda df, model, score: df.select("ticker", "filing_date", F.lit(model).alias("model"), F.round(score, 4).alias("score"), scores.signal(F.col(score)).alias("signal"))
    own, mixed = named(e, "finbert", "finbert"), named(e.where("keywords is not null"), "ensemble", "score")
    both = metrics.with_fallback(mixed, own, "ticker")
    return own.withColumn("mode", F.lit("finbert")).unionByName(both.withColumn("mode", F.lit("ensemble")))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return asof.returns(_signals(s, d), _series(s, d), "ticker", "filing_date", [365])


@query(f"WITH {_BOTH} SELECT mode, model, ticker, filing_date, score + 0.0 AS score, signal, round(ret, 6) AS ret, direction FROM bk")
def backtest_models(s: SparkSession, d: str) -> DataFrame:
    """Signals of recorded sentiment and of the blend with what the ticker's series did within a year; tickers without any blend fall back."""
    return r6(_outcomes(s, d).select("mode", "model", "ticker", "filing_date", "score", "signal", "ret", "direction"))


@query(f"WITH {_BOTH} SELECT mode, {_SUMMARY} FROM sm GROUP BY mode")
def compare_models(s: SparkSession, d: str) -> DataFrame:
    """Hit rate, directional accuracy, mean return and Sharpe ratio of both modes."""
    return r6(metrics.summary(_outcomes(s, d), ["mode"]))


@query(f"WITH {_BOTH}, g AS (SELECT mode, coalesce(count(*) FILTER (WHERE s = m AND s <> 0) / nullif(count(*) FILTER (WHERE s <> 0 AND m <> 0), 0)::DOUBLE, 0) AS a FROM sm GROUP BY mode), w AS (SELECT max(a) FILTER (WHERE mode = 'finbert') AS a, max(a) FILTER (WHERE mode = 'ensemble') AS b FROM g) SELECT CASE WHEN a > b THEN 'finbert' WHEN b > a THEN 'ensemble' ELSE 'Tie' END AS winner FROM w")
def winner(s: SparkSession, d: str) -> DataFrame:
    """Which of the modes has the higher directional accuracy."""
    m = metrics.summary(_outcomes(s, d), ["mode"])
    of = lambda n: F.max(F.when(F.col("mode") == n, F.col("directional_accuracy")))
    return m.agg(of("finbert").alias("a"), of("ensemble").alias("b")).select(metrics.better_of(F.col("a"), F.col("b"), "finbert", "ensemble").alias("winner"))


# ---- calibration -----------------------------------------------------------------------------------------------------

_CELLS = "cells AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS cell, a / 20.0::DOUBLE AS w1, b / 20.0::DOUBLE AS w2, (20 - a - b) / 20.0::DOUBLE AS w3 FROM range(1, 20) x(a), range(1, 20) y(b) WHERE 20 - a - b >= 1)"
_CAL = f"""{_BOTH}, sx AS (SELECT ticker, filing_date, section, round(avg(greatest(-1.0, least(1.0, coalesce(CASE WHEN u + v > 0 THEN 0.5 * (u - v) / (u + v) END, 0.0)))::DOUBLE), 4) AS score FROM (
  SELECT section_id, ticker, filing_date, section, sum(n) FILTER (WHERE polarity = 'bear') / {_N["bear"]}.0 AS v, sum(n) FILTER (WHERE polarity = 'bull') / {_N["bull"]}.0 AS u FROM (
    SELECT section_id, ticker, filing_date, section, grp, polarity, sum((length(lower(t)) - length(replace(lower(t), term, ''))) // length(term))::BIGINT AS n FROM sec, tt WHERE {_KEYED} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
pv AS (SELECT ticker, filing_date, max(score) FILTER (WHERE section = 'item_1a') AS item_1a, max(score) FILTER (WHERE section = 'item_7') AS item_7, max(score) FILTER (WHERE section = 'item_8') AS item_8 FROM sx GROUP BY ALL),
cr AS (SELECT sm.ticker, sm.filing_date, sm.score, sm.signal, s, m, keywords, item_1a, item_7, item_8 FROM sm LEFT JOIN bl USING (ticker, filing_date) LEFT JOIN pv USING (ticker, filing_date) WHERE mode = 'finbert'),
{_CELLS},
sw AS (SELECT cell, m, coalesce((coalesce(item_1a * w1, 0) + coalesce(item_7 * w2, 0) + coalesce(item_8 * w3, 0)) / nullif(CASE WHEN item_1a IS NULL THEN 0 ELSE w1 END + CASE WHEN item_7 IS NULL THEN 0 ELSE w2 END + CASE WHEN item_8 IS NULL THEN 0 ELSE w3 END, 0), 0) AS x
  FROM cells, cr WHERE m <> 0 AND (item_1a IS NOT NULL OR item_7 IS NOT NULL OR item_8 IS NOT NULL)),
sg AS (SELECT cell, count(*) FILTER (WHERE (x >= 0.2 AND m = 1) OR (x < -0.2 AND m = -1)) AS hits, count(*) FILTER (WHERE x >= 0.2 OR x < -0.2) AS total FROM sw GROUP BY cell),
sgg AS (SELECT c.cell, w1, w2, w3, coalesce(hits, 0) AS hits, coalesce(total, 0) AS total, coalesce(hits / nullif(total, 0)::DOUBLE, 0) AS accuracy FROM cells c LEFT JOIN sg ON sg.cell = c.cell),
ew AS (SELECT cell, m, greatest(-1.0, least(1.0, score * w1 + keywords * w2 + item_7 * w3)) AS x FROM cells, cr WHERE m <> 0 AND keywords IS NOT NULL AND item_7 IS NOT NULL),
eg AS (SELECT cell, count(*) FILTER (WHERE (x >= 0.2 AND m = 1) OR (x < -0.2 AND m = -1)) AS hits, count(*) FILTER (WHERE x >= 0.2 OR x < -0.2) AS total FROM ew GROUP BY cell),
tcells AS (SELECT (i * 8 + j)::INT AS cell, (i - 8) * 5 / 100.0::DOUBLE AS sell, (j + 1) * 5 / 100.0::DOUBLE AS buy FROM range(8) a(i), range(8) b(j)),
tg AS (SELECT cell, count(*) FILTER (WHERE (score >= buy AND m = 1) OR (score < sell AND m = -1)) AS hits, count(*) FILTER (WHERE score >= buy OR score < sell) AS total FROM tcells, cr WHERE m <> 0 GROUP BY cell),
orig AS (SELECT 'thresholds' AS grid, * FROM (SELECT s, m FROM cr) UNION ALL SELECT 'ensemble_weights', s, m FROM cr WHERE keywords IS NOT NULL AND item_7 IS NOT NULL UNION ALL SELECT 'section_weights', s, m FROM cr WHERE item_1a IS NOT NULL OR item_7 IS NOT NULL OR item_8 IS NOT NULL),
oa AS (SELECT grid, count(*) AS data_points, coalesce(count(*) FILTER (WHERE s = m AND s <> 0) / nullif(count(*) FILTER (WHERE s <> 0 AND m <> 0), 0)::DOUBLE, 0) AS original FROM orig GROUP BY grid),
every AS (SELECT 'thresholds' AS grid, cell, hits, total FROM tg UNION ALL SELECT 'ensemble_weights', * FROM eg UNION ALL SELECT 'section_weights', * FROM sg),
best AS (SELECT grid, cell, hits / total AS accuracy FROM every WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY grid ORDER BY hits / total DESC, cell) = 1)"""


def _calibration_rows(s: SparkSession, d: str) -> DataFrame:
    """Recorded sentiment with its outcome, the keyword score, and the keyword scores of the three sections."""
    rows = _outcomes(s, d).where("mode = 'finbert'").select("ticker", "filing_date", "score", "signal", "direction")
    kw = _dispatched(s, d).select("ticker", "filing_date", F.col("score").alias("keywords"))
    counted = _known(_scored(s, d, _TRACKED)).groupBy("ticker", "filing_date")
    of = lambda x: F.round(F.avg(F.when(F.col("section") == x, F.col("score"))), 4).alias(x)
    return rows.join(kw, ["ticker", "filing_date"], "left").join(counted.agg(*[of(x) for x in history.SECTIONS]), ["ticker", "filing_date"], "left")


@query(f"WITH {_CAL} SELECT cell, w1, w2, w3, hits, total, round(accuracy, 6) AS accuracy FROM sgg")
def grid_sections(s: SparkSession, d: str) -> DataFrame:
    """Directional accuracy over 171 triples of section weights, shared out anew among the sections that a filing has."""
    rows = _calibration_rows(s, d).where(F.coalesce(*history.SECTIONS).isNotNull())
    return r6(metrics.section_weight_grid(rows, list(history.SECTIONS)))


@query(f"WITH {_CAL} SELECT grid, data_points, cell AS best_cell, round(accuracy, 6) AS accuracy, round(original, 6) AS original, round(accuracy - original, 6) AS improvement, coalesce(accuracy - original > 0.01, false) AS adopt FROM oa LEFT JOIN best USING (grid)")
def calibration(s: SparkSession, d: str) -> DataFrame:
    """The best thresholds, ensemble weights and section weights, and whether they are worth adopting."""
    rows = written(_calibration_rows(s, d))
    complete, sectioned = rows.where("keywords is not null and item_7 is not null"), rows.where(F.coalesce(*history.SECTIONS).isNotNull())
    parts = [
        metrics.recommend(metrics.threshold_grid(rows), "thresholds", metrics.original_accuracy(rows)),
        metrics.recommend(metrics.weight_grid(complete, ["score", "keywords", "item_7"]), "ensemble_weights", metrics.original_accuracy(complete)),
        metrics.recommend(metrics.section_weight_grid(sectioned, list(history.SECTIONS)), "section_weights", metrics.original_accuracy(sectioned)),
    ]
    return r6(reduce(DataFrame.unionByName, parts))


# ---- the pipeline's state ---------------------------------------------------------------------------------------------

_PIPE = f"""{_BLEND}, fl AS (SELECT ticker, filing_date, bool_or(full_document IS NOT NULL AND full_document <> '') AS parsed FROM (SELECT upper(trim(ticker)) AS ticker, filing_date, full_document FROM filings) WHERE {_KEYED} GROUP BY ALL),
cut AS (SELECT ticker, filing_date FROM sec WHERE {_KEYED} AND t <> '' GROUP BY ALL),
ps AS (SELECT fl.*, parsed AND cut.ticker IS NOT NULL AS sections, parsed AND cut.ticker IS NOT NULL AND ez.ticker IS NOT NULL AS sentiment, parsed AND cut.ticker IS NOT NULL AND ez.keywords IS NOT NULL AS ensemble
  FROM fl LEFT JOIN cut ON cut.ticker = fl.ticker AND cut.filing_date = fl.filing_date LEFT JOIN ez ON ez.ticker = fl.ticker AND ez.filing_date = fl.filing_date)"""


def _state(s: SparkSession, d: str) -> DataFrame:
    keys = ["ticker", "filing_date"]
    tidy = lambda name, *cols: _known(table(s, d, name, *keys, *cols).withColumn("ticker", F.upper(F.trim("ticker"))))
    e = _blended(s, d)
    return pipeline.filing_status(tidy("filings", "full_document"), "full_document", tidy("sections", "section_text").where("section_text <> ''"), e, e.where("keywords is not null"), keys)


@query(f"""WITH {_PIPE} SELECT ticker, filing_date, parsed, sections, sentiment, ensemble, sentiment AS success,
  CASE WHEN NOT parsed THEN 'Pipeline failed at parsing' ELSE 'Completed: ' || concat_ws(', ', 'parse', CASE WHEN sections THEN 'sections' END, CASE WHEN sentiment THEN 'sentiment' END, CASE WHEN ensemble THEN 'ensemble' END) END AS message FROM ps""")
def pipeline_filings(s: SparkSession, d: str) -> DataFrame:
    """How far each filing has come: parse, sections, sentiment, ensemble."""
    return _state(s, d)


@query(f"WITH {_PIPE} SELECT ticker, count(*) FILTER (WHERE sentiment) AS processed, count(*) FILTER (WHERE NOT sentiment) AS failed, count(*) AS total, count(*) FILTER (WHERE sentiment) > 0 AS success, 'Processed ' || count(*) FILTER (WHERE sentiment) || '/' || count(*) || ' filings' AS message FROM ps GROUP BY ticker")
def pipeline_companies(s: SparkSession, d: str) -> DataFrame:
    """How many of each company's filings have come through."""
    return pipeline.company_status(_state(s, d), "ticker")
