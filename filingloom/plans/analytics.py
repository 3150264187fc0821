"""Queries over filings, their sections, events and vectors, each beside the SQL that checks it.

Doubles are rounded to six places on both sides, for sums come in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import text as T
from filingloom.functions.dictionary import FOLLOW_UPS, INDUSTRIAL, SYNONYMS
from filingloom.operators import ann, asof, chunks, history, keywords, metrics, retrieval, scores, sections, status
from filingloom.sources.files import file_keys
from filingloom.sources.tables import section_key, spread, table

# what the queries about one ticker or year are run for, unless told otherwise
EXAMPLE_TICKER, EXAMPLE_YEAR = "YRSTZ", 2015

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = re.sub(r"round\(((?:[^()]|\([^()]*\))*), 6\)", r"(round(\1, 6) + 0.0)", sql)
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(df: DataFrame) -> DataFrame:
    """All doubles rounded to six places, negative zero made positive."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c, t in df.dtypes if t == "double"})


# ---- common parts --------------------------------------------------------------------------------------------

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b"
_WORDS = lambda c: f"len(regexp_extract_all({c}, '[^{_SPACE}]+'))"
_TRIM = lambda c: f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_NB, _NU = keywords.sizes(INDUSTRIAL)["bear"], keywords.sizes(INDUSTRIAL)["bull"]
_TERMS = "terms(grp, term, polarity) AS (VALUES " + ", ".join(f"('{g}', '{t}', '{p}')" for g, t, p in INDUSTRIAL) + ")"
_SEC = r"""sec AS (SELECT DISTINCT section_id, filing_id, upper(trim(ticker)) AS ticker, filing_date,
  'item_' || regexp_replace(regexp_replace(lower(section), '[^\p{L}\p{N}]', '', 'g'), '^item', '') AS section, coalesce(section_text, '') AS t FROM sections)"""
_KW = f"""{_TERMS}, {_SEC},
kw AS (SELECT section_id, filing_id, ticker, filing_date, section, grp, polarity,
  sum((length(lower(t)) - length(replace(lower(t), term, ''))) // length(term))::BIGINT AS n FROM sec, terms GROUP BY ALL)"""
_SIGNAL = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0.5 THEN 'STRONG_BUY' WHEN {x} >= 0.2 THEN 'BUY' WHEN {x} >= -0.2 THEN 'HOLD' WHEN {x} >= -0.5 THEN 'SELL' ELSE 'STRONG_SELL' END"
_SC = f"""{_KW}, tot AS (SELECT section_id, filing_id, ticker, filing_date, section, sum(n) FILTER (WHERE polarity = 'bear') / {_NB}.0 AS b, sum(n) FILTER (WHERE polarity = 'bull') / {_NU}.0 AS u FROM kw GROUP BY ALL),
sc AS (SELECT section_id, filing_id, ticker, filing_date, section, greatest(-1.0, least(1.0, coalesce(CASE WHEN u + b > 0 THEN 0.5 * (u - b) / (u + b) END, 0.0)))::DOUBLE AS score FROM tot)"""
_FS = f"""{_SC}, wd AS (SELECT filing_id, ticker, filing_date, sum({_WORDS('t')})::BIGINT AS words FROM sec GROUP BY ALL),
f0 AS (SELECT filing_id, ticker, filing_date, round(sum(score * w) / sum(w), 9) + 0.0 AS overall, avg(score) FILTER (WHERE section = 'item_1a') AS item_1a, avg(score) FILTER (WHERE section = 'item_7') AS item_7, avg(score) FILTER (WHERE section = 'item_8') AS item_8
  FROM (SELECT *, CASE section WHEN 'item_1a' THEN 0.25 WHEN 'item_7' THEN 0.60 WHEN 'item_8' THEN 0.15 ELSE 1.0 / 3 END::DOUBLE AS w FROM sc) GROUP BY ALL),
fs AS (SELECT f0.*, words, {_SIGNAL('overall')} AS signal FROM f0 JOIN wd ON f0.filing_id = wd.filing_id AND f0.ticker IS NOT DISTINCT FROM wd.ticker AND f0.filing_date IS NOT DISTINCT FROM wd.filing_date)"""


def _sections(s: SparkSession, d: str, *extra: Column) -> DataFrame:
    """Sections with clean keys, one row an id; what is computed from the text is computed before rows are made distinct."""
    df = spread(table(s, d, "sections", "section_id", "filing_id", "ticker", "filing_date", "section", "section_text"))
    df = df.withColumn("low", F.lower(_text()))
    keys = ["section_id", "filing_id", F.upper(F.trim("ticker")).alias("ticker"), "filing_date", section_key("section").alias("section")]
    return df.select(*keys, *extra).distinct()


def _text() -> Column:
    return F.coalesce(F.col("section_text"), F.lit(""))


def _counted(s: SparkSession, d: str, dictionary: keywords.Dictionary = INDUSTRIAL) -> DataFrame:
    return _sections(s, d, keywords.group_counts(F.col("low"), dictionary).alias("counts"), T.word_count(_text()).alias("words"))


def _scored(s: SparkSession, d: str, dictionary: keywords.Dictionary = INDUSTRIAL) -> DataFrame:
    c = _counted(s, d, dictionary)
    bear, bull = keywords.polarity_total(F.col("counts"), "bear"), keywords.polarity_total(F.col("counts"), "bull")
    return c.withColumn("score", keywords.absolute_score(bear, bull, dictionary))


def _filings(s: SparkSession, d: str) -> DataFrame:
    w = scores.weight_of(F.col("section"))
    of = lambda x: F.avg(F.when(F.col("section") == x, F.col("score"))).alias(x)
    f = _scored(s, d).groupBy("filing_id", "ticker", "filing_date").agg((F.round(scores.weighted_mean(F.col("score"), w), 9) + 0.0).alias("overall"), of("item_1a"), of("item_7"), of("item_8"), F.sum("words").alias("words"))
    return f.withColumn("signal", scores.signal(F.col("overall")))


def _groups(s: SparkSession, d: str, dictionary: keywords.Dictionary = INDUSTRIAL) -> DataFrame:
    rows = _counted(s, d, dictionary).select("section_id", "filing_id", "ticker", "filing_date", "section", F.explode_outer("counts").alias("c"))
    return rows.select("section_id", "filing_id", "ticker", "filing_date", "section", "c.*")


def _dated(s: SparkSession, d: str, dictionary: keywords.Dictionary = INDUSTRIAL) -> DataFrame:
    """Mentions of each group by ticker and date."""
    return _groups(s, d, dictionary).where("ticker is not null").groupBy("ticker", "filing_date", "grp", "polarity").agg(F.sum("n").alias("n"))


_DATED = f"{_KW}, dated AS (SELECT ticker, filing_date, grp, polarity, sum(n)::BIGINT AS n FROM kw WHERE ticker IS NOT NULL GROUP BY ALL)"

# ---- texts ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(text) AS chars, {_WORDS('text')} AS words, CASE WHEN {_TRIM('text')} = '' THEN 0 ELSE len(regexp_extract_all({_TRIM('text')}, '{_BREAK}')) + 1 END AS lines FROM documents WHERE text IS NOT NULL")
def section_stats(s: SparkSession, d: str) -> DataFrame:
    """Characters, words and lines of every text."""
    t = F.col("text")
    return spread(table(s, d, "documents", "doc_id", "text")).where("text is not null").select("doc_id", F.length(t).alias("chars"), T.word_count(t).alias("words"), T.line_count(t).alias("lines"))


_PARTS = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '\\n\\s*\\n'), lambda x: {_TRIM('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len(p) AS paragraphs, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS chars FROM (SELECT doc_id, {_PARTS('text')} AS p FROM documents WHERE text IS NOT NULL) WHERE len(p) > 0")
def paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every text and their characters."""
    p = spread(table(s, d, "documents", "doc_id", "text")).select("doc_id", T.paragraphs(F.col("text")).alias("p")).where(F.size("p") > 0)
    return p.select("doc_id", F.size("p").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"""SELECT doc_id, chunk_id, paragraph, {_WORDS('paragraph')} AS word_count FROM (SELECT doc_id, unnest(range(len(p))) AS chunk_id, unnest(p) AS paragraph
  FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_TRIM('x')}) AS p FROM documents WHERE text IS NOT NULL)) WHERE {_WORDS('paragraph')} >= 20""")
def rag_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of at least 20 words, numbered before the short ones go."""
    return chunks.numbered_paragraphs(table(s, d, "documents", "doc_id", "text").where("text is not null"), ["doc_id"], "text")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_rows(_filing_texts(s, d).withColumn("ticker", F.upper(F.trim("ticker"))), ["filing_id", "ticker"], "full_document")


def _filing_texts(s: SparkSession, d: str) -> DataFrame:
    """One row a filing: repeated rows go before the work on texts, by one shuffle that deals the texts out to all tasks too."""
    return spread(table(s, d, "filings", "filing_id", "ticker", "full_document").where("full_document is not null"), "filing_id").dropDuplicates(["filing_id"])


# the patterns of clean_section, as the SQL has them
_CLEAN = _TRIM(r"""regexp_replace(regexp_replace(regexp_replace(full_document, '\n{3,}', E'\n\n', 'g'), '\n[A-Za-z\s]+\|\s*\d{4}\s*Form\s*10-K\s*\|\s*\d+\n', E'\n', 'g'), '\|[\s\-|]+\|', '', 'g')""")


def _fold_sql(source: str, size: int = 500, overlap: int = 50, least: int = 100) -> str:
    """``folded(id, chunk_id, chunk)`` out of ``source (id, p)``, paragraph after paragraph."""
    return f"""folded AS (WITH RECURSIVE f AS (SELECT id, 0 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS wc, NULL::VARCHAR AS done FROM {source} WHERE len(p) > 0
  UNION ALL SELECT id, i + 1, CASE WHEN over THEN [CASE WHEN nl <= {overlap} THEN cur[-1] ELSE array_to_string(list_slice(lw, nl - {overlap - 1}, nl), ' ') END, x] ELSE list_append(cur, x) END,
    CASE WHEN over THEN least(nl, {overlap}) + n ELSE wc + n END, CASE WHEN over THEN array_to_string(cur, E'\\n\\n') END
  FROM (SELECT *, len(lw) AS nl, wc + n > {size} AND len(cur) > 0 AS over FROM (SELECT f.*, p[i + 1] AS x, {_WORDS('p[i + 1]')} AS n, regexp_extract_all(coalesce(cur[-1], ''), '[^{_SPACE}]+') AS lw FROM f JOIN {source} USING (id) WHERE i < len(p))))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS chunk_id, chunk FROM (SELECT id, i, done AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT id, i + 1, array_to_string(cur, E'\\n\\n') FROM f JOIN {source} USING (id) WHERE i = len(p) AND wc >= {least}))"""


@query(f"WITH src AS (SELECT filing_id AS id, any_value(upper(trim(ticker))) AS ticker, {_PARTS('any_value(full_document)')} AS p FROM filings WHERE full_document IS NOT NULL GROUP BY filing_id), {_fold_sql('src')} SELECT id AS filing_id, ticker, chunk_id, chunk, {_WORDS('chunk')} AS word_count FROM folded JOIN src USING (id)")
def filing_chunks(s: SparkSession, d: str) -> DataFrame:
    """Retrieval chunks of every filing: 500 words, 50 of overlap, 100 at least."""
    return _chunks(s, d)


def _section_chunks(s: SparkSession, d: str) -> DataFrame:
    df = spread(table(s, d, "sections", "section_id", "ticker", "section", "section_text").where("section_text is not null"), "section_id").dropDuplicates(["section_id"])
    df = df.withColumn("ticker", F.coalesce(F.upper(F.trim("ticker")), F.lit("UNKNOWN"))).withColumn("section", section_key("section"))
    return chunks.chunk_rows(df, ["section_id", "ticker", "section"], "section_text")


_SECTION_CHUNKS = f"""WITH src AS (SELECT section_id AS id, any_value(coalesce(upper(trim(ticker)), 'UNKNOWN')) AS ticker, any_value('item_' || regexp_replace(regexp_replace(lower(section), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '^item', '')) AS section,
  {_PARTS('any_value(section_text)')} AS p FROM sections WHERE section_text IS NOT NULL GROUP BY section_id), {_fold_sql('src')}, c AS (SELECT id, ticker, section, chunk_id, chunk, {_WORDS('chunk')} AS word_count FROM folded JOIN src USING (id))"""


@query(f"{_SECTION_CHUNKS} SELECT id AS section_id, ticker, section, chunk_id, chunk, word_count FROM c")
def section_chunks(s: SparkSession, d: str) -> DataFrame:
    """The same of every section, numbered from 0 in each."""
    return _section_chunks(s, d)


@query(f"{_SECTION_CHUNKS} SELECT ticker, section, count(*) AS chunks, coalesce(sum(word_count), 0)::BIGINT AS words, round(coalesce(avg(word_count), 0), 6) AS mean_words, grouping(ticker)::INT AS all_ticker, grouping(section)::INT AS all_section FROM c GROUP BY GROUPING SETS ((), (ticker), (section))")
def chunk_summary(s: SparkSession, d: str) -> DataFrame:
    """Chunks of sections and their mean words in all, by ticker and by section."""
    return r6(chunks.chunk_summary(_section_chunks(s, d), "ticker", "section").na.fill(0, ["words", "mean_words"]).withColumns({c: F.col(c).cast("int") for c in ("all_ticker", "all_section")}))


def _extract_sql() -> str:
    """The sections of ``src (filing_id, t)`` as ``out(filing_id, section, a, b, x)``, by the same headings without their flags."""
    bare = lambda p: p.replace("(?iU)", "").replace("(?U)", "").replace("\\s", f"[{_SPACE}]")
    cut = lambda name, source, text, pattern, flags: (
        f"{name}_p AS (SELECT *, string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1', '{flags}'), chr(1)) AS pc FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (pc), j, list_sum(list_transform(pc[1:j - 1], lambda x: length(x)))::BIGINT AS pos, length(regexp_extract(pc[j], '^({pattern})', 0, '{flags.replace('g', '')}')) AS len FROM (SELECT *, unnest(range(2, len(pc) + 1)) AS j FROM {name}_p))"
    )
    parts, found = [], []
    for i, (section, pattern) in enumerate(sections.WIDER_HEADINGS.items()):
        parts.append(cut(f"h{i}", "src", "t", bare(pattern).replace("'", "''"), "gi"))
        parts.append(f"a{i} AS (SELECT filing_id, any_value(t) AS t, coalesce(min(pos) FILTER (WHERE length({_TRIM('substring(t, pos + len + 1, 1000 - len)')}) > 200), CASE WHEN count(*) = 1 THEN min(pos) END) AS a FROM h{i} GROUP BY filing_id)")
        parts.append(f"r{i} AS (SELECT filing_id, t, a, substring(t, a + 1001) AS rest FROM a{i} WHERE a IS NOT NULL)")
        parts.append(cut(f"n{i}", f"r{i}", "rest", bare(sections.NEXT), "g"))
        parts.append(f"e{i} AS (SELECT filing_id, min(pos) FILTER (WHERE length({_TRIM('substring(rest, pos + 1, 500)')}) > 200) AS stop FROM n{i} GROUP BY filing_id)")
        found.append(f"SELECT r{i}.filing_id, '{section}' AS section, a, coalesce(a + 1000 + stop, least(length(t), a + 50000)) AS b, t FROM r{i} LEFT JOIN e{i} USING (filing_id)")
    return ", ".join(parts) + ", out AS (" + " UNION ALL ".join(found) + ")"


@query(f"WITH src AS (SELECT filing_id, replace(any_value(full_document), chr(1), ' ') AS t FROM filings WHERE full_document IS NOT NULL GROUP BY filing_id), {_extract_sql()}, cl AS (SELECT filing_id, section, a, b, substring(t, a + 1, b - a) AS full_document FROM out) SELECT filing_id, section, a::INT AS a, b::INT AS b, section_text FROM (SELECT *, {_CLEAN} AS section_text FROM cl) WHERE section_text <> ''")
def section_extract(s: SparkSession, d: str) -> DataFrame:
    """The three sections of every filing, found by their headings."""
    return sections.extract(_filing_texts(s, d), ["filing_id"], "full_document", sections.WIDER_HEADINGS)


@query(f"SELECT DISTINCT filing_id, length(c) AS chars, sha256(c) AS digest FROM (SELECT filing_id, {_CLEAN} AS c FROM filings WHERE full_document IS NOT NULL)")
def section_clean(s: SparkSession, d: str) -> DataFrame:
    """Filings without long gaps, page footers and rules of tables."""
    c = spread(table(s, d, "filings", "filing_id", "full_document")).where("full_document is not null").select("filing_id", T.clean_section(F.col("full_document")).alias("c"))
    return c.select("filing_id", F.length("c").alias("chars"), F.sha2("c", 256).alias("digest")).distinct()


_RISKS = ["debt", "litigation", "climate"]


_HIT = " OR ".join(f"contains(lower(x), '{r}')" for r in _RISKS)


@query(f"""WITH {_SEC}, st AS (SELECT section_id, string_split(regexp_replace(t, '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM sec),
hit AS (SELECT section_id, i, substring({_TRIM('x')}, 1, 400) AS sentence FROM (SELECT section_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM st) WHERE {_HIT}),
firsts AS (SELECT section_id, sentence, min(i) AS i FROM hit GROUP BY ALL)
SELECT section_id, (row_number() OVER (PARTITION BY section_id ORDER BY i) - 1)::INT AS n, sentence FROM firsts QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY i) <= 3""")
def context_sentences(s: SparkSession, d: str) -> DataFrame:
    """The first three sentences of each section that mention debt, litigation or climate."""
    return _sections(s, d, T.context_sentences(_text(), _RISKS).alias("contexts")).where(F.size("contexts") > 0).select("section_id", F.posexplode("contexts").alias("n", "sentence"))


@query(f"""SELECT doc_id, (i // 460)::INT AS window_no, len(list_slice(w, i + 1, i + 510)) AS n_tokens, array_to_string(list_slice(w, i + 1, i + 510), ' ') AS window_text
  FROM (SELECT doc_id, w, unnest(range(0, least(len(w), 50 * 460), 460)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM documents WHERE text IS NOT NULL))""")
def token_windows(s: SparkSession, d: str) -> DataFrame:
    """Classifier windows of 510 words every 460, at most 50 of a text."""
    return chunks.token_windows(table(s, d, "documents", "doc_id", "text").where("text is not null"), ["doc_id"], "text")


@query("SELECT DISTINCT filing_id, section_id, section, replace(initcap_, '1a', '1A') AS title FROM (SELECT filing_id, section_id, 'item_' || regexp_replace(regexp_replace(lower(section), '[^\\p{L}\\p{N}]', '', 'g'), '^item', '') AS section, 'Item ' || regexp_replace(regexp_replace(lower(section), '[^\\p{L}\\p{N}]', '', 'g'), '^item', '') AS initcap_ FROM sections)")
def section_titles(s: SparkSession, d: str) -> DataFrame:
    """Section keys as titles."""
    df = table(s, d, "sections", "filing_id", "section_id", "section").withColumn("section", section_key("section"))
    return df.select("filing_id", "section_id", "section", T.title_case(F.col("section")).alias("title")).distinct()


# ---- keywords and scores --------------------------------------------------------------------------------------


@query(f"WITH {_KW} SELECT section_id, section, grp, polarity, n FROM kw WHERE n > 0")
def kw_counts(s: SparkSession, d: str) -> DataFrame:
    """Mentions of each keyword group in each section."""
    return _groups(s, d).where("n > 0").select("section_id", "section", "grp", "polarity", F.col("n").cast("long").alias("n"))


@query(f"WITH {_KW}, g AS (SELECT filing_id, grp, sum(n)::BIGINT AS n FROM kw GROUP BY ALL) SELECT filing_id, grp, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY n DESC, grp) AS rank FROM g WHERE n > 0) WHERE rank <= 3")
def kw_topk(s: SparkSession, d: str) -> DataFrame:
    """The three most mentioned groups of each filing."""
    return keywords.top_groups(_groups(s, d).groupBy("filing_id", "grp").agg(F.sum("n").alias("n")), ["filing_id"])


@query(f"WITH {_SC} SELECT section_id, section, round(score, 6) AS score, {_SIGNAL('score')} AS signal FROM sc")
def section_scores(s: SparkSession, d: str) -> DataFrame:
    """Keyword score and signal of each section."""
    return r6(_scored(s, d).select("section_id", "section", "score").withColumn("signal", scores.signal(F.col("score"))))


@query(f"WITH {_SC} SELECT section, {_SIGNAL('score')} AS signal, count(*) AS n FROM sc GROUP BY ALL")
def signal_hist(s: SparkSession, d: str) -> DataFrame:
    """Signals of the sections, counted."""
    return _scored(s, d).groupBy("section", scores.signal(F.col("score")).alias("signal")).agg(F.count("*").alias("n"))


@query(f"WITH {_FS} SELECT filing_id, ticker, filing_date, round(overall, 6) AS overall, round(item_1a, 6) AS item_1a, round(item_7, 6) AS item_7, round(item_8, 6) AS item_8, words, signal FROM fs")
def filing_scores(s: SparkSession, d: str) -> DataFrame:
    """Section-weighted score of each filing, without the last places of the sum, which depend on its order."""
    return r6(_filings(s, d))


@query(f"""WITH {_DATED}, h AS (SELECT *, count(*) OVER w - 1 AS history, (sum(n) OVER w - n) / nullif(count(*) OVER w - 1, 0)::DOUBLE AS mean FROM dated WINDOW w AS (PARTITION BY ticker, grp)),
g AS (SELECT *, CASE WHEN mean = 0 AND n > 0 THEN 1.0 WHEN mean > 0 THEN (n - mean) / mean END AS delta FROM h),
p AS (SELECT *, CASE WHEN delta > 0.5 THEN least(delta, 3.0) WHEN delta < -0.3 THEN -least(abs(delta), 2.0) ELSE 0.0 END AS push FROM g),
q AS (SELECT ticker, filing_date, max(history) AS history, sum(CASE WHEN polarity = 'bear' AND push > 0 THEN push WHEN polarity = 'bull' AND push < 0 THEN -push ELSE 0 END)::DOUBLE AS bear,
  sum(CASE WHEN polarity = 'bull' AND push > 0 THEN push WHEN polarity = 'bear' AND push < 0 THEN -push ELSE 0 END)::DOUBLE AS bull FROM p GROUP BY ALL)
SELECT ticker, filing_date, history, round(bear, 6) AS bear, round(bull, 6) AS bull, round(coalesce(CASE WHEN bull + bear <> 0 THEN 0.6 * (bull - bear) / (bull + bear) END, 0), 6) AS score FROM q""")
def kw_delta(s: SparkSession, d: str) -> DataFrame:
    """Keyword score of each date against all other dates of the ticker."""
    return r6(keywords.delta_score(keywords.deltas(_dated(s, d), "ticker", "filing_date"), ["ticker", "filing_date"]))


# ---- history ---------------------------------------------------------------------------------------------------

_KEYED = "ticker IS NOT NULL AND ticker <> 'UNKNOWN' AND filing_date IS NOT NULL"


def _known(df: DataFrame) -> DataFrame:
    return df.where(_KEYED)


@query(f"""WITH {_SC}, s1 AS (SELECT ticker, filing_date, filing_id, section, avg(score) AS score FROM sc WHERE {_KEYED} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date, filing_id) AS no FROM (SELECT DISTINCT ticker, filing_date, filing_id FROM s1)), x AS (SELECT s1.*, no FROM s1 JOIN n USING (ticker, filing_date, filing_id)),
y AS (SELECT a.*, b.score AS before, a.score - b.score AS delta FROM x a JOIN x b ON a.ticker = b.ticker AND a.section = b.section AND a.no = b.no + 1)
SELECT filing_id, section, round(score, 6) AS score, round(before, 6) AS before, round(delta, 6) AS delta, CASE WHEN abs(delta) >= 0.3 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN delta > 0 THEN 'positive' ELSE 'negative' END AS direction FROM y WHERE abs(delta) >= 0.15""")
def sentiment_shift(s: SparkSession, d: str) -> DataFrame:
    """Shifts of a section's score against the ticker's filing before."""
    rows = _known(_scored(s, d)).groupBy("ticker", "filing_date", "filing_id", "section").agg(F.avg("score").alias("score"))
    return r6(history.shifts(rows, "ticker", ["filing_date", "filing_id"]).select("filing_id", "section", "score", "before", "delta", "severity", "direction"))


_ANOM = f"""WITH {_DATED}, h AS (SELECT *, count(*) OVER w AS history, coalesce(sum(n) OVER w, 0) / nullif(count(*) OVER w, 0)::DOUBLE AS mean FROM dated WINDOW w AS (PARTITION BY ticker, grp ORDER BY filing_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN mean = 0 AND n > 0 THEN 'emergence' WHEN mean > 0 AND n / mean >= 3.0 THEN 'spike' WHEN mean > 0 AND n > 0 AND n / mean <= 1 / 3.0::DOUBLE THEN 'decline' END AS type FROM h WHERE history >= 3),
b AS (SELECT *, CASE WHEN type <> 'decline' AND n >= 5 THEN 'high' ELSE 'medium' END AS severity FROM a WHERE type IS NOT NULL)"""


def _anomalies(s: SparkSession, d: str) -> DataFrame:
    return keywords.anomalies(_dated(s, d), "ticker", "filing_date")


@query(_ANOM + " SELECT ticker, filing_date, grp, n, round(mean, 6) AS mean, history, type, severity FROM b")
def kw_anomaly(s: SparkSession, d: str) -> DataFrame:
    """Emergence, spike and decline of keyword groups against all earlier filings."""
    return r6(_anomalies(s, d).select("ticker", "filing_date", "grp", "n", "mean", "history", "type", "severity"))


@query(_ANOM + " SELECT ticker, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) AS total FROM b GROUP BY ticker")
def anomaly_summary(s: SparkSession, d: str) -> DataFrame:
    """Anomalies of each ticker by severity."""
    n = lambda x: F.count_if(F.col("severity") == x).alias(x)
    return _anomalies(s, d).groupBy("ticker").agg(n("high"), n("medium"), n("low"), F.count("*").alias("total"))


@query("SELECT DISTINCT context_id, substring(sha256(concat_ws(':', coalesce(filing_id::VARCHAR, ''), coalesce(current_filing_date::VARCHAR, ''), coalesce(anomaly_type, ''), coalesce(keyword, ''))), 1, 32) AS anomaly_hash FROM anomaly_contexts")
def anomaly_hash(s: SparkSession, d: str) -> DataFrame:
    """Merge key of each anomaly."""
    a = table(s, d, "anomaly_contexts", "context_id", "filing_id", "current_filing_date", "anomaly_type", "keyword")
    return a.select("context_id", status.identity_hash(F.col("filing_id"), F.col("current_filing_date"), F.col("anomaly_type"), F.col("keyword")).alias("anomaly_hash")).distinct()


_YOY = ", ".join(f"{c} - lag({c}) OVER w AS {c}_delta" for c in ("overall", "item_1a", "item_7", "item_8", "words"))
_FZ = f"{_FS}, fz AS (SELECT filing_id, ticker, filing_date, overall, coalesce(item_1a, 0) AS item_1a, coalesce(item_7, 0) AS item_7, coalesce(item_8, 0) AS item_8, words, signal FROM fs WHERE {_KEYED})"


@query(f"""WITH {_FZ}, y AS (SELECT filing_id, {_YOY}, signal <> lag(signal) OVER w AS signal_changed, row_number() OVER w AS n FROM fz WINDOW w AS (PARTITION BY ticker ORDER BY filing_date, filing_id))
SELECT filing_id, round(overall_delta, 6) AS overall_delta, round(item_1a_delta, 6) AS item_1a_delta, round(item_7_delta, 6) AS item_7_delta, round(item_8_delta, 6) AS item_8_delta, words_delta, signal_changed FROM y WHERE n > 1""")
def yoy_delta(s: SparkSession, d: str) -> DataFrame:
    """Each filing against the ticker's filing before."""
    y = history.year_over_year(_known(_filings(s, d)), "ticker", "filing_date", "filing_id")
    return r6(y.select("filing_id", "overall_delta", "item_1a_delta", "item_7_delta", "item_8_delta", "words_delta", "signal_changed"))


@query(f"""WITH {_FZ}, i AS (SELECT ticker, overall, row_number() OVER (PARTITION BY ticker ORDER BY filing_date, filing_id) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM fz),
h AS (SELECT ticker, avg(overall) FILTER (WHERE i < n // 2) AS older, avg(overall) FILTER (WHERE i >= n // 2) AS newer, count(*) AS filings FROM i GROUP BY ticker)
SELECT ticker, round(older, 6) AS older, round(newer, 6) AS newer, filings, CASE WHEN round(newer - older, 9) > 0.05 THEN 'improving' WHEN round(newer - older, 9) < -0.05 THEN 'deteriorating' ELSE 'stable' END AS trend FROM h""")
def trend(s: SparkSession, d: str) -> DataFrame:
    """Direction of each ticker's score, older half against newer half."""
    return r6(history.trend(_known(_filings(s, d)), "ticker", "filing_date", "filing_id"))


@query(f"""WITH {_FZ}, l AS (SELECT ticker, filing_date, filing_id, overall, overall - lag(overall) OVER (PARTITION BY ticker ORDER BY filing_date, filing_id) AS dd FROM fz)
SELECT ticker, round(avg(overall), 6) AS mean, round(min(overall), 6) AS least, round(max(overall), 6) AS greatest, round(max(overall) - min(overall), 6) AS range,
  round(max(dd) FILTER (WHERE dd > 0), 6) AS rise, round(min(dd) FILTER (WHERE dd < 0), 6) AS fall,
  first(filing_date ORDER BY dd DESC, filing_date) FILTER (WHERE dd > 0) AS rise_date, first(filing_date ORDER BY dd, filing_date) FILTER (WHERE dd < 0) AS fall_date FROM l GROUP BY ticker""")
def summary_extrema(s: SparkSession, d: str) -> DataFrame:
    """Mean, extremes and greatest moves of each ticker's score, with their dates."""
    return r6(history.extremes(_known(_filings(s, d)), "ticker", "filing_date", "filing_id"))


@query(f"""WITH {_SEC}, w AS (SELECT ticker, section, filing_date, section_id, {_WORDS('t')} AS words FROM sec WHERE {_KEYED}),
g AS (SELECT ticker, section, arg_min(words, (filing_date, section_id)) FILTER (WHERE words > 0) AS first_words, arg_max(words, (filing_date, section_id)) FILTER (WHERE words > 0) AS last_words, count(*) AS filings FROM w GROUP BY ALL)
SELECT *, round((last_words - first_words) * 100.0::DOUBLE / first_words, 6) AS change_pct FROM g""")
def deep_dive(s: SparkSession, d: str) -> DataFrame:
    """Words of each ticker's sections, first and last."""
    rows = _known(_sections(s, d, T.word_count(_text()).alias("words")))
    return r6(history.word_change(rows, ["ticker", "section"], "filing_date", "section_id"))


@query(f"WITH {_FZ} SELECT ticker, filing_id, filing_date, round(overall, 6) AS overall, signal FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY (year(filing_date) = {EXAMPLE_YEAR}) DESC, filing_date DESC, filing_id DESC) AS n FROM fz) WHERE n = 1")
def ticker_compare(s: SparkSession, d: str, year: int = EXAMPLE_YEAR) -> DataFrame:
    """Each ticker's last filing of a year, or its newest if it has none."""
    f = _known(_filings(s, d)).select("ticker", "filing_id", "filing_date", "overall", "signal")
    return r6(history.of_year_or_latest(f, "ticker", "filing_date", year, "filing_id"))


@query(f"WITH {_FZ} SELECT ticker, year(filing_date)::INT AS year, max(filing_date) AS filing_date, count(*) AS filings FROM fz GROUP BY ALL")
def latest_by_year(s: SparkSession, d: str) -> DataFrame:
    """Each ticker's years with the last filing of each."""
    return _known(_filings(s, d)).groupBy("ticker", F.year("filing_date").alias("year")).agg(F.max("filing_date").alias("filing_date"), F.count("*").alias("filings"))


@query(f"WITH {_FZ} SELECT ticker, filing_id, filing_date, n AS nth, c AS of FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM fz) WHERE n <= 2")
def latest_pair(s: SparkSession, d: str) -> DataFrame:
    """The newest filing of each ticker and the one before."""
    return history.newest(_known(_filings(s, d)).select("ticker", "filing_id", "filing_date"), "ticker", "filing_date", "filing_id", k=2)


# ---- companies and stages ---------------------------------------------------------------------------------------

_LATEST = f"{_FZ}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) AS n FROM fz) WHERE n = 1)"


@query(f"WITH {_LATEST} SELECT coalesce(sector, 'Other') AS sector, count(*) AS tickers, round(avg(overall), 6) AS mean FROM lt LEFT JOIN companies c ON c.ticker = lt.ticker GROUP BY 1")
def sector_avg(s: SparkSession, d: str) -> DataFrame:
    """Mean score of each sector over its tickers' newest filings."""
    newest = history.latest(_known(_filings(s, d)).select("ticker", "filing_date", "filing_id", "overall"), "ticker", "filing_date", "filing_id")
    return r6(status.sector_of(newest, table(s, d, "companies")).groupBy("sector").agg(F.count("*").alias("tickers"), F.avg("overall").alias("mean")))


@query("SELECT DISTINCT filing_id, upper(trim(f.ticker)) AS ticker, coalesce(sector, 'Other') AS sector FROM filings f LEFT JOIN companies c ON c.ticker = upper(trim(f.ticker))")
def sector_lookup(s: SparkSession, d: str) -> DataFrame:
    """The sector of every filing."""
    f = table(s, d, "filings", "filing_id", "ticker").withColumn("ticker", F.upper(F.trim("ticker"))).distinct()
    return status.sector_of(f, table(s, d, "companies", "ticker", "sector"))


@query("SELECT DISTINCT f.filing_id, c.company_name, CASE WHEN regexp_matches(upper(trim(f.ticker)), '^[A-Z]{1,5}$') THEN lpad(c.cik, 10, '0') END AS cik FROM filings f LEFT JOIN companies c ON c.ticker = upper(trim(f.ticker))")
def cik_lookup(s: SparkSession, d: str) -> DataFrame:
    """Company and padded registration number of every filing; none for a ticker that isn't up to five letters."""
    f = table(s, d, "filings", "filing_id", "ticker").select("filing_id", F.upper(F.trim("ticker")).alias("_t")).distinct()
    j = f.join(table(s, d, "companies", "ticker", "company_name", "cik"), F.col("_t") == F.col("ticker"), "left")
    return j.select("filing_id", "company_name", F.when(F.col("_t").rlike("^[A-Z]{1,5}$"), F.lpad("cik", 10, "0")).alias("cik"))


@query("SELECT ticker, filing_id, filing_date, n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) AS n FROM (SELECT DISTINCT upper(trim(ticker)) AS ticker, filing_id, filing_date FROM filings WHERE form = '10-K' AND ticker IS NOT NULL)) WHERE n <= 3")
def annual_list(s: SparkSession, d: str) -> DataFrame:
    """The three newest annual reports of each ticker, amendments left out."""
    f = table(s, d, "filings", "filing_id", "ticker", "filing_date", "form").where("form = '10-K' and ticker is not null")
    f = f.select(F.upper(F.trim("ticker")).alias("ticker"), "filing_id", "filing_date").distinct()
    return history.newest(f, "ticker", "filing_date", "filing_id", k=3).select("ticker", "filing_id", "filing_date", F.col("nth").alias("n"))


@query("SELECT upper(trim(ticker)) AS ticker, count(DISTINCT filing_id) FILTER (WHERE form = '10-K') AS annual, max(filing_date) FILTER (WHERE form = '10-K') AS latest FROM filings WHERE ticker IS NOT NULL GROUP BY 1")
def filings_counts(s: SparkSession, d: str) -> DataFrame:
    """Annual reports of each ticker and the date of the newest."""
    k = F.col("form") == "10-K"
    f = table(s, d, "filings", "ticker", "filing_id", "form", "filing_date").where("ticker is not null").groupBy(F.upper(F.trim("ticker")).alias("ticker"))
    return f.agg(F.countDistinct(F.when(k, F.col("filing_id"))).alias("annual"), F.max(F.when(k, F.col("filing_date"))).alias("latest"))


_STAGES = ("metadata", "sentiment", "anomalies")
_HAS = ", ".join(f"bool_or(stage = '{x}') AS has_{x}" for x in _STAGES)
_NAMED = r"SELECT DISTINCT stage, nullif(regexp_extract(file_name, '^([A-Z]+)_(?:10K_)?(\d{4}-\d\d-\d\d)', 1), '') AS ticker, try_cast(nullif(regexp_extract(file_name, '^([A-Z]+)_(?:10K_)?(\d{4}-\d\d-\d\d)', 2), '') AS DATE) AS filing_date FROM raw_records"


def _stage_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_records", "stage", "file_name").select("stage", *file_keys(F.col("file_name"))).distinct()


@query(f"SELECT ticker, filing_date, {_HAS}, bool_or(stage = 'sentiment') AS complete FROM ({_NAMED}) GROUP BY ticker, filing_date")
def stage_status(s: SparkSession, d: str) -> DataFrame:
    """Which stages have a file for each ticker and date; complete once there is sentiment."""
    k = _stage_keys(s, d)
    out = status.stage_status({x: k.where(F.col("stage") == x) for x in _STAGES}, ["ticker", "filing_date"])
    return out.withColumn("complete", F.col("has_sentiment"))


@query(f"SELECT ticker, count(*) FILTER (WHERE stage = 'metadata') AS metadata, count(*) FILTER (WHERE stage = 'sentiment') AS sentiment, count(*) FILTER (WHERE stage = 'anomalies') AS anomalies, (count(*) FILTER (WHERE stage = 'sentiment') > 0 AND count(*) FILTER (WHERE stage = 'sentiment') = count(*) FILTER (WHERE stage = 'metadata')) AS complete FROM ({_NAMED}) GROUP BY ticker")
def stage_counts(s: SparkSession, d: str) -> DataFrame:
    """Files of each ticker by stage."""
    n = lambda x: F.count_if(F.col("stage") == x)
    out = _stage_keys(s, d).groupBy("ticker").agg(*[n(x).alias(x) for x in _STAGES])
    return out.withColumn("complete", (F.col("sentiment") > 0) & (F.col("sentiment") == F.col("metadata")))


@query("SELECT DISTINCT filing_id FROM filings f WHERE NOT EXISTS (SELECT 1 FROM anomaly_contexts a WHERE a.filing_id = f.filing_id)")
def incremental_anti(s: SparkSession, d: str) -> DataFrame:
    """Filings that the anomaly stage has no row of."""
    return status.not_done(table(s, d, "filings", "filing_id").distinct(), table(s, d, "anomaly_contexts", "filing_id"), ["filing_id"])


@query("SELECT c.ticker, EXISTS (SELECT 1 FROM filings f WHERE upper(trim(f.ticker)) = c.ticker) AS has_filing, EXISTS (SELECT 1 FROM raw_records r WHERE upper(trim(r.ticker)) = c.ticker AND r.stage = 'sentiment') AS has_sentiment FROM companies c")
def availability(s: SparkSession, d: str) -> DataFrame:
    """What there is of each company."""
    c = table(s, d, "companies", "ticker")
    mark = lambda df, name: df.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().withColumn(name, F.lit(True))
    out = c.join(mark(table(s, d, "filings", "ticker"), "has_filing"), "ticker", "left").join(mark(table(s, d, "raw_records", "ticker", "stage").where("stage = 'sentiment'"), "has_sentiment"), "ticker", "left")
    return out.na.fill(False, ["has_filing", "has_sentiment"])


@query("SELECT record_id, stage, file_name, loaded_at FROM (SELECT DISTINCT record_id, stage, file_name, loaded_at, run_id FROM raw_records) QUALIFY row_number() OVER (PARTITION BY run_id, stage, file_name ORDER BY loaded_at DESC, record_id DESC) = 1")
def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """The newest load of every file: what was loaded later is merged into a table of what was loaded first."""
    r = table(s, d, "raw_records", "run_id", "stage", "file_name", "record_id", "loaded_at")
    middle = r.agg((F.min("loaded_at") + (F.max("loaded_at") - F.min("loaded_at")) / 2).alias("_mid"))
    parts = r.crossJoin(F.broadcast(middle))
    stored = status.upsert(parts.where("loaded_at <= _mid").drop("_mid"), r.limit(0), ["run_id", "stage", "file_name"], ["loaded_at", "record_id"])
    late = parts.where("loaded_at > _mid or loaded_at is null").drop("_mid")
    return status.upsert(stored, late, ["run_id", "stage", "file_name"], ["loaded_at", "record_id"]).select("record_id", "stage", "file_name", "loaded_at")


@query("SELECT ticker, company_name FROM companies WHERE contains(lower(company_name), 'ost') OR contains(lower(ticker), 'ost') ORDER BY lower(ticker) <> 'ost', length(company_name), ticker LIMIT 10")
def company_search(s: SparkSession, d: str) -> DataFrame:
    """The ten best companies for `ost`."""
    return retrieval.company_search(table(s, d, "companies", "ticker", "company_name"), "ost")


@query("SELECT ticker, company_name FROM companies UNION ALL SELECT DISTINCT upper(trim(ticker)), NULL FROM filings f WHERE ticker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM companies c WHERE c.ticker = upper(trim(f.ticker)))")
def company_list(s: SparkSession, d: str) -> DataFrame:
    """Known companies and those that only filings name."""
    seen = table(s, d, "filings", "ticker").where("ticker is not null").select(F.upper(F.trim("ticker")).alias("ticker"), F.lit(None).cast("string").alias("company_name"))
    return status.add_to_list(table(s, d, "companies", "ticker", "company_name"), seen, "ticker")


# ---- series, outcomes and metrics --------------------------------------------------------------------------------

_DAYS = "days AS (SELECT user_id, ts::DATE AS d, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL)"
_TARGETS = "t AS (SELECT event_id, user_id, ts::DATE AS day0, value FROM events WHERE event_type = 'purchase')"


def _days(s: SparkSession, d: str) -> DataFrame:
    return asof.daily_last(table(s, d, "events", "user_id", "ts", "value", "event_id"), "user_id", "ts", "value", "event_id")


def _targets(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "user_id", "ts", "value", "event_type").where("event_type = 'purchase'")
    return e.select("event_id", "user_id", F.to_date("ts").alias("at"), "value")


@query(f"WITH {_DAYS}, {_TARGETS}, q AS (SELECT event_id, user_id, day0 + 7 AS due FROM t) SELECT event_id, due, d AS found_day, close AS found FROM q ASOF LEFT JOIN days ON q.user_id = days.user_id AND q.due <= days.d")
def asof_price(s: SparkSession, d: str) -> DataFrame:
    """The first daily value on or after seven days from each purchase."""
    t = _targets(s, d).select("event_id", "user_id", F.date_add("at", 7).alias("due"))
    return asof.forward_asof(t, _days(s, d), "user_id", "due", "d", "close", "found_day", "found").select("event_id", "due", "found_day", "found")


_RET = f"""{_DAYS}, {_TARGETS}, b AS (SELECT t.*, close AS base FROM t ASOF LEFT JOIN days ON t.user_id = days.user_id AND t.day0 <= days.d),
x AS (SELECT b.*, w AS window_days, (day0 + w::INT)::DATE AS due FROM b, (VALUES (1), (7), (14)) AS v(w)), o AS (SELECT x.*, close AS future FROM x ASOF LEFT JOIN days ON x.user_id = days.user_id AND x.due <= days.d),
ret AS (SELECT *, CASE WHEN base <> 0 THEN (future - base) / base END AS ret FROM o), outc AS (SELECT *, CASE WHEN ret IS NULL THEN 'unknown' WHEN ret > 0.02 THEN 'up' WHEN ret < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM ret)"""


def _returns(s: SparkSession, d: str) -> DataFrame:
    return asof.returns(_targets(s, d), _days(s, d), "user_id", "at", [1, 7, 14])


@query(f"WITH {_RET} SELECT event_id, window_days, base, future, round(ret, 6) AS ret, direction FROM outc")
def multi_window_returns(s: SparkSession, d: str) -> DataFrame:
    """Change after 1, 7 and 14 days from each purchase."""
    return r6(_returns(s, d).select("event_id", "window_days", "base", "future", "ret", "direction"))


_BT = f"{_RET}, bt AS (SELECT event_id, user_id, window_days, (value - 50) / 50 AS score, {_SIGNAL('((value - 50) / 50)')} AS signal, ret, direction FROM outc)"


def _backtest(s: SparkSession, d: str) -> DataFrame:
    score = (F.col("value") - 50) / 50
    return _returns(s, d).select("event_id", "user_id", "window_days", score.alias("score"), scores.signal(score).alias("signal"), "ret", "direction")


@query(f"WITH {_BT} SELECT event_id, window_days, round(score, 6) AS score, signal, round(ret, 6) AS ret, direction FROM bt")
def backtest_rows(s: SparkSession, d: str) -> DataFrame:
    """Signals with their outcomes."""
    return r6(_backtest(s, d).drop("user_id"))


_SM = f"{_BT}, sm AS (SELECT *, CASE WHEN signal LIKE '%BUY' THEN 1 WHEN signal LIKE '%SELL' THEN -1 ELSE 0 END AS s, CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'flat' THEN 0 END AS m FROM bt)"
_SUMMARY = """count(*) AS total, count(m) AS scorable, coalesce(round(count(*) FILTER (WHERE s = m) / nullif(count(m), 0)::DOUBLE, 6), 0) AS hit_rate,
 coalesce(round(count(*) FILTER (WHERE s = m AND s <> 0) / nullif(count(*) FILTER (WHERE s <> 0 AND m <> 0), 0)::DOUBLE, 6), 0) AS directional_accuracy, round(avg(ret), 6) AS avg_return,
 round(CASE WHEN count(ret) >= 2 THEN (avg(ret) - 0.05 / 4) / CASE WHEN stddev_samp(ret) > 0 THEN stddev_samp(ret) ELSE 0.001 END * 2 END, 6) AS sharpe"""


@query(f"WITH {_SM} SELECT {_SUMMARY} FROM sm")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    """Totals, hit rate, directional accuracy and Sharpe ratio of all signals."""
    return r6(metrics.summary(_backtest(s, d)))


@query(f"WITH {_SM} SELECT signal, count(*) FILTER (WHERE s = m) AS correct, count(*) AS total, round(count(*) FILTER (WHERE s = m) / count(*)::DOUBLE, 6) AS precision FROM sm WHERE m IS NOT NULL GROUP BY signal")
def precision_by_signal(s: SparkSession, d: str) -> DataFrame:
    """Share of right signals of each kind."""
    return r6(metrics.precision_by_signal(_backtest(s, d)))


@query(f"WITH {_BT} SELECT signal, round(avg(ret), 6) AS avg_ret, round(min(ret), 6) AS min_ret, round(max(ret), 6) AS max_ret, count(*) AS n FROM bt WHERE ret IS NOT NULL GROUP BY signal")
def return_by_signal(s: SparkSession, d: str) -> DataFrame:
    """Returns after each kind of signal."""
    return r6(metrics.return_by_signal(_backtest(s, d)))


@query(f"""WITH {_SM}, l(x, k) AS (VALUES ('bullish', 1), ('neutral', 0), ('bearish', -1)) SELECT a.x AS predicted, b.x AS actual, count(sm.event_id) AS n FROM l a CROSS JOIN l b LEFT JOIN sm ON sm.s = a.k AND sm.m = b.k GROUP BY ALL""")
def confusion(s: SparkSession, d: str) -> DataFrame:
    """Predicted against actual moves."""
    return metrics.confusion(_backtest(s, d))


@query(f"WITH {_SM} SELECT event_id, window_days, signal, round(ret, 6) AS ret FROM sm WHERE s * m = -1 AND window_days = 7 ORDER BY abs(sm.ret) DESC, event_id LIMIT 5")
def worst_misses(s: SparkSession, d: str) -> DataFrame:
    """The five signals that went wrong most after seven days."""
    return r6(metrics.worst_misses(_backtest(s, d).where("window_days = 7"), "event_id").select("event_id", "window_days", "signal", "ret"))


_TG = f"""{_SM}, cells AS (SELECT (i * 8 + j)::INT AS cell, (i - 8) * 5 / 100.0::DOUBLE AS sell, (j + 1) * 5 / 100.0::DOUBLE AS buy FROM range(8) a(i), range(8) b(j)),
g AS (SELECT cell, sell, buy, count(*) FILTER (WHERE (score >= buy AND m = 1) OR (score < sell AND m = -1)) AS hits, count(*) FILTER (WHERE (score >= buy OR score < sell)) AS total FROM cells, (SELECT score, m FROM sm WHERE m <> 0 AND score IS NOT NULL) GROUP BY ALL),
gg AS (SELECT *, coalesce(round(hits / nullif(total, 0)::DOUBLE, 6), 0) AS accuracy FROM g)"""


@query(f"WITH {_TG} SELECT * FROM gg")
def grid_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Directional accuracy over 64 pairs of thresholds."""
    return r6(metrics.threshold_grid(_backtest(s, d)))


@query(f"WITH {_TG} SELECT cell, hits, total, accuracy FROM gg WHERE accuracy > 0 ORDER BY hits / total DESC, cell LIMIT 1")
def best_thresholds(s: SparkSession, d: str) -> DataFrame:
    """The first best pair."""
    return r6(metrics.first_best(metrics.threshold_grid(_backtest(s, d))).select("cell", "hits", "total", "accuracy"))


_WG = f"""WITH {_RET}, three AS (SELECT *, row_number() OVER () FROM (SELECT (value - 50) / 50 AS c1, least(1.0, greatest(-1.0, (window_days - 7) / 7.0::DOUBLE)) AS c2, (base - 50) / 50 AS c3, CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'flat' THEN 0 END AS m FROM outc)),
cells AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS cell, a / 20.0::DOUBLE AS w1, b / 20.0::DOUBLE AS w2, (20 - a - b) / 20.0::DOUBLE AS w3 FROM range(1, 20) x(a), range(1, 20) y(b) WHERE 20 - a - b >= 1),
z AS (SELECT cell, m, greatest(-1.0, least(1.0, c1 * w1 + c2 * w2 + c3 * w3)) AS x FROM cells, three WHERE m <> 0 AND c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL),
g AS (SELECT cell, count(*) FILTER (WHERE (x >= 0.2 AND m = 1) OR (x < -0.2 AND m = -1)) AS hits, count(*) FILTER (WHERE x >= 0.2 OR x < -0.2) AS total FROM z GROUP BY cell)
SELECT c.cell, w1, w2, w3, coalesce(hits, 0) AS hits, coalesce(total, 0) AS total, coalesce(round(hits / nullif(total, 0)::DOUBLE, 6), 0) AS accuracy FROM cells c LEFT JOIN g ON g.cell = c.cell"""


@query(_WG)
def grid_weights(s: SparkSession, d: str) -> DataFrame:
    """Directional accuracy over 171 triples of weights."""
    r = _returns(s, d).withColumns({"c1": (F.col("value") - 50) / 50, "c2": scores.clamp((F.col("window_days") - 7) / 7.0), "c3": (F.col("base") - 50) / 50})
    return r6(metrics.weight_grid(r, ["c1", "c2", "c3"]))


# ---- retrieval ------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS q_key, x.vec_id, list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])), 1e-10)) AS similarity FROM q, embeddings x WHERE q.vec_id <> x.vec_id)
SELECT q_key, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity > 0) WHERE rank <= 5""")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100, against all."""
    e = table(s, d, "embeddings")
    return r6(retrieval.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS q_key, x.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS similarity FROM q, embeddings x WHERE q.vec_id <> x.vec_id AND q.label = x.label)
SELECT q_key, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity > 0) WHERE rank <= 5""")
def cosine_topk_label(s: SparkSession, d: str) -> DataFrame:
    """The same within one label."""
    e = table(s, d, "embeddings")
    return r6(retrieval.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", same="label"))


@query()
def ann_topk(s: SparkSession, d: str) -> DataFrame:
    """The same over all labels by an inverted file of cosine clusters, half of which are looked into."""
    e = table(s, d, "embeddings")
    return r6(ann.ann_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", probes=32))


_ASK = f"""ask AS (SELECT item_id AS q_key, list_distinct(regexp_extract_all(lower(passage), '[^{_SPACE}]+')) AS w FROM eval_items WHERE item_id % 100 = 0 AND passage IS NOT NULL),
hit AS (SELECT q_key, doc_id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS share FROM ask, documents WHERE len(w) > 0 AND text IS NOT NULL),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY share DESC, doc_id) AS rank FROM hit WHERE share > 0) WHERE rank <= 5)"""


def _keyword(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items", "item_id", "passage").where("item_id % 100 = 0")
    return retrieval.keyword_topk(q, table(s, d, "documents", "doc_id", "text"), "item_id", "passage", "doc_id", "text")


@query(f"WITH {_ASK} SELECT q_key, doc_id, round(share, 6) AS share, rank FROM kt")
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    """The five documents that hold most words of every passage whose id is divisible by 100."""
    return r6(_keyword(s, d))


def _expanded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items", "item_id", "question", "task").where("question is not null")


_ARMS = " || ".join(
    "CASE " + " ".join(f"WHEN contains(lower(question), '{t.lower()}') THEN [" + ", ".join(f"regexp_replace(question, '{t}', '{o}', 'gi')" for o in ts if o.lower() != t.lower()) + "]" for t in ts) + " ELSE []::VARCHAR[] END"
    for ts in SYNONYMS.values()
)


@query(f"SELECT item_id, unnest(range(len(v))) AS n, unnest(v) AS variation FROM (SELECT item_id, list_slice(list_reduce([[x] FOR x IN [question] || {_ARMS}], lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), 1, 3) AS v FROM eval_items WHERE question IS NOT NULL)")
def query_expand(s: SparkSession, d: str) -> DataFrame:
    """Up to three variations of every question."""
    return _expanded(s, d).select("item_id", F.posexplode(retrieval.expansions(F.col("question"))).alias("n", "variation"))


@query(f"WITH {_ASK} SELECT q_key, string_agg('[' || coalesce(source, '') || ' ' || doc_id || ']' || E'\\n' || substring(text, 1, 600), E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM kt JOIN documents USING (doc_id) GROUP BY q_key")
def answer_context(s: SparkSession, d: str) -> DataFrame:
    """The context that a question's best documents make."""
    docs = table(s, d, "documents", "doc_id", "text", "source")
    head = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.col("doc_id").cast("string"))
    return retrieval.answer_context(_keyword(s, d).join(docs, "doc_id"), "q_key", "rank", head, "text")


# ---- joined views and reads -----------------------------------------------------------------------------------------


@query(f"WITH {_SC}, f AS (SELECT DISTINCT filing_id FROM filings), n(section) AS (VALUES ('item_1a'), ('item_7'), ('item_8')), s AS (SELECT filing_id, section, avg(score) AS score FROM sc GROUP BY ALL) SELECT f.filing_id, n.section, round(coalesce(score, 0), 6) AS compound, CASE WHEN score IS NULL THEN 'N/A' ELSE {_SIGNAL('score')} END AS signal FROM f CROSS JOIN n LEFT JOIN s ON s.filing_id = f.filing_id AND s.section = n.section")
def default_sections(s: SparkSession, d: str) -> DataFrame:
    """All three sections of every filing, those that are missing with a score of 0 and no signal."""
    own = _scored(s, d).groupBy("filing_id", "section").agg(F.avg("score").alias("score"))
    names = F.explode(F.array(*[F.lit(x) for x in history.SECTIONS])).alias("section")
    out = table(s, d, "filings", "filing_id").distinct().select("filing_id", names).join(own, ["filing_id", "section"], "left")
    return r6(out.select("filing_id", "section", F.coalesce("score", F.lit(0.0)).alias("compound"), F.coalesce(scores.signal(F.col("score")), F.lit("N/A")).alias("signal")))


@query(f"WITH {_FS} SELECT filing_id, filing_date, signal FROM fs WHERE ticker = '{EXAMPLE_TICKER}' AND filing_date IS NOT NULL ORDER BY filing_date DESC, filing_id DESC LIMIT 50")
def recent_rows(s: SparkSession, d: str, ticker: str = EXAMPLE_TICKER, most: int = 50) -> DataFrame:
    """The newest results of one ticker."""
    return _filings(s, d).where((F.col("ticker") == ticker) & F.col("filing_date").isNotNull()).select("filing_id", "filing_date", "signal").orderBy(F.desc("filing_date"), F.desc("filing_id")).limit(most)


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND text <> '') AS with_text, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT label) FROM embeddings) AS labels")
def index_stats(s: SparkSession, d: str) -> DataFrame:
    """What is indexed."""
    docs = table(s, d, "documents", "text").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"))
    return docs.crossJoin(table(s, d, "embeddings", "label").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("labels")))


@query("SELECT DISTINCT filing_date FROM filings WHERE filing_date IS NOT NULL UNION SELECT filing_date FROM raw_records WHERE filing_date IS NOT NULL")
def status_union(s: SparkSession, d: str) -> DataFrame:
    """All days on which anything was filed or recorded."""
    return table(s, d, "filings", "filing_date").unionByName(table(s, d, "raw_records", "filing_date")).where("filing_date is not null").distinct()
