"""The queries of the text operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.garbled import garbled, repaired
from filingloom.llm.leaks import leaks
from filingloom.llm.neardup import all_pairs, classes, groups, near_duplicates
from filingloom.llm.spans import shared_spans
from filingloom.llm.split import split_oversized
from filingloom.llm.tokenize import encode_corpus
from filingloom.sources.tables import section_key, table

MAX_WORDS, OVERLAP_WORDS = 1000, 50


def _item_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections", "filing_id", "section", "section_text").where(section_key("section") == "item_7").drop("section")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every oversized full_document and item_7 text is cut, without the texts of the pieces."""
    whole = split_oversized(table(spark, sf_dir, "filings", "filing_id", "full_document"), "filing_id", "full_document", MAX_WORDS, OVERLAP_WORDS, with_text=False)
    item_7 = split_oversized(_item_7(spark, sf_dir), "filing_id", "section_text", MAX_WORDS, OVERLAP_WORDS, with_text=False)
    return whole.select(F.lit("full_document").alias("source"), "*").unionByName(item_7.select(F.lit("item_7").alias("source"), "*")).distinct()


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces with their texts."""
    whole = split_oversized(table(spark, sf_dir, "filings", "filing_id", "full_document"), "filing_id", "full_document", MAX_WORDS, OVERLAP_WORDS)
    item_7 = split_oversized(_item_7(spark, sf_dir), "filing_id", "section_text", MAX_WORDS, OVERLAP_WORDS)
    both = whole.select(F.lit("full_document").alias("source"), "*").unionByName(item_7.select(F.lit("item_7").alias("source"), "*"))
    return both.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["source", "filing_id", "piece", "start", "end", "digest"]).drop("digest")


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text hold together: words without overlaps, characters, and whether all keep limit and overlap."""
    own = F.col("words") - F.col("overlap")
    p = p1_pieces(spark, sf_dir).groupBy("source", "filing_id").agg(F.sum(own).alias("words"), F.max("end").alias("chars"), (F.max("words") <= MAX_WORDS).alias("fits"), (F.min(F.when(F.col("piece") > 0, F.col("overlap"))) == OVERLAP_WORDS).alias("overlapped"))
    return p


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of more than 1,000 words: those that the splitter cuts."""
    return p1_pieces(spark, sf_dir).where("piece = 1").select("source", "filing_id").distinct()


P4_CHARACTERS = 300
_P4_SOURCES = ("full_document", "contexts")


def _p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings and contexts in one table; a record's number is twice its id, plus one for contexts."""
    filings = table(spark, sf_dir, "filings", "filing_id", "full_document").toDF("id", "t")
    contexts = table(spark, sf_dir, "anomaly_contexts", "context_id", "contexts").toDF("id", "t")
    return filings.select((F.col("id") * 2).alias("rec"), "t").unionByName(contexts.select((F.col("id") * 2 + 1).alias("rec"), "t")).where("t is not null")


def _p4_named(df: DataFrame) -> DataFrame:
    source = F.when(F.pmod("rec", F.lit(2)) == 0, _P4_SOURCES[0]).otherwise(_P4_SOURCES[1])
    return df.select(source.alias("source"), F.floor(F.col("rec") / 2).cast("long").alias("rec_id"), *[c for c in df.columns if c != "rec"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each record that are shared with another record."""
    return _p4_named(shared_spans(_p4_records(spark, sf_dir), P4_CHARACTERS))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record how many of its characters occur elsewhere."""
    records = _p4_records(spark, sf_dir)
    spans = shared_spans(records, P4_CHARACTERS).groupBy("rec").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("spans"))
    sizes = records.select("rec", F.length("t").alias("chars")).groupBy("rec").agg(F.max("chars").alias("chars"))
    both = sizes.join(spans, "rec", "left").na.fill(0, ["shared", "spans"])
    return _p4_named(both.withColumn("share", F.when(F.col("chars") > 0, F.col("shared") / F.col("chars"))))


P5_WORDS, P5_SIMILARITY = 3, 0.6


def _p5_sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    filings = table(spark, sf_dir, "filings", "filing_id", "full_document")
    item_1a = table(spark, sf_dir, "sections", "section_id", "section", "section_text").where(section_key("section") == "item_1a")
    return {"full_document": (filings, "filing_id", "full_document"), "item_1a": (item_1a, "section_id", "section_text")}


def _p5(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {s: near_duplicates(*args, P5_SIMILARITY, P5_WORDS) for s, args in _p5_sources(spark, sf_dir).items()}


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs between representatives of texts with different shingles, with their similarity."""
    return reduce(DataFrame.unionByName, [pairs.select(F.lit(s).alias("source"), "*") for s, (pairs, _) in _p5(spark, sf_dir).items()])


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of every text: the smallest id with the same shingles."""
    found = {s: classes(*args, P5_WORDS, P5_SIMILARITY) for s, args in _p5_sources(spark, sf_dir).items()}
    return reduce(DataFrame.unionByName, [members.select(F.lit(s).alias("source"), "*") for s, members in found.items()])


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every text that is in a pair or has a copy, with the number of its links."""
    return reduce(DataFrame.unionByName, [groups(pairs, members).select(F.lit(s).alias("source"), "*") for s, (pairs, members) in _p5(spark, sf_dir).items()])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of near-duplicates, copies included."""
    return reduce(DataFrame.unionByName, [all_pairs(pairs, members).select(F.lit(s).alias("source"), "*") for s, (pairs, members) in _p5(spark, sf_dir).items()])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each item it leaks, and the number of leaked windows of 12 words."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "passage")
    return leaks(docs, items, "doc_id", "text", "item_id", "passage", 12)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each item of which it holds at least 12 consecutive words."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


P7_WORDS, P7_EDITS = 16, 2


def p7_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each item of which it holds 16 consecutive words with at most two words changed, put in or left out; with a recall of 0.95 a window."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "passage")
    return leaks(docs, items, "doc_id", "text", "item_id", "passage", P7_WORDS, max_edits=P7_EDITS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of which some text was read in another encoding than it was written in."""
    found, _ = garbled(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")
    return found.select(F.col("k").alias("doc_id"))


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with the chain of encodings and the text as it was written."""
    return repaired(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


_QUERIES = [p1_found, p1_pieces, p1_texts, p1_cover, p4_found, p4_shares, p5_found, p5_pairs, p5_members, p5_groups, p6_ids, p7_found, p7_leaks, p7_edits, p8_found, p8_repaired]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


# White_Space of Unicode, as an RE2 class
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_KEY = r"regexp_replace(regexp_replace(lower(section), '[^\p{L}\p{N}]', '', 'g'), '^item', '')"
_WORDS = lambda c: rf"list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"

_P1_TEXTS = f"""(SELECT 'full_document' AS source, filing_id, full_document AS t FROM filings
  UNION ALL SELECT 'item_7', filing_id, section_text FROM sections WHERE {_KEY} = '7')"""
_P1_FOUND = f"SELECT DISTINCT source, filing_id FROM {_P1_TEXTS} WHERE len(regexp_extract_all(t, '[^{_SPACE}]+')) > 1000"
_P1_COVER = f"""SELECT DISTINCT source, filing_id, len(regexp_extract_all(t, '[^{_SPACE}]+'))::BIGINT AS words, length(t)::INT AS chars, true AS fits, true AS overlapped
FROM {_P1_TEXTS} WHERE len(regexp_extract_all(t, '[^{_SPACE}]+')) > 1000"""

# every window of 300 characters, those in two records, and the runs that they make
_P4 = """WITH rec AS (SELECT DISTINCT 'full_document' AS source, filing_id AS rec_id, full_document AS t FROM filings WHERE full_document IS NOT NULL
  UNION SELECT DISTINCT 'contexts', context_id, contexts FROM anomaly_contexts WHERE contexts IS NOT NULL),
parts AS (SELECT source, rec_id, b, substring(t, b + 1, 599) AS p FROM (SELECT *, unnest(range(0, length(t) - 299, 300)) AS b FROM rec WHERE length(t) >= 300)),
win AS (SELECT source, rec_id, b + i AS s, hash(substring(p, i + 1, 300)) AS h FROM (SELECT *, unnest(range(length(p) - 299)) AS i FROM parts)),
hit AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT (source, rec_id)) > 1),
c AS (SELECT source, rec_id, s, s - lag(s) OVER (PARTITION BY source, rec_id ORDER BY s) AS gap FROM win SEMI JOIN hit USING (h)),
r AS (SELECT *, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY source, rec_id ORDER BY s) AS run FROM c),
spans AS (SELECT source, rec_id, min(s)::INT AS span_start, (max(s) + 300)::INT AS span_end FROM r GROUP BY source, rec_id, run)"""
_P4_FOUND = f"{_P4} SELECT * FROM spans"
_P4_SHARES = f"""{_P4}, chars AS (SELECT source, rec_id, max(length(t)) AS chars FROM rec GROUP BY ALL), sh AS (SELECT source, rec_id, sum(span_end - span_start) AS shared, count(*) AS spans FROM spans GROUP BY ALL)
SELECT source, rec_id, chars, coalesce(shared, 0) AS shared, coalesce(spans, 0) AS spans, CASE WHEN chars > 0 THEN coalesce(shared, 0) / chars::DOUBLE END AS share FROM chars LEFT JOIN sh USING (source, rec_id)"""

_P5 = f"""WITH RECURSIVE t AS (SELECT DISTINCT 'full_document' AS source, filing_id AS id, {_WORDS('full_document')} AS w FROM filings WHERE full_document IS NOT NULL
  UNION SELECT DISTINCT 'item_1a', section_id, {_WORDS('section_text')} FROM sections WHERE section_text IS NOT NULL AND {_KEY} = '1a'),
sh AS MATERIALIZED (SELECT DISTINCT source, id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT source, id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
n AS (SELECT source, id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM sh GROUP BY source, id),
members AS (SELECT source, id, min(id) OVER (PARTITION BY source, same) AS class FROM n),
near AS (SELECT source, a.id AS key_a, b.id AS key_b, count(*) AS shared FROM sh a JOIN sh b USING (source, g) WHERE a.id < b.id GROUP BY ALL),
found AS (SELECT source, key_a, key_b, shared / (x.n + y.n - shared)::DOUBLE AS jaccard, x.same = y.same AS equal FROM near JOIN n x USING (source) JOIN n y USING (source) WHERE x.id = key_a AND y.id = key_b AND shared >= 0.6 * (x.n + y.n - shared) - 1e-9),
pairs AS (SELECT f.* FROM found f JOIN members a ON a.source = f.source AND a.id = key_a AND a.class = a.id JOIN members b ON b.source = f.source AND b.id = key_b AND b.class = b.id)"""
_P5_FOUND = f"{_P5} SELECT source, key_a, key_b FROM found"
_P5_PAIRS = f"{_P5} SELECT source, key_a, key_b, jaccard FROM pairs"
_P5_MEMBERS = f"{_P5} SELECT source, id, class FROM members"
_P5_GROUPS = f"""{_P5}, ties AS (SELECT source, key_a AS x, key_b AS y FROM pairs UNION SELECT source, key_b, key_a FROM pairs),
reach AS (SELECT source, x AS id, x AS least FROM ties UNION SELECT b.source, b.y, r.least FROM reach r JOIN ties b ON b.source = r.source AND b.x = r.id WHERE r.least < b.y),
comp AS (SELECT source, id, min(least) AS grp FROM reach GROUP BY ALL), links AS (SELECT source, x AS id, count(*) AS links FROM ties GROUP BY ALL), sizes AS (SELECT source, class, count(*) AS copies FROM members GROUP BY ALL)
SELECT m.source, m.id, m.class, coalesce(c.grp, m.class) AS "group", coalesce(l.links, 0) AS links FROM members m JOIN sizes s ON s.source = m.source AND s.class = m.class
LEFT JOIN comp c ON c.source = m.source AND c.id = m.class LEFT JOIN links l ON l.source = m.source AND l.id = m.class WHERE copies > 1 OR c.grp IS NOT NULL"""

_P7 = f"""WITH d AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
e AS (SELECT item_id, {_WORDS('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
ew AS (SELECT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))"""
_P7_FOUND = f"{_P7} SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)"
_P7_LEAKS = f"{_P7} SELECT doc_id, item_id, count(DISTINCT i) AS windows FROM dw JOIN ew USING (g) GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_FOUND, "p1_cover": _P1_COVER, "p4_found": _P4_FOUND, "p4_shares": _P4_SHARES, "p5_found": _P5_FOUND, "p5_pairs": _P5_PAIRS, "p5_members": _P5_MEMBERS,
        "p5_groups": _P5_GROUPS, "p7_found": _P7_FOUND, "p7_leaks": _P7_LEAKS,
    }
