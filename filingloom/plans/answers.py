"""From questions to answers with sources: expansion, retrieval with fallback, fusion, conversation and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.dictionary import FOLLOW_UPS
from filingloom.operators import history, retrieval
from filingloom.plans.analytics import _ARMS, _SPACE, query, r6
from filingloom.sources.tables import small, table, written

_TOKENS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[^{_SPACE}]+'))"

# ---- conversations: eight items each, a question by the user and a passage in reply --------------------------------

_TURNS = """turns AS (SELECT item_id // 8 AS conv_id, item_id * 2 AS turn, 'user' AS role, question AS content FROM eval_items WHERE question IS NOT NULL
  UNION ALL SELECT item_id // 8, item_id * 2 + 1, 'assistant', passage FROM eval_items WHERE passage IS NOT NULL)"""
_FOLLOW = f"regexp_matches(trim(lower(content)), '^({'|'.join(FOLLOW_UPS)})')"


def _turns(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "eval_items", "item_id", "question", "passage")
    conv = F.floor(F.col("item_id") / 8).cast("long").alias("conv_id")
    said = lambda role, n, c: e.where(F.col(c).isNotNull()).select(conv, (F.col("item_id") * 2 + n).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("content"))
    return said("user", 0, "question").unionByName(said("assistant", 1, "passage"))


@query(f"""WITH {_TURNS}, b AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns)
SELECT conv_id, turn, before, CASE WHEN {_FOLLOW} AND before IS NOT NULL THEN before || ' ' || content ELSE content END AS expanded FROM b WHERE role = 'user'""")
def follow_up_expand(s: SparkSession, d: str) -> DataFrame:
    """Questions of conversations, follow-ups with the user's question before."""
    return retrieval.with_history(_turns(s, d), "conv_id", "turn", "content", "role").where("role = 'user'").drop("content", "role")


@query(f"""WITH {_TURNS}, k AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substring(content, 1, 200), E'\\n' ORDER BY turn) AS history, count(*) AS turns FROM k GROUP BY conv_id""")
def history_window(s: SparkSession, d: str) -> DataFrame:
    """The last ten turns of each conversation in one text, with who spoke."""
    return retrieval.history_window(_turns(s, d), "conv_id", "turn", "content", 10, role="role")


# ---- retrieval -----------------------------------------------------------------------------------------------------

_TOP = lambda hits, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY share DESC, doc_id) AS rank FROM {hits} WHERE share > 0) WHERE rank <= {k}"
_VAR = f"""va AS (SELECT item_id, unnest(range(len(v))) AS n, unnest(v) AS q FROM (SELECT item_id, list_slice(list_reduce([[x] FOR x IN [question] || {_ARMS}], lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), 1, 3) AS v
  FROM eval_items WHERE question IS NOT NULL AND item_id % 100 = 0)),
vw AS (SELECT item_id, n, {_TOKENS('q')} AS w FROM va),
vh AS (SELECT item_id, n, doc_id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS share FROM vw, documents WHERE len(w) > 0 AND text IS NOT NULL),
vk AS (SELECT item_id, doc_id, share FROM vh WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY item_id, n ORDER BY share DESC, doc_id) <= 10),
vm AS (SELECT item_id AS q_key, doc_id, max(share) AS share FROM vk GROUP BY ALL)"""


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items", "item_id", "question").where("item_id % 100 = 0 and question is not null")


@query(f"WITH {_VAR} SELECT q_key, doc_id, round(share, 6) AS share, rank FROM ({_TOP('vm', 5)})")
def fusion(s: SparkSession, d: str) -> DataFrame:
    """The five best documents over up to three variations of every question whose id is divisible by 100."""
    return r6(retrieval.expanded_topk(_asked(s, d), table(s, d, "documents", "doc_id", "text"), "item_id", "question", "doc_id", "text"))


_VEC = """vq AS (SELECT vec_id AS q_key, embedding FROM embeddings WHERE vec_id % 100 = 0), vp AS (SELECT q_key, x.vec_id AS doc_id, list_dot_product(vq.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (greatest(sqrt(list_dot_product(vq.embedding::DOUBLE[], vq.embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])), 1e-10)) AS share FROM vq, embeddings x WHERE vq.q_key <> x.vec_id)"""


@query(f"""WITH {_VEC}, vt AS ({_TOP('vp', 5)}),
ask AS (SELECT doc_id AS q_key, {_TOKENS("concat_ws(' ', ticker, section, source)")} AS w FROM documents WHERE doc_id % 100 = 0),
kh AS (SELECT q_key, doc_id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS share FROM ask, documents WHERE len(w) > 0 AND text IS NOT NULL), kt AS ({_TOP('kh', 5)})
SELECT q_key, doc_id, rank, round(share, 6) AS score, 'vector' AS via FROM vt WHERE q_key IN (SELECT doc_id FROM documents)
UNION ALL SELECT q_key, doc_id, rank, round(share, 6), 'keyword' FROM kt WHERE q_key NOT IN (SELECT q_key FROM vt)""")
def retrieve_fallback(s: SparkSession, d: str) -> DataFrame:
    """Documents like every document whose id is divisible by 100: by vectors where it has one, else by the words of its ticker, section and source."""
    docs, e = table(s, d, "documents", "doc_id", "text", "ticker", "section", "source"), table(s, d, "embeddings", "vec_id", "embedding")
    asked = docs.where("doc_id % 100 = 0").select("doc_id", F.concat_ws(" ", "ticker", "section", "source").alias("question"))
    near = retrieval.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding").join(asked.select(F.col("doc_id").alias("q_key")), "q_key", "left_semi")
    words = retrieval.keyword_topk(asked.select(F.col("doc_id").alias("asked"), "question"), docs, "asked", "question", "doc_id", "text")
    near = near.select("q_key", F.col("vec_id").alias("doc_id"), "rank", F.col("similarity").alias("score"), F.lit("vector").alias("via"))
    return r6(retrieval.fallback(near, words.select("q_key", "doc_id", "rank", F.col("share").alias("score"), F.lit("keyword").alias("via")), "q_key"))


# ---- the whole way -------------------------------------------------------------------------------------------------

#: Share of a question's words that a document must hold to count as found by the whole way.
LEAST_SHARE = 0.35

_RAG = f"""WITH {_TURNS}, b AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns),
qu AS (SELECT turn // 2 AS item_id, CASE WHEN {_FOLLOW} AND before IS NOT NULL THEN before || ' ' || content ELSE content END AS q FROM b WHERE role = 'user'),
qw AS (SELECT item_id AS q_key, {_TOKENS('q')} AS w FROM qu),
kh AS (SELECT q_key, doc_id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS share FROM qw, documents WHERE len(w) > 0 AND text IS NOT NULL), kt AS ({_TOP('kh', 5)}),
ok AS (SELECT kt.*, concat_ws(' ', coalesce(upper(trim(ticker)), ''), coalesce(filing_date::VARCHAR, ''), coalesce(section, '')) AS head, text FROM kt JOIN documents USING (doc_id) WHERE share >= {LEAST_SHARE}),
an AS (SELECT q_key, string_agg('**' || head || ':**' || E'\\n' || substring(text, 1, 500) || E'\\n', E'\\n' ORDER BY rank) FILTER (WHERE rank <= 3) AS ex, string_agg(head || '=' || share::DECIMAL(9,4), ';' ORDER BY rank) AS sources FROM ok GROUP BY q_key)
SELECT qu.item_id, CASE WHEN ex IS NULL THEN '{retrieval.NOTHING}' ELSE E'Based on the filings:\\n\\n' || ex END AS answer, CASE WHEN ex IS NULL THEN 'nothing' ELSE 'excerpts' END AS method, coalesce(sources, '') AS sources FROM qu LEFT JOIN an ON an.q_key = qu.item_id"""


@query(_RAG)
def rag_answers(s: SparkSession, d: str) -> DataFrame:
    """Every question of every conversation, follow-ups expanded, with the best documents as sources and their excerpts as the answer, or a sentence that says there are none."""
    asked = retrieval.with_history(_turns(s, d), "conv_id", "turn", "content", "role").where("role = 'user'").select((F.col("turn") / 2).cast("long").alias("item_id"), "expanded")
    docs = table(s, d, "documents", "doc_id", "text", "ticker", "section", "filing_date")
    best = written(retrieval.keyword_topk(asked, docs, "item_id", "expanded", "doc_id", "text").where(F.col("share") >= LEAST_SHARE).withColumnRenamed("q_key", "item_id"))
    # the few rows found go to the texts, and what they meet is read three times for an answer
    found = written(small(best).join(docs, "doc_id"))
    head = F.concat_ws(" ", F.coalesce(F.upper(F.trim("ticker")), F.lit("")), F.coalesce(F.col("filing_date").cast("string"), F.lit("")), F.coalesce("section", F.lit("")))
    out = retrieval.answers(asked, found, "item_id", "expanded", head, "text", "share")
    named = F.transform("sources", lambda x: F.concat(x["source"], F.lit("="), x["score"].cast("decimal(9,4)").cast("string")))
    return out.select("item_id", "answer", "method", F.array_join(named, ";").alias("sources"))


@query(f"WITH {_TURNS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE text <> '') AS with_text, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM turns) AS turns, true AS indexed")
def engine_status(s: SparkSession, d: str) -> DataFrame:
    """What the retrieval engine has at hand, the turns of conversations too."""
    return retrieval.engine_status(table(s, d, "documents", "text"), "text", table(s, d, "embeddings", "vec_id"), _turns(s, d))


@query("""WITH n AS (SELECT ticker AS t, company_name FROM companies WHERE sector IS NOT NULL), c AS (SELECT ticker AS t, upper(company_name) AS company_name FROM companies)
SELECT DISTINCT f.filing_id, coalesce(n.company_name, c.company_name) AS company_name FROM filings f LEFT JOIN n ON n.t = upper(trim(f.ticker)) LEFT JOIN c ON c.t = upper(trim(f.ticker))""")
def company_lookup(s: SparkSession, d: str) -> DataFrame:
    """Each filing's company: from the records with a sector, else from a list of names in capitals."""
    c = table(s, d, "companies", "ticker", "company_name", "sector")
    f = table(s, d, "filings", "filing_id", "ticker").distinct()
    found = retrieval.company_lookup(f, "ticker", c.where("sector is not null"), c.withColumn("company_name", F.upper("company_name")))
    return found.select("filing_id", "company_name").distinct()


@query("""WITH a AS (SELECT DISTINCT context_id, keyword, anomaly_type, severity, contexts FROM anomaly_contexts)
SELECT context_id, CASE WHEN coalesce(keyword, '') = '' THEN 'Anomaly Detected' ELSE array_to_string(list_transform(string_split(replace(lower(keyword), '_', ' '), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ') END AS title,
  CASE WHEN coalesce(anomaly_type, '') = '' THEN 'General' ELSE array_to_string(list_transform(string_split(replace(lower(anomaly_type), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS category,
  coalesce(nullif(severity, ''), 'medium') AS severity, 'Severity: ' || coalesce(nullif(severity, ''), 'medium') AS severity_reason, 'No additional context available.' AS explanation,
  CASE WHEN contexts IS NULL THEN '' WHEN length(contexts) > 400 THEN substring(contexts, 1, 400) || '...' ELSE contexts END AS context FROM a""")
def anomaly_cards(s: SparkSession, d: str) -> DataFrame:
    """Every anomaly as it is displayed, older fields standing in for missing ones."""
    a = table(s, d, "anomaly_contexts", "context_id", "keyword", "anomaly_type", "severity", "contexts").distinct()
    rows = a.select("context_id", "keyword", F.col("anomaly_type").alias("type"), "severity", F.array("contexts").alias("contexts"))
    return history.shown(rows).withColumn("context", F.coalesce(F.try_element_at("contexts", F.lit(1)), F.lit(""))).drop("contexts")
