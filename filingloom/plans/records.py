"""Queries over the pipeline's own records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.operators import drift, nested
from filingloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change between a sentiment record and the one before it in its run."""
    return drift.schema_changes(table(spark, sf_dir, "raw_records")).select("record_id", "path", "change")


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_records", "record_id", "stage", "loaded_at", "payload").where("stage = 'sentiment' and record_id is not null")
    return drift.with_shape(raw.groupBy("record_id").agg(F.max(F.struct("payload", "loaded_at")).alias("r")).select("record_id", "r.*"))


def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: every shape of a sentiment record with its version number and how many records have it."""
    return drift.registry(_shaped(spark, sf_dir)).select("version", F.size("shape").alias("fields"), "first_loaded", "first_record", "records")


def p2_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that bring each version to the one table."""
    return drift.routes(drift.registry(_shaped(spark, sf_dir))).drop("fingerprint")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentiment records in one set of columns."""
    return drift.one_table(table(spark, sf_dir, "raw_records"))


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule that brought a record into the one table, with its file."""
    return p2_table(spark, sf_dir).select("record_id", "file_name", "version", F.explode("changes").alias("c")).select("record_id", "file_name", "version", "c.*")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every object, array and sentence, with its parent."""
    return nested.links(table(spark, sf_dir, "raw_records"))


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct subtree once."""
    return nested.nodes(nested.links(table(spark, sf_dir, "raw_records"), bodies=True))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table, section and context sentence of each record."""
    return p3_links(spark, sf_dir).where("child in ('table', 'section', 'context')").select("record_id", "child", "item_key")


def _flat(child: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flat_table(nested.links(table(spark, sf_dir, "raw_records"), values=True), child)

    query.__doc__ = f"The flat table of each {child} with its parent."
    return query


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of tables by number, without the identities."""
    return _flat("table")(spark, sf_dir).select("record_id", "item_key", "place", "table_index", "rows", "cols")


def p3_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of labelled sections by key, without the identities."""
    return _flat("section")(spark, sf_dir).select("record_id", "item_key", "place", "label", "signal", "word_count", F.round("compound", 6).alias("compound"))


def queries() -> dict:
    own = {"p2_found": p2_found, "p2_table": p2_table, "p2_rules": p2_rules, "p2_versions": p2_versions, "p2_routes": p2_routes, "p3_found": p3_found, "p3_links": p3_links, "p3_nodes": p3_nodes}
    return own | {"p3_tables": p3_tables, "p3_sections": p3_sections} | {f"p3_{c}_rows": _flat(c) for c in nested.ENTITIES}


# ---- SQL -------------------------------------------------------------------------------------------------------

# the record of each payload: without a byte order mark, and out of a JSON string
_RECORDS = """p0 AS (SELECT DISTINCT record_id, run_id, stage, file_name, filing_date, loaded_at, ltrim(payload, chr(65279)) AS p FROM raw_records WHERE record_id IS NOT NULL),
p1 AS (SELECT * REPLACE (CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN ltrim(p::JSON ->> '$', chr(65279)) ELSE p END AS p) FROM p0),
rec AS (SELECT * FROM p1 WHERE json_valid(p) AND json_type(p) = 'OBJECT')"""
_PLAIN = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_BARE = lambda c: f"regexp_replace({_PLAIN(c)}, '^item', '')"

# every node below the root with its keys, and what it is to p2
_TREE = f"""tree AS MATERIALIZED (SELECT r.record_id, t.id, t.parent, t.key, t.type, t.value FROM rec r, json_tree(r.p::JSON) t),
ends AS (SELECT *, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM tree),
walk AS (WITH RECURSIVE w AS (
  SELECT record_id, id, type, '' AS path, '' AS name, '' AS own, kind FROM ends WHERE parent IS NULL
  UNION ALL
  SELECT e.record_id, e.id, e.type, w.path || CASE WHEN w.type = 'ARRAY' THEN '[]' WHEN w.path = '' THEN e.key ELSE '.' || e.key END,
    w.name || chr(31) || CASE WHEN w.type = 'ARRAY' THEN '[]' ELSE {_BARE('e.key')} END, CASE WHEN w.type = 'ARRAY' THEN '[]' ELSE e.key END, e.kind
  FROM w JOIN ends e ON e.record_id = w.record_id AND e.parent = w.id WHERE e.type <> 'NULL') SELECT * FROM w WHERE path <> '')"""

_P2_FOUND = f"""WITH p0 AS (SELECT record_id, run_id, file_name, filing_date, ltrim(payload, chr(65279)) AS p FROM (SELECT DISTINCT * FROM raw_records WHERE stage = 'sentiment' AND run_id IS NOT NULL AND file_name IS NOT NULL AND filing_date IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY run_id, file_name ORDER BY loaded_at DESC, record_id DESC) = 1),
p1 AS (SELECT * REPLACE (CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN ltrim(p::JSON ->> '$', chr(65279)) ELSE p END AS p) FROM p0),
rec AS (SELECT * FROM p1 WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
{_TREE},
f AS (SELECT record_id, path, first(name ORDER BY id) AS name, first(own ORDER BY id) AS own, first(kind ORDER BY id) AS kind, min(id) AS at FROM walk GROUP BY record_id, path),
pairs AS (SELECT record_id, lag(record_id) OVER (PARTITION BY run_id ORDER BY filing_date, record_id) AS before FROM rec),
met AS (SELECT p.record_id, n.path, n.own, n.kind, o.own AS old_own, o.kind AS old_kind FROM pairs p JOIN f n ON n.record_id = p.record_id LEFT JOIN f o ON o.record_id = p.before AND o.name = n.name WHERE p.before IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p.record_id, n.path ORDER BY o.path IS DISTINCT FROM n.path, o.own IS DISTINCT FROM n.own, o.at) = 1)
SELECT record_id, path, 'added' AS change FROM met WHERE old_own IS NULL
UNION SELECT record_id, path, 'renamed' FROM met WHERE old_own <> own
UNION SELECT record_id, path, 'retyped' FROM met WHERE old_kind <> kind
UNION SELECT p.record_id, o.path, 'removed' FROM pairs p JOIN f o ON o.record_id = p.before WHERE NOT EXISTS (SELECT 1 FROM f n WHERE n.record_id = p.record_id AND n.name = o.name)"""

_P3_FOUND = f"""WITH {_RECORDS},
m AS MATERIALIZED (SELECT r.record_id, t.id, t.type, t.value FROM rec r, json_tree(r.p::JSON, '$.tables.summary') t WHERE r.stage = 'metadata' AND json_type(r.p, '$.tables') = 'OBJECT'),
tables_ AS (SELECT record_id, id FROM m WHERE type = 'OBJECT' AND len(list_filter(json_keys(value), lambda k: {_PLAIN('k')} IN ('index', 'rows', 'cols', 'columns'))) > 0),
sections_ AS (SELECT r.record_id, {_BARE('t.key')} AS k FROM rec r, json_each(r.p::JSON, '$.sections') t WHERE r.stage = 'sentiment' AND json_type(r.p, '$.sections') = 'OBJECT' AND t.type = 'OBJECT'
  AND len(list_filter(json_keys(t.value), lambda k: {_PLAIN('k')} = 'label' AND json_type(json_extract(t.value, '$."' || k || '"')) <> 'NULL')) > 0),
anomalies_ AS (SELECT r.record_id, row_number() OVER (PARTITION BY r.record_id ORDER BY t.id) - 1 AS a, t.value AS v FROM rec r, json_each(r.p::JSON, '$.anomalies') t WHERE r.stage = 'anomalies' AND t.type <> 'NULL' AND json_type(r.p, '$.anomalies') IN ('ARRAY', 'OBJECT')),
within AS MATERIALIZED (SELECT x.record_id, x.a, t.id, t.parent, t.key, t.type, t.value FROM anomalies_ x, json_tree(x.v) t),
deep AS (WITH RECURSIVE w AS (
  SELECT record_id, a, id, type, value, false AS inside FROM within WHERE parent IS NULL
  UNION ALL
  SELECT e.record_id, e.a, e.id, e.type, e.value, w.inside OR (w.type = 'OBJECT' AND {_PLAIN('e.key')} IN ('context', 'contexts'))
  FROM w JOIN within e ON e.record_id = w.record_id AND e.a = w.a AND e.parent = w.id
  WHERE NOT (w.inside AND w.type = 'OBJECT') OR {_PLAIN('e.key')} = 'text' OR len(list_filter(json_keys(w.value), lambda k: {_PLAIN('k')} = 'text')) = 0) SELECT * FROM w WHERE inside AND type = 'VARCHAR')
SELECT record_id, 'table' AS child, (row_number() OVER (PARTITION BY record_id ORDER BY id) - 1)::VARCHAR AS item_key FROM tables_
UNION ALL SELECT record_id, 'section', 'item_' || k FROM sections_
UNION ALL SELECT record_id, 'context', a || '/' || (row_number() OVER (PARTITION BY record_id, a ORDER BY id) - 1) FROM deep"""

_P3_TABLES = f"""WITH {_RECORDS},
m AS MATERIALIZED (SELECT r.record_id, t.id, t.type, t.value, t.fullkey FROM rec r, json_tree(r.p::JSON) t WHERE r.stage = 'metadata' AND json_type(r.p, '$.tables') = 'OBJECT' AND t.type IN ('OBJECT', 'ARRAY')),
n AS (SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY id) - 1)::INT AS place FROM m)
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY id) - 1)::VARCHAR AS item_key, place, try_cast(value ->> '$.index' AS INT) AS table_index, try_cast(value ->> '$.rows' AS INT) AS rows,
  try_cast(coalesce(value ->> '$.cols', value ->> '$.columns') AS INT) AS cols
FROM n WHERE fullkey LIKE '$.tables.summary%' AND type = 'OBJECT' AND len(list_filter(json_keys(value), lambda k: {_PLAIN('k')} IN ('index', 'rows', 'cols', 'columns'))) > 0"""

_P3_SECTIONS = f"""WITH {_RECORDS},
m AS MATERIALIZED (SELECT r.record_id, t.id, t.parent, t.key, t.type, t.value, t.path, t.atom FROM rec r, json_tree(r.p::JSON) t WHERE r.stage = 'sentiment' AND json_type(r.p, '$.sections') = 'OBJECT'),
n AS (SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY id) - 1)::INT AS place FROM m WHERE type IN ('OBJECT', 'ARRAY')),
sec AS (SELECT * FROM n WHERE path = '$.sections' AND type = 'OBJECT'),
v AS (SELECT s.record_id, s.id, s.place, s.key AS section, {_BARE('c.key')} AS k, CASE WHEN c.type = 'OBJECT' THEN NULL ELSE c.value ->> '$' END AS v, NULL AS sub FROM sec s JOIN m c ON c.record_id = s.record_id AND c.parent = s.id WHERE c.type <> 'NULL'
  UNION ALL SELECT s.record_id, s.id, s.place, s.key, {_BARE('c.key')}, d.value ->> '$', {_BARE('d.key')} FROM sec s JOIN m c ON c.record_id = s.record_id AND c.parent = s.id JOIN m d ON d.record_id = c.record_id AND d.parent = c.id WHERE c.type = 'OBJECT' AND d.type NOT IN ('NULL', 'OBJECT', 'ARRAY'))
SELECT record_id, 'item_' || {_BARE('section')} AS item_key, place, coalesce(max(v) FILTER (WHERE k = 'label' AND sub IS NULL), max(v) FILTER (WHERE k = 'label' AND sub = 'name')) AS label, max(v) FILTER (WHERE k = 'signal' AND sub IS NULL) AS signal,
  max(try_cast(v AS INT)) FILTER (WHERE k = 'wordcount' AND sub IS NULL) AS word_count, round(max(try_cast(v AS DOUBLE)) FILTER (WHERE k = 'scores' AND sub = 'compound'), 6) AS compound
FROM v GROUP BY record_id, id, place, section HAVING count(*) FILTER (WHERE k = 'label') > 0"""

_P2_VERSIONS = f"""WITH p0 AS (SELECT record_id, max((payload, loaded_at)) AS m FROM raw_records WHERE stage = 'sentiment' AND record_id IS NOT NULL GROUP BY record_id),
p1 AS (SELECT record_id, m[2] AS loaded_at, ltrim(m[1], chr(65279)) AS p FROM p0),
p2 AS (SELECT * REPLACE (CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN ltrim(p::JSON ->> '$', chr(65279)) ELSE p END AS p) FROM p1),
rec AS (SELECT * FROM p2 WHERE json_valid(p) AND json_type(p) = 'OBJECT'), {_TREE},
f AS (SELECT record_id, path, first(kind ORDER BY id) AS kind FROM walk GROUP BY record_id, path),
shapes AS (SELECT record_id, string_agg(path || ':' || kind, chr(30) ORDER BY path) AS shape, count(*)::INT AS fields FROM f GROUP BY record_id),
g AS (SELECT shape, any_value(fields) AS fields, min((loaded_at, record_id)) AS first, count(*) AS records FROM rec JOIN shapes USING (record_id) GROUP BY shape)
SELECT row_number() OVER (ORDER BY first) AS version, fields, first[1] AS first_loaded, first[2] AS first_record, records FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2_FOUND, "p2_versions": _P2_VERSIONS, "p3_found": _P3_FOUND, "p3_tables": _P3_TABLES, "p3_sections": _P3_SECTIONS}
