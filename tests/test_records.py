import datetime as dt
import json
import random

import pytest

from filingloom.functions.records import bare, read_record, shape
from filingloom.operators import drift, nested

SCHEMA = "record_id long, run_id long, stage string, file_name string, ticker string, filing_date date, loaded_at timestamp, payload string, path string, node string"


def raw(spark, rows):
    """rows: (record_id, run_id, stage, file_name, day, loaded, payload)"""
    base = dt.date(2020, 1, 1)
    full = [(i, r, s, f, " ab ", base + dt.timedelta(d) if d is not None else None, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m) if m is not None else None, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for i, r, s, f, d, m, p in rows]
    return spark.createDataFrame(full, SCHEMA)


def changes(spark, *records):
    rows = [(i, 1, "sentiment", f"f{i}", i * 20, 0, r) for i, r in enumerate(records)]
    return sorted(tuple(r)[0:1] + tuple(r)[2:] for r in drift.schema_changes(raw(spark, rows)).collect())


def test_read_record():
    bom = chr(0xFEFF)
    assert read_record(bom + '{"a": 1}') == {"a": 1} == read_record(json.dumps('{"a": 1}')) == read_record(bom + json.dumps('{"a": 1}'))
    for bad in (None, "", '{"a": ', "[1]", "3", '"x"', "[" * 100000):
        assert read_record(bad) is None
    nest = lambda n: '{"a":' * n + "1" + "}" * n
    assert all(read_record(nest(n)) is not None for n in (199, 400, 50_000)) and read_record(nest(50_000)[:-1]) is None
    assert bare("Item 1A") == bare("item_1a") == bare("1a") == "1a"


def test_each_kind_of_change(spark):
    a = {"sections": {"1a": {"signal": "BUY", "n": 1, "gone": [1, 2]}}, "none": None}
    b = {"sections": {"item_1a": {"signal": 1, "N": "1"}}, "log": [{"x": 1}, {"y": None}, None]}
    assert changes(spark, a, a, b) == [
        (2, "log", "added"),
        (2, "log[]", "added"),
        (2, "log[].x", "added"),
        (2, "sections.1a.gone", "removed"),
        (2, "sections.1a.gone[]", "removed"),
        (2, "sections.item_1a", "renamed"),
        (2, "sections.item_1a.N", "renamed"),
        (2, "sections.item_1a.N", "retyped"),
        (2, "sections.item_1a.signal", "retyped"),
    ]


def test_only_the_newest_load_counts(spark):
    rows = [
        (1, 1, "sentiment", "a", 0, 0, {"x": 1}),
        (2, 1, "sentiment", "b", 1, 0, {"x": 1, "old": 1}),
        (3, 1, "sentiment", "b", 1, 5, {"x": 1, "new": 1}),
        (3, 1, "sentiment", "b", 1, 5, {"x": 1, "new": 1}),
        (4, 1, "sentiment", "c", 2, 0, {"x": 1}),
        (5, 1, "sentiment", "c", 2, 1, '{"x": 1'),
        (6, 1, "sentiment", "d", 3, 1, {"x": "s", "new": 1}),
        (7, 1, "metadata", "e", 2, 1, {"q": 1}),
        (8, 2, "sentiment", "a", 2, 1, {"z": 1}),
        (9, None, "sentiment", None, None, None, None),
    ]
    got = sorted((r.record_id, r.path, r.change) for r in drift.schema_changes(raw(spark, rows)).collect())
    assert got == [(3, "new", "added"), (6, "x", "retyped")]
    assert drift.schema_changes(raw(spark, [])).collect() == []


def test_long_run_against_a_loop(spark):
    rng = random.Random(1)
    rows, last, want = [], None, set()
    for i in range(300):
        record = {k: 1 for k in "abcdef" if rng.random() < 0.5} or {"a": 1}
        rows.append((i, 7, "sentiment", f"f{i}", i * 9, 0, record))
        if last is not None:
            want |= {(i, k, "added") for k in record.keys() - last.keys()} | {(i, k, "removed") for k in last.keys() - record.keys()}
        last = record
    assert {(r.record_id, r.path, r.change) for r in drift.schema_changes(raw(spark, rows)).collect()} == want


def test_one_table(spark):
    old = {"sections": {"7": {"scores": {"compound": "0.5", "chunks_analyzed": 2}, "signal": 1, "wordCount": 10, "label": {"name": "positive", "rank": 1}, "odd": True, "many": [1, 2]}}}
    new = {"ticker": "AB", "sections": {"item_7": {"scores": {"compound": 0.5, "num_chunks": 2}, "signal": "BUY", "word_count": 10, "label": "positive"}}}
    rows = {r.record_id: r for r in drift.one_table(raw(spark, [(1, 1, "sentiment", "a", 0, 0, old), (2, 1, "sentiment", "b", 0, 1, new), (2, 1, "sentiment", "b", 0, 1, new), (3, 1, "sentiment", "c", 0, 0, None)])).collect()}
    assert set(rows) == {1, 2} and (rows[1].version, rows[2].version) == (1, 2)
    same = [n for n, _ in drift.target_columns() if n not in ("item_7_label_rank",)]
    assert [rows[1][n] for n in same] == [rows[2][n] for n in same]
    assert rows[1].rest == {"sections.7.odd": "True", "sections.7.many[]": "1,2"} and rows[2].changes == []
    assert {c.rule for c in rows[1].changes} == {"alias", "rename", "cast", "default"}
    assert rows[1].item_1a_signal is None


def test_one_table_loses_nothing(spark):
    record = {"sections": {"7": {"word_count": "many"}, "item_7": {"word_count": 5}, "Item 7": {"word_count": 6}}, "x": [{"y": 1}, {"y": "b"}], "z": {"q": None}}
    r = drift.one_table(raw(spark, [(1, 1, "sentiment", "a", 0, 0, record)])).first()
    assert r.item_7_word_count == 5 and r.rest == {"sections.7.word_count": "many", "sections.Item 7.word_count": "6", "x[].y": "1,b"}


def test_versions_are_kept(spark):
    shaped = lambda *records: drift.with_shape(raw(spark, [(i, 1, "sentiment", "f", 0, i, r) for i, r in enumerate(records)]).select("record_id", "loaded_at", "payload"))
    first = drift.registry(shaped({"a": 1, "b": 2}, {"b": 1, "a": 2}, {"a": "x"}))
    assert [(r.version, r.records, r.first_record) for r in first.orderBy("version").collect()] == [(1, 2, 0), (2, 1, 2)]
    later = drift.registry(shaped({"c": 1}, {"a": "y"}, {"d": 1}), first)
    assert [(r.version, r.records, [f.path for f in r["shape"]]) for r in later.orderBy("version").collect()] == [(1, 2, ["a", "b"]), (2, 2, ["a"]), (3, 1, ["c"]), (4, 1, ["d"])]
    assert drift.registry(shaped()).count() == 0


def test_routes_are_the_steps_to_the_target(spark):
    version = [dict(zip(("path", "name", "own", "kind"), f)) for f in shape({"sections": {"Item 7": {"signal": 2, "label": {"name": "x"}}}, "zz": 1})]
    rules = drift.route(version)
    assert [r[:3] for r in rules if r[0] != "default"] == [
        ("rename", "sections.Item 7.signal", "item_7_signal"), ("cast", "sections.Item 7.signal", "item_7_signal"),
        ("alias", "sections.Item 7.label.name", "item_7_label"), ("rename", "sections.Item 7.label.name", "item_7_label"), ("keep", "sections.Item 7.label.name", "item_7_label"),
        ("rest", "zz", ""),
    ]
    assert {r[2] for r in rules if r[0] == "default"} == {c for c, _ in drift.target_columns()} - {"item_7_signal", "item_7_label"}


def found(spark, stage, record):
    got = nested.links(raw(spark, [(1, 1, stage, "a", 0, 0, record), (1, 1, stage, "a", 0, 0, record)]))
    return sorted((r.child, r.item_key) for r in got.collect() if r.child in ("table", "section", "context"))


@pytest.mark.parametrize(
    "summary, n",
    [
        ([], 0), (None, 0), ({}, 0),
        ([{"index": 0, "rows": 1}, None, {"cols": 2, "merged": [{"row": 0, "span": 2}]}], 2),
        ({"0": {"index": 0}, "1": {"rows": None, "cols": 3}}, 2),
        ([{"page": 3, "tables": [{"index": 0}, {"index": 1}]}, {"page": 5, "tables": []}], 2),
    ],
)
def test_tables(spark, summary, n):
    assert found(spark, "metadata", {"tables": {"summary": summary}, "sections": {"metadata": {"label": "x"}}}) == [("table", str(i)) for i in range(n)]


def test_sections_and_contexts(spark):
    sections = {"Item 1A": {"label": "a"}, "7": {"label": None}, "item8": {"label": {"name": "b"}}, "x": 3, "y": None}
    assert found(spark, "sentiment", {"sections": sections}) == [("section", "item_1a"), ("section", "item_8")]
    anomalies = [{"context": ["s", None, "s"]}, {"contexts": []}, None, {"evidence": {"contexts": [{"text": "t", "offset": 1}]}, "context": {"item_1a": ["u"], "item_7": []}}, {"context": "v", "type": "w"}]
    assert found(spark, "anomalies", {"anomalies": anomalies}) == [("context", k) for k in ("0/0", "0/1", "2/0", "2/1", "3/0")]
    assert found(spark, "anomalies", {"anomalies": None}) == []


def test_nulls_and_long_payloads(spark):
    rows = [(None, 1, "metadata", "a", 0, 0, {"tables": {"summary": [{"rows": 1}]}}), (1, None, None, None, None, None, None), (2, 1, "metadata", None, None, None, {"tables": {"summary": [{"index": i} for i in range(5000)]}, "text": "x" * 300000}), (3, 1, "anomalies", "b", 0, 0, '{"anomalies": [{"context": "' )]
    got = nested.links(raw(spark, rows)).where("child = 'table'")
    assert {r.record_id for r in got.collect()} == {2} and got.count() == 5000
    assert drift.schema_changes(raw(spark, rows)).count() == 0 and drift.one_table(raw(spark, rows)).count() == 0
    assert nested.links(raw(spark, [])).count() == 0 and drift.one_table(raw(spark, [])).count() == 0


def test_equal_subtrees_have_one_identity(spark):
    rows = [(i, 1, "metadata", "a", 0, 0, {"tables": {"summary": s}}) for i, s in enumerate([[{"index": 0, "rows": 2}], [{"rows": 2, "index": 0}, {"index": 1}]])]
    linked = nested.links(raw(spark, rows), bodies=True, values=True).cache()
    stored = {r.body: r.occurrences for r in nested.nodes(linked).collect()}
    assert stored['{"index":0,"rows":2}'] == 2 and stored['{"index":1}'] == 1
    assert {(r.record_id, r.parent, r.rows) for r in nested.flat_table(linked, "table").collect()} == {(0, 0, 2), (1, 0, 2), (1, 0, None)}
    text = nested.links(raw(spark, [(1, 1, "anomalies", "a", 0, 0, {"anomalies": [{"context": 'say "x"'}]})]), values=True)
    assert [(r.sentence, r.item_key, r.parent) for r in nested.flat_table(text, "context").collect()] == [('say "x"', "0/0", 2)]


def test_records_come_back_from_nodes_and_hashes(spark):
    rng = random.Random(3)

    def value(d):
        k = rng.random()
        if d == 0 or k < 0.3:
            return rng.choice([1, 2.5, "a", None, True, "", "x"])
        if k < 0.6:
            return [value(d - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["index", "text", "contexts", "a.b", "label", "#"]): value(d - 1) for _ in range(rng.randint(0, 3))}

    for stage, top in (("metadata", "tables"), ("sentiment", "sections"), ("anomalies", "anomalies")):
        for _ in range(60):
            record = {top: value(5), "other": value(3)}
            if stage == "metadata":
                record[top] = {"summary": record[top]}
            rows = nested.flatten(1, stage, json.loads(json.dumps(record)))
            bodies = {r[8]: r[9] for r in rows}

            def back(node):
                body = json.loads(bodies[node])
                mend = lambda x: back(x["#"]) if isinstance(x, dict) else x
                return {k: mend(x) for k, x in body.items()} if isinstance(body, dict) else [mend(x) for x in body] if isinstance(body, list) else body

            assert back(rows[0][8]) == record
            # every value that is no container is a field of one entity
            leaves = lambda v: sum(map(leaves, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) and v else 1
            assert sum(len(r[10] or ()) for r in rows) == leaves(record)
            assert all(r[4] is None or rows[r[4]][3] < r[3] for r in rows)


def test_a_table_within_a_table_names_the_outer_one(spark):
    summary = [{"index": 0, "inner": [{"rows": 2, "merged": [{"row": 1}], "Columns": 4.0}]}]
    linked = nested.links(raw(spark, [(1, 1, "metadata", "a", 0, 0, {"tables": {"summary": summary}})]), values=True)
    rows = {r.item_key: r for r in nested.flat_table(linked, "table").collect()}
    assert rows["1"].parent == rows["0"].place and rows["0"].parent == 0
    assert rows["1"].cols == 4 and rows["1"].rest == {"merged[0].row": "1"}
    assert nested.flat_table(linked, "record").first().rest == {}


def test_values_of_another_type_and_second_spellings_stay_in_rest(spark):
    sections = {"7": {"label": {"name": "x", "why": "y"}, "wordCount": "ten", "Word_Count": 10, "signal": None}}
    r = nested.flat_table(nested.links(raw(spark, [(1, 1, "sentiment", "a", 0, 0, {"sections": sections})]), values=True), "section").first()
    assert (r.label, r.word_count, r.rest) == ("x", 10, {"label.why": "y", "wordCount": "ten", "signal": None})
