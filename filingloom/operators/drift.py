"""Schemas that drift between files (problem 2).

Method: versioned schema fingerprints with explicit migration steps. A record's shape (paths and types) has a 64-bit
fingerprint; :func:`registry` stores every distinct shape once, with a version number, and keeps the numbers of
shapes that it knew before. Between two versions there are explicit steps (added, removed, renamed, retyped), worked
out once for each pair of fingerprints and never for each record:

* a file's changes are the steps from the fingerprint of the file before it to its own (:func:`schema_changes`);
* the one table is a version too (:func:`target_shape`), and each fingerprint has its route to it (:func:`routes`): the steps
  from its shape to the target, as chained rules - alias, rename, default, cast. A file is routed by its
  fingerprint, its values follow the rules, and each rule that fires is recorded (:func:`one_table`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.records import bare, fields, kind_of, read_record, shape, written_path
from filingloom.operators.history import previous_in
from filingloom.sources.tables import numbered, small, written

_SHAPE = "array<struct<path:string,name:string,own:string,kind:string>>"


def latest_files(raw: DataFrame, stage: str) -> DataFrame:
    """Of the rows of one run and file name only the one loaded last (of two loaded together, the higher record_id).

    Rows without run_id, file_name or filing_date have no place in a run and are left out. The newest row is
    kept by a partial aggregate before the shuffle, so a hot run or file is reduced on the map side.
    """
    place = raw.where((F.col("stage") == stage) & F.col("run_id").isNotNull() & F.col("file_name").isNotNull() & F.col("filing_date").isNotNull())
    newest = F.max_by(F.struct("record_id", "filing_date", "loaded_at", "payload"), F.struct("loaded_at", "record_id"))
    return place.groupBy("run_id", "file_name").agg(newest.alias("r")).select("run_id", "file_name", "r.*")


def with_shape(files: DataFrame) -> DataFrame:
    """The rows whose payload is a record, with ``shape`` and ``fingerprint``; the order of keys is no difference between shapes."""
    kept = [c for c in files.columns if c not in ("shape", "fingerprint")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            shapes = [shape(r) if (r := read_record(p)) is not None else None for p in f["payload"]]
            f = f.assign(shape=pd.Series(shapes, index=f.index, dtype=object))
            yield f[[s is not None for s in shapes]]

    schema = ", ".join(f"`{c}` {t}" for c, t in files.select(kept).dtypes)
    out = files.select(kept).mapInPandas(run, f"{schema}, shape {_SHAPE}")
    return out.withColumn("fingerprint", F.xxhash64(F.to_json(F.array_sort(F.col("shape")))))


def registry(shaped: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(fingerprint, version, shape, first_loaded, first_record, records)``: every distinct shape once.

    Versions count from 1 in the order in which shapes were first loaded (of two loaded together, by the record_id);
    fingerprints in ``known``, a registry written before, keep their versions, and new ones get the numbers after them.
    """
    first = F.min(F.struct("loaded_at", "record_id"))
    seen = shaped.groupBy("fingerprint").agg(F.first("shape").alias("shape"), first.alias("_f"), F.count("*").alias("records"))
    seen = seen.select("fingerprint", "shape", F.col("_f.loaded_at").alias("first_loaded"), F.col("_f.record_id").alias("first_record"), "records")
    columns = ["fingerprint", "version", "shape", "first_loaded", "first_record", "records"]
    if known is None:
        return numbered(seen, ["first_loaded", "first_record"], "version").withColumn("version", F.col("version") + 1).select(columns)
    top = known.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    fresh = numbered(seen.join(known.select("fingerprint"), "fingerprint", "left_anti"), ["first_loaded", "first_record"], "version")
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn("version", F.col("version") + F.col("top") + 1).select(columns)
    again = seen.select("fingerprint", F.col("records").alias("_more"))
    old = known.join(again, "fingerprint", "left").withColumn("records", F.col("records") + F.coalesce("_more", F.lit(0))).select(columns)
    return old.unionByName(fresh)


def compare(before: list[Any], now: list[Any]) -> list[tuple[str, str, str]]:
    """The steps from one shape to another as ``(path, change, path before)``.

    If several fields of the record before have the name, the one written alike is taken, else the first.
    """
    old: dict[str, list[Any]] = {}
    for f in before:
        old.setdefault(f["name"], []).append(f)
    names = {f["name"] for f in now}
    changes = []
    for f in now:
        if not (same := old.get(f["name"])):
            changes.append((f["path"], "added", ""))
            continue
        was = min(same, key=lambda o: (o["path"] != f["path"], o["own"] != f["own"]))
        if was["own"] != f["own"]:
            changes.append((f["path"], "renamed", was["path"]))
        if was["kind"] != f["kind"]:
            changes.append((f["path"], "retyped", was["path"]))
    return changes + [(f["path"], "removed", f["path"]) for f in before if f["name"] not in names]


def steps(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """``(before, fingerprint, path, change, path_before)`` of pairs ``(before, fingerprint)`` of fingerprints in a registry."""
    old = store.select(F.col("fingerprint").alias("before"), F.col("shape").alias("old"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, n, *step) for b, n, o, s in zip(f["before"], f["fingerprint"], f["old"], f["shape"]) for step in compare(list(o), list(s))]
            yield pd.DataFrame(rows, columns=["before", "fingerprint", "path", "change", "path_before"])

    both = pairs.join(old, "before").join(store.select("fingerprint", "shape"), "fingerprint").select("before", "fingerprint", "old", "shape")
    return both.mapInPandas(run, "before long, fingerprint long, path string, change string, path_before string")


def schema_changes(raw: DataFrame, stage: str = "sentiment") -> DataFrame:
    """``(record_id, file_name, path, change)``: how each record differs from the one before it in its run.

    ``change`` is added, removed, renamed or retyped. Only the newest load of a file counts, and a file whose
    newest payload is no record (null, cut short, not an object) is passed over; a run's first record has no
    changes. Two records of one run and day are ordered by record_id. Repeated rows give no repeated changes; an
    empty table gives an empty one; other columns are ignored.
    """
    # read once: the shapes are used for the links and for the registry
    files = written(with_shape(latest_files(raw, stage)).drop("payload"))
    linked = previous_in(files.select("run_id", "file_name", "record_id", "filing_date", "fingerprint"), "run_id", ["filing_date", "record_id"], F.col("fingerprint"), "before")
    moved = linked.where("before is not null and before <> fingerprint")
    store = files.groupBy("fingerprint").agg(F.first("shape").alias("shape"))
    found = steps(moved.select("before", "fingerprint").distinct(), store)
    return moved.join(found, ["before", "fingerprint"]).select("record_id", "file_name", "path", "change").distinct()


# ---- one table -----------------------------------------------------------------------------------------------

SECTIONS = ("1a", "7", "8")
# The target version: the path of each field and its column, types by column, section fields once for each section.
_SECTION = {"file": "file", "signal": "signal", "label": "label", "label_rank": "label_rank", "scores.compound": "compound", "scores.positive": "positive", "scores.negative": "negative", "scores.neutral": "neutral", "scores.num_chunks": "num_chunks", "word_count": "word_count", "confidence": "confidence"}
_RECORD = {"ticker": "ticker", "overall.compound": "overall_compound", "overall.signal": "overall_signal", "schema_version": "schema_version", "migrated_at": "migrated_at"}
_TYPES = {"compound": "double", "positive": "double", "negative": "double", "neutral": "double", "overall_compound": "double", "confidence": "double", "num_chunks": "int", "word_count": "int", "label_rank": "int", "schema_version": "int"}
# Names (bare keys) under which fields of the target have been written too; within a section, or of the record.
ALIASES = {"label.name": "label", "label.rank": "labelrank", "scores.chunksanalyzed": "scores.numchunks"}
RECORD_ALIASES = {"migrated.date": "migratedat"}
# Signals that some files write as numbers.
SIGNAL_CODES = {"2": "STRONG_BUY", "1": "BUY", "0": "HOLD", "-1": "SELL", "-2": "STRONG_SELL"}


def _named(path: str) -> str:
    return "\x1f".join(bare(k) for k in path.split("."))


def target() -> dict[str, tuple[str, str, str]]:
    """The target version: ``path: (name, column, type)``."""
    out = {p: (_named(p), c, _TYPES.get(c, "string")) for p, c in _RECORD.items()}
    for s in SECTIONS:
        out |= {f"sections.item_{s}.{p}": (_named(f"sections.{s}.{p}"), f"item_{s}_{c}", _TYPES.get(c, "string")) for p, c in _SECTION.items()}
    return out


def target_columns() -> list[tuple[str, str]]:
    """The columns of the one table after the keys, with their types."""
    return [(column, kind) for _, column, kind in target().values()]


def target_shape() -> list[dict[str, str]]:
    return [{"path": p, "name": name, "own": p.split(".")[-1], "kind": "string" if kind == "string" else "number"} for p, (name, _, kind) in target().items()]


def _aliased(name: str) -> str:
    """The name in the target of a field of this name."""
    keys = name.split("\x1f")
    if keys[0] == "sections" and len(keys) > 2:
        return "\x1f".join(keys[:2] + ALIASES.get(".".join(keys[2:]), ".".join(keys[2:])).split("."))
    return RECORD_ALIASES.get(".".join(keys), ".".join(keys)).replace(".", "\x1f")


def route(version: list[Any]) -> list[tuple[str, str, str, str]]:
    """The chained rules ``(rule, path, column, type)`` that bring a shape to the target.

    ``alias`` (a field known by another name), ``rename`` (its path is written otherwise), ``cast`` (its type differs), ``keep`` (as
    it is), ``default`` (the target has it and the shape doesn't), ``rest`` (the target doesn't have it). Rules of one path are in the order
    in which they are applied; of several fields for one column the first in the target's own spelling counts first.
    """
    ends = target()
    by_name = {name: (p, c, kind) for p, (name, c, kind) in ends.items()}
    leaves = [f for f in version if f["kind"] not in ("object", "array")]
    mapped = [{**dict(f), "name": _aliased(f["name"])} if "[]" not in f["path"] else dict(f) for f in leaves]
    found: list[tuple[str, str, str, str]] = []
    changed: dict[str, set[str]] = {}
    for path, change, before in compare(mapped, target_shape()):
        changed.setdefault(path, set()).add(change)
    for old, f in sorted(zip(leaves, mapped), key=lambda x: x[1]["path"] not in ends):
        if f["name"] not in by_name or "[]" in f["path"]:
            found.append(("rest", f["path"], "", f["kind"]))
            continue
        path, column, kind = by_name[f["name"]]
        if old["name"] != f["name"]:
            found.append(("alias", f["path"], column, kind))
        if f["path"] != path:
            found.append(("rename", f["path"], column, kind))
        found.append(("cast" if f["kind"] != ("string" if kind == "string" else "number") else "keep", f["path"], column, kind))
    return found + [("default", path, ends[path][1], ends[path][2]) for path, c in changed.items() if "added" in c]


def routes(store: DataFrame) -> DataFrame:
    """``(fingerprint, version, rule, path, column, type)``: the route of every fingerprint of a registry to the target."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, v, n, *r) for p, v, s in zip(f["fingerprint"], f["version"], f["shape"]) for n, r in enumerate(route(list(s)))]
            yield pd.DataFrame(rows, columns=["fingerprint", "version", "step", "rule", "path", "column", "type"])

    return store.select("fingerprint", "version", "shape").mapInPandas(run, "fingerprint long, version long, step int, rule string, path string, column string, type string")


def _cast(value: Any, kind: str, column: str) -> tuple[Any, bool]:
    """The value as ``kind`` and whether that was possible."""
    if column.endswith("signal") and not isinstance(value, str):
        value = SIGNAL_CODES.get(str(value), str(value))
    try:
        if kind == "string":
            return str(value), True
        number = float(value)
        if kind == "double":
            return number, True
        return (int(number), True) if number == int(number) and abs(number) < 2**31 else (None, False)
    except (TypeError, ValueError, OverflowError):
        return None, False


def follow(record: dict[str, Any], rules: list[tuple[str, str, str, str]], ticker: str | None) -> tuple[dict[str, Any], dict[str, str], list[tuple[str, str, str, str]]]:
    """A record's columns by the rules of its route, what has no column, and the rules that fired as ``(rule, path, from, to)``."""
    values: dict[str, list[Any]] = {}
    for at, value in fields(record):
        if not isinstance(value, (dict, list)):
            values.setdefault(written_path(at), []).append(value)
    out: dict[str, Any] = {}
    rest: dict[str, str] = {}
    log: list[tuple[str, str, str, str]] = []
    for rule, path, column, kind in rules:
        if rule in ("alias", "rename"):
            log.append((rule, path, path, column))
            continue
        if rule == "default":
            if column == "ticker" and ticker is not None:
                out["ticker"] = ticker.strip().upper()
                log.append(("default", path, "", out["ticker"]))
            continue
        found = values.pop(path, [])
        if rule == "rest" or len(found) != 1:
            if found:
                rest[path] = ",".join(map(str, found))
            continue
        value = found[0]
        made, good = _cast(value, kind, column)
        if kind_of(value) != ("string" if kind == "string" else "number"):
            log.append(("cast" if good else "cast failed", path, str(value), str(made)))
        if good and out.get(column) is None:
            out[column] = made
        elif not good or out[column] != made:
            rest[path] = str(value)
    return out, rest, log


def one_table(raw: DataFrame, stage: str = "sentiment", known: DataFrame | None = None) -> DataFrame:
    """One row for each record in one set of columns, with ``version``, ``rest`` for fields that have none and ``changes`` for the rules that fired.

    Each record is routed by its fingerprint: the rules of a fingerprint are made once, from the registry (``known`` is one
    written before), and joined to the records. All records count, each record_id once (the greatest payload, if they differ);
    payloads that are no record give no row. A value that can't be cast leaves its column null and stays in
    ``rest``; nothing is lost. Other columns of the input are ignored.
    """
    columns = target_columns()
    keys = ["record_id", "run_id", "file_name", "filing_date"]
    rule = "array<struct<rule:string,path:string,column:string,type:string>>"
    schema = ", ".join(
        ["record_id long, run_id long, file_name string, filing_date date, version long"]
        + [f"{n} {k}" for n, k in columns]
        + ["rest map<string,string>", "changes array<struct<rule:string,path:string,old:string,new:string>>"]
    )
    names = [n for n, _ in columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for rid, run_id, name, day, version, ticker, payload, rules in f.itertuples(index=False):
                out, rest, log = follow(read_record(payload), [(r["rule"], r["path"], r["column"], r["type"]) for r in rules], ticker)
                rows.append((rid, run_id, name, day, version, *(out.get(n) for n in names), rest, log))
            made = pd.DataFrame(rows, columns=[*keys, "version", *names, "rest", "changes"])
            for n, k in columns:
                made[n] = made[n].astype({"int": "Int32", "double": "Float64", "string": object}[k])
            yield made

    rows = raw.where((F.col("stage") == stage) & F.col("record_id").isNotNull()).groupBy("record_id").agg(F.max(F.struct("payload", "run_id", "file_name", "filing_date", "loaded_at", "ticker")).alias("r"))
    shaped = written(with_shape(rows.select("record_id", "r.*")))
    store = written(registry(shaped.select("fingerprint", "shape", "loaded_at", "record_id"), known))
    made = routes(store).groupBy("fingerprint", "version").agg(F.array_sort(F.collect_list(F.struct("step", "rule", "path", "column", "type"))).alias("s"))
    made = made.select("fingerprint", "version", F.transform("s", lambda s: F.struct(s["rule"], s["path"], s["column"], s["type"])).cast(rule).alias("rules"))
    return shaped.drop("shape", "loaded_at").join(small(made, 2_000), "fingerprint").select(*keys, "version", "ticker", "payload", "rules").mapInPandas(run, schema)
