"""Deeply nested records as flat tables with parent-child links (problem 3).

Method: Merkle subtree identities. Every object and every array of a record, and every context sentence, is a node. It
is written in a canonical form (sorted keys, no white space) in which each child that is a node stands by
its hash, and hashed bottom-up: equal subtrees anywhere in the collection have one hash and are stored once. Every
occurrence is kept as a bridge row: the record, the node's place (its number in the record, parents before
children), its parent's place, its key and ordinal there, and its hash.

Tables, sections, anomalies, contexts and the record itself are entities, with a flat table each. ``owner`` is the place of
the nearest entity around a node, so a table within a table names the outer one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.records import bare, plain, read_record

ENTITIES = ("record", "table", "section", "anomaly", "context")
_TABLE_KEYS = {"index", "rows", "cols", "columns"}
_FIELDS = "array<struct<path:string,name:string,value:string>>"
_LINKS = f"record_id long, child string, item_key string, place int, parent int, owner int, key string, ordinal int, node string, body string, fields {_FIELDS}"


_canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


class Node:
    """One occurrence of a subtree; ``state`` says where in its stage's layout it stands."""

    __slots__ = ("value", "parent", "owner", "key", "ordinal", "state", "child", "item", "nodes", "hash")

    def __init__(self, value: Any, parent: int | None, owner: int | None, key: str, ordinal: int, state: Any):
        self.value, self.parent, self.owner, self.key, self.ordinal, self.state = value, parent, owner, key, ordinal, state
        self.child, self.item, self.nodes, self.hash = "", "", {}, ""


class Layout:
    """What the nodes of one record are, by stage. Tables and sentences are numbered in order of appearance."""

    def __init__(self, stage: str):
        self.stage, self.tables, self.sentences = stage, 0, 0

    def name(self, n: Node) -> None:
        """Sets ``child`` and ``item`` of a node."""
        v, state = n.value, n.state
        n.child = "record" if state == "root" else "object" if isinstance(v, dict) else "array"
        if state == "summary" and isinstance(v, dict) and any(plain(k) in _TABLE_KEYS for k in v):
            n.child, n.item = "table", str(self.tables)
            self.tables += 1
        elif state == "section" and isinstance(v, dict) and any(plain(k) == "label" and x is not None for k, x in v.items()):
            n.child, n.item = "section", f"item_{bare(n.key)}"
        elif isinstance(state, tuple) and state[0] == "anomaly":
            n.child, n.item, self.sentences = "anomaly", str(state[1]), 0
        elif isinstance(state, tuple) and state[0] == "context" and isinstance(v, str):
            n.child, n.item = "context", f"{state[1]}/{self.sentences}"
            self.sentences += 1

    def below(self, n: Node) -> Iterator[Any]:
        """The state of each child, in order."""
        v, state = n.value, n.state
        keys = list(v) if isinstance(v, dict) else [None] * len(v)
        if state == "root":
            part = {"metadata": "tables", "sentiment": "sections", "anomalies": "anomalies"}[self.stage]
            yield from ((part if k == part and (part == "anomalies" or isinstance(v[k], dict)) else None) for k in keys)
        elif state == "tables":
            yield from ("summary" if k == "summary" else None for k in keys)
        elif state == "summary":
            yield from ("summary" for _ in keys)
        elif state == "sections":
            yield from ("section" for _ in keys)
        elif state == "anomalies":
            a = 0
            for x in v.values() if isinstance(v, dict) else v:
                yield ("anomaly", a) if x is not None else None
                a += x is not None
        elif isinstance(state, tuple):
            kind, a = state
            inside = kind == "context"
            text = next((k for k in keys if plain(k) == "text"), None) if inside and isinstance(v, dict) else None
            for k in keys:
                if text is not None:
                    yield state if k == text else None
                else:
                    yield ("context", a) if inside or (k is not None and plain(k) in ("context", "contexts")) else ("within", a)
        else:
            yield from (None for _ in keys)


def nodes_of(stage: str, record: dict[str, Any]) -> list[Node]:
    """The nodes of a record, parents before children and in order of appearance, each with its hash."""
    layout, found = Layout(stage), []
    stack = [Node(record, None, None, "", 0, "root")]
    while stack:
        n = stack.pop()
        layout.name(n)
        place = len(found)
        found.append(n)
        if n.parent is not None:
            found[n.parent].nodes[n.ordinal] = place
        if isinstance(n.value, (dict, list)):
            if not (isinstance(n.state, tuple) or n.state == "anomalies") and not any(isinstance(x, (dict, list)) for x in (n.value.values() if isinstance(n.value, dict) else n.value)):
                continue  # nothing below it is a node
            owner = place if n.child in ENTITIES else n.owner
            items = n.value.items() if isinstance(n.value, dict) else ((str(i), x) for i, x in enumerate(n.value))
            made = [Node(x, place, owner, k, i, s) for i, ((k, x), s) in enumerate(zip(items, layout.below(n))) if _is_node(x, s)]
            stack += reversed(made)
    for n in reversed(found):  # children first
        n.hash = identity(body_of(n, found))
    return found


def _is_node(value: Any, state: Any) -> bool:
    kind = state[0] if isinstance(state, tuple) else None
    return isinstance(value, (dict, list)) or kind == "anomaly" or (kind == "context" and isinstance(value, str))


def body_of(n: Node, found: list[Node]) -> str:
    """The canonical form; whatever is written ``{"#": ...}`` in it is a child by its hash, for no object stands in it itself."""
    v = n.value
    if n.nodes:
        mark = lambda i, x: {"#": found[n.nodes[i]].hash} if i in n.nodes else x
        v = {k: mark(i, x) for i, (k, x) in enumerate(v.items())} if isinstance(v, dict) else [mark(i, x) for i, x in enumerate(v)]
    return _canonical(v)


def identity(body: str) -> str:
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def own_fields(found: list[Node]) -> dict[int, list[tuple[str, str, str | None]]]:
    """``(path, name, value)`` of the values of each entity that aren't in an entity within it; empty objects and arrays count as values.

    A path that keys with dots make a second time gets a number.
    """
    out: dict[int, list[tuple[str, str, str | None]]] = {}
    seen: dict[tuple[int, str], int] = {}

    def path_of(n: Node, last: list[tuple[str, bool]]) -> tuple[str, str]:
        keys = list(last)
        while n.child not in ENTITIES:
            keys.append((n.key, isinstance(found[n.parent].value, list)))
            n = found[n.parent]
        keys.reverse()
        written = "".join(f"[{k}]" if listed else f".{k}" for k, listed in keys)
        name = "".join(f"[{k}]" if listed else f".{bare(k)}" for k, listed in keys)
        return (written.removeprefix("."), name.removeprefix("."))

    def add(entity: int, n: Node, last: list[tuple[str, bool]], value: Any) -> None:
        path, name = path_of(n, last)
        again = seen[entity, path] = seen.get((entity, path), 0) + 1
        out.setdefault(entity, []).append((path if again == 1 else f"{path}#{again}", name, value if value is None or isinstance(value, str) else json.dumps(value)))

    for place, n in enumerate(found):
        mine, v = place if n.child in ENTITIES else n.owner, n.value
        out.setdefault(mine, [])
        if not isinstance(v, (dict, list)) or not v:
            add(mine, n, [], v)
            continue
        for i, (k, x) in enumerate(v.items() if isinstance(v, dict) else enumerate(v)):
            if i not in n.nodes:
                add(mine, n, [(str(k), isinstance(v, list))], x)
    return out


def flatten(record_id: int, stage: str, record: dict[str, Any], bodies: bool = True, values: bool = True) -> list[tuple]:
    """Bridge rows of one record, in the order of their places."""
    found = nodes_of(stage, record)
    own = own_fields(found) if values else {}
    return [(record_id, n.child, n.item, i, n.parent, n.owner, n.key, n.ordinal, n.hash, body_of(n, found) if bodies else None, own.get(i) if n.child in ENTITIES else None) for i, n in enumerate(found)]


def links(raw: DataFrame, bodies: bool = False, values: bool = False) -> DataFrame:
    """Bridge rows ``(record_id, child, item_key, place, parent, owner, key, ordinal, node[, body][, fields])``: every occurrence of every node.

    ``child`` is record, table, section, anomaly or context, else object or array; ``item_key`` names tables (their number),
    sections, anomalies (their number) and contexts (anomaly / number). ``place`` numbers the nodes of a record, which
    is 0 itself and has no parent; ``ordinal`` is the place among all elements of the parent, null ones too. Sections
    whose label is null are part of their record only; null elements have no row. ``bodies`` adds the canonical forms and
    ``values`` the fields of each entity. Payloads that are no record (null, cut short, not an object) give no rows,
    and neither do rows without record_id; rows of one record_id count once (the greatest payload, if they differ); an
    empty table gives an empty one; other columns are ignored.
    """
    names = [c.split()[0] for c in _LINKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for rid, stage, payload in f.itertuples(index=False):
                if (record := read_record(payload)) is not None:
                    rows += flatten(int(rid), stage, record, bodies, values)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"parent": "Int32", "owner": "Int32"})

    rows = raw.where("record_id is not null and stage in ('metadata', 'sentiment', 'anomalies')").groupBy("record_id").agg(F.max(F.struct("payload", "stage")).alias("r"))
    out = rows.select("record_id", "r.stage", "r.payload").mapInPandas(run, _LINKS)
    return out.drop(*["body"] * (not bodies), *["fields"] * (not values))


def nodes(linked: DataFrame) -> DataFrame:
    """``(node, body, occurrences)``: each distinct subtree once, out of bridge rows with bodies."""
    return linked.groupBy("node").agg(F.first("body").alias("body"), F.count("*").alias("occurrences"))


# The flat tables' columns: names of the fields (bare keys joined by dots) that one is read from, the first there is counting, and its type.
COLUMNS: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "table": {"table_index": (("index",), "int"), "rows": (("rows",), "int"), "cols": (("cols", "columns"), "int")},
    "section": {
        "label": (("label", "label.name"), "string"), "label_rank": (("label.rank",), "int"), "signal": (("signal",), "string"),
        "compound": (("scores.compound",), "double"), "positive": (("scores.positive",), "double"), "negative": (("scores.negative",), "double"), "neutral": (("scores.neutral",), "double"),
        "chunks": (("scores.numchunks", "scores.chunksanalyzed"), "int"), "word_count": (("wordcount",), "int"), "confidence": (("confidence",), "double"), "file": (("file",), "string"),
    },
    "anomaly": {"type": (("type",), "string"), "severity": (("severity",), "string"), "keyword": (("keyword",), "string"), "mentions": (("count",), "int"), "category": (("category",), "string")},
    "context": {"sentence": (("",), "string")},
    "record": {
        "ticker": (("ticker",), "string"), "overall": (("overall.compound",), "double"), "overall_signal": (("overall.signal",), "string"), "parse_time": (("parsetime",), "double"),
        "total_words": (("metadata.totalwords", "sections.metadata.totalwords"), "long"), "total_chars": (("metadata.totalchars", "sections.metadata.totalchars"), "long"),
        "total_anomalies": (("totalanomalies",), "int"), "table_count": (("tables.count",), "int"),
    },
}


def _typed(value: Column, kind: str) -> Column:
    """The value as ``kind``, null if it isn't of it; whole numbers may be written with a point."""
    if kind not in ("int", "long"):
        return value.try_cast(kind)
    number = value.try_cast("double")
    return F.coalesce(value.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))


def _picked(names: tuple[str, ...], kind: str) -> Column:
    """``STRUCT<path, value>`` of the first field of one of the names, in their order, that can be read as ``kind``."""
    typed = lambda n: F.filter("fields", lambda f: (f["name"] == n) & _typed(f["value"], kind).isNotNull())
    return F.coalesce(*[F.try_element_at(typed(n), F.lit(1)) for n in names])


def flat_table(linked: DataFrame, child: str) -> DataFrame:
    """The flat table of one kind of entity, out of bridge rows with values: keys of row and owner, its own columns, and ``rest``.

    ``rest`` maps the path as written of every field that no column was read from to its value, so nothing is lost: fields of
    other names, second spellings, and values that aren't of their column's type.
    """
    own = linked.where(F.col("child") == child)
    for c, (names, kind) in COLUMNS[child].items():
        own = own.withColumn(f"_{c}", _picked(names, kind))
    used = F.array(*[F.col(f"_{c}.path") for c in COLUMNS[child]])
    rest = F.map_from_entries(F.transform(F.filter("fields", lambda f: ~F.coalesce(F.array_contains(used, f["path"]), F.lit(False))), lambda f: F.struct(f["path"], f["value"])))
    values = [_typed(F.col(f"_{c}.value"), kind).alias(c) for c, (_, kind) in COLUMNS[child].items()]
    return own.select("record_id", "place", F.col("owner").alias("parent"), "item_key", "ordinal", "node", *values, rest.alias("rest"))
