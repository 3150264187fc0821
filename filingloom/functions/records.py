"""Records stored as JSON text: reading them and walking their fields. Nothing here recurses, so no depth is too deep."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

BOM = chr(0xFEFF)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*"|[^\s\[\]{},:"]+))')


def _read_deep(text: str) -> Any:
    """``json.loads`` with a stack of its own, for values nested deeper than the parser of the library goes."""
    top: list[Any] = []
    stack: list[Any] = [top]
    keys: list[str] = []
    # what may come next: a value, a value or the end of the array, a key, a key or the end, a colon, a comma or the end
    state, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no token at {at}")
        at = m.end()
        mark, scalar = m.groups()
        box = stack[-1]
        if state == "colon" and mark == ":":
            state = "value"
        elif state == "next" and mark == "," and len(stack) > 1:
            state = "key" if isinstance(box, dict) else "value"
        elif mark in ("]", "}") and len(stack) > 1 and isinstance(box, dict) == (mark == "}") and state in ("next", "value or end", "key or end"):
            stack.pop()
            if isinstance(stack[-1], dict):
                keys.pop()
            state = "next"
        elif state in ("key", "key or end") and scalar is not None and scalar[0] == '"':
            keys.append(json.loads(scalar))
            state = "colon"
        elif state in ("value", "value or end") and (scalar is not None or mark in ("[", "{")):
            value = json.loads(scalar) if scalar is not None else [] if mark == "[" else {}
            if isinstance(box, dict):
                box[keys[-1]] = value
            else:
                box.append(value)
            if scalar is None:
                stack.append(value)
                state = "value or end" if mark == "[" else "key or end"
            else:
                if isinstance(box, dict):
                    keys.pop()
                state = "next"
        else:
            raise ValueError(f"unexpected token at {at}")
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("incomplete")
    return top[0]


def read_json(text: str) -> Any:
    """The value of a complete JSON text of any depth; ValueError otherwise."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def read_record(payload: str | None) -> dict[str, Any] | None:
    """The record of a payload: without a leading byte order mark, and taken out of a JSON string that holds it.

    Null, incomplete JSON, and JSON that isn't an object are no record. Of a key written twice in one object the last counts.
    """
    for _ in range(2):
        if payload is None:
            return None
        try:
            value = read_json(payload.removeprefix(BOM))
        except ValueError:
            return None
        if isinstance(value, dict):
            return value
        if not isinstance(value, str):
            return None
        payload = value
    return None


@lru_cache(maxsize=100_000)
def plain(key: str) -> str:
    """A key's letters and digits, in lower case."""
    return "".join(c for c in key.lower() if c.isalnum())


@lru_cache(maxsize=100_000)
def bare(key: str) -> str:
    """A key's name: ``plain`` with a leading ``item`` dropped."""
    return plain(key).removeprefix("item")


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "string" if isinstance(value, str) else "number"


def fields(value: Any) -> Iterator[tuple[tuple[str, ...], Any]]:
    """Every object, array and value below the root that isn't null, with the keys of its path, in order of appearance.

    The elements of an array are the one field ``[]`` below it. Paths are written out, so what this yields grows with the
    square of the depth.
    """
    stack: list[Iterator[tuple[tuple[str, ...], Any]]] = [_below((), value)]
    while stack:
        for at, v in stack[-1]:
            if v is not None:
                yield at, v
                if isinstance(v, (dict, list)):
                    stack.append(_below(at, v))
                    break
        else:
            stack.pop()


def _below(path: tuple[str, ...], value: Any) -> Iterator[tuple[tuple[str, ...], Any]]:
    if isinstance(value, dict):
        return ((path + (k,), v) for k, v in value.items())
    return ((path + ("[]",), v) for v in value) if isinstance(value, list) else iter(())


def written_path(at: tuple[str, ...]) -> str:
    return ".".join(at).replace(".[]", "[]")


def shape(record: dict[str, Any]) -> list[tuple[str, str, str, str]]:
    """``(path, name, own key, type)`` of a record's fields in order of appearance, each path once.

    ``name`` is the path made of bare keys; fields of two records correspond if it is equal. Of elements with
    several types the first counts.
    """
    seen: dict[tuple[str, ...], str] = {}
    for at, v in fields(record):
        seen.setdefault(at, kind_of(v))
    return [(written_path(at), "\x1f".join("[]" if k == "[]" else bare(k) for k in at), at[-1], kind) for at, kind in seen.items()]
