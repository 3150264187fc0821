"""Sets of words and the texts that hold most of them as substrings.

Each text is looked through once for all words of all sets, instead of once for each pair of a set and a text. A word has no
white space, so it is in a text only if it is in one of the text's own words; what a text's word holds is kept for the next text.
Texts that hold the same words are as good for every set: of those, only the ``k`` smallest keys count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa

#: Different words of texts that are remembered; kinds of texts, and words in them, that are met with the sets at once.
SEEN, KINDS, HELD = 500_000, 4_096, 400_000


def finder(vocabulary: Iterable[str]) -> Callable[[str], frozenset[str]]:
    """The words of the vocabulary that a text holds as substrings."""
    heads: dict[int, dict[str, list[str]]] = {}
    for w in set(vocabulary):
        g = min(3, len(w))
        heads.setdefault(g, {}).setdefault(w[:g], []).append(w)
    seen: set[str] = set()
    holding: dict[str, list[str]] = {}

    def look(t: str) -> None:
        for g, words in heads.items():
            for head in words.keys() & {t[i : i + g] for i in range(len(t) - g + 1)}:
                for w in words[head]:
                    if w in t:
                        holding.setdefault(t, []).append(w)
        seen.add(t)

    def found(text: str) -> frozenset[str]:
        own = set(text.split())
        if len(seen) > SEEN:
            seen.clear()
            holding.clear()
        for t in own - seen:
            look(t)
        return frozenset(w for t in own & holding.keys() for w in holding[t])

    return found


def _ordered(key) -> tuple:
    return (key is not None, key)


class Best:
    """The ``k`` best keys of each set: by the number of its words, then by key, null first, as Spark orders."""

    def __init__(self, sets: list[tuple[int, list[str]]], k: int):
        self.sets, self.k = sets, k
        self.kinds: dict[frozenset[str], list] = {}
        self.held = 0
        self.best: dict[int, list[tuple[int, tuple]]] = {}

    def add(self, key, words: frozenset[str]) -> None:
        if not words:
            return
        keys = self.kinds.get(words)
        if keys is None:
            self.kinds[words] = [key]
            self.held += len(words)
            if len(self.kinds) >= KINDS or self.held >= HELD:
                self.meet()
            return
        keys.append(key)
        if len(keys) >= 8 * self.k:
            self.kinds[words] = nsmallest(self.k, keys, key=_ordered)

    def meet(self) -> None:
        """Meets the kinds of texts so far with all sets; sets of which the same words are there at all are counted once."""
        rows = sorted(((_ordered(key), words) for words, keys in self.kinds.items() for key in nsmallest(self.k, keys, key=_ordered)), key=lambda r: r[0])
        self.kinds, self.held = {}, 0
        places: dict[str, list[int]] = {}
        for i, (_, words) in enumerate(rows):
            for w in words:
                places.setdefault(w, []).append(i)
        at = {w: np.array(p) for w, p in places.items()}
        alike: dict[frozenset[str], list[int]] = {}
        for n, words in self.sets:
            if there := at.keys() & words:
                alike.setdefault(frozenset(there), []).append(n)
        for words, numbers in alike.items():
            hits = np.bincount(np.concatenate([at[w] for w in words]))
            some = np.flatnonzero(hits)
            # more hits first, then the earlier row: one number, so that the best are cut out without a sort of all
            order = (len(words) - hits[some]) * len(rows) + some
            if len(order) > self.k:
                order = np.partition(order, self.k - 1)[: self.k]
            new = [(-int(hits[i]), rows[i][0]) for i in (int(o) % len(rows) for o in np.sort(order))]
            for n in numbers:
                old = self.best.get(n)
                self.best[n] = new if old is None else sorted(old + new)[: self.k]

    def rows(self) -> Iterator[tuple[int, object, int]]:
        if self.kinds:
            self.meet()
        return ((n, key[1], -hits) for n, best in self.best.items() for hits, key in best)


def best_texts(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, list[str]]], k: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """``(set, key, hits)`` out of batches of ``(key, text)``: of each set, the ``k`` best of this task's texts that hold any of its words."""
    found, best, kind = finder(w for _, words in sets for w in words), Best(sets, k), None
    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            best.add(key, found(text))
    out = list(best.rows()) if kind is not None else []
    for i in range(0, len(out), rows):
        n, keys, hits = zip(*out[i : i + rows], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(keys, kind), pa.array(hits, pa.int32())], ["_set", "_key", "_hits"])
