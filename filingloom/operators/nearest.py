"""The vectors most like those of a block of queries.

A block and a batch of vectors are met at once, one dimension after another: the products of a pair are added up in the order of its
elements, as an aggregate over them does, so that similarities are the same to the last bit. Only what may still be among the
``k`` best of a query leaves a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are worked out at once; vectors of a batch in them at least.
PAIRS, LEAST = 1 << 17, 64


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length above 0, the places of the vectors without a null, and the vectors: a row for each dimension."""
    places, held = np.flatnonzero(np.asarray(vectors.is_valid())), vectors.drop_null()
    lengths, flat = np.asarray(held.value_lengths()), held.flatten()
    ends = np.cumsum(lengths)
    whole = np.ones(len(lengths), bool)
    whole[np.searchsorted(ends, np.flatnonzero(np.asarray(flat.is_null())), side="right")] = False
    values, found = flat.to_numpy(zero_copy_only=False), {}
    for n in set(lengths[whole & (lengths > 0)].tolist()):
        rows = np.flatnonzero(whole & (lengths == n))
        found[n] = places[rows], np.ascontiguousarray(values[(ends[rows] - n)[:, None] + np.arange(n)].T)
    return found


def _norms(v: np.ndarray) -> np.ndarray:
    total = np.zeros(v.shape[1])
    for x in v:
        total += x * x
    return np.maximum(np.sqrt(total), 1e-10)


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    total, product = np.zeros((q.shape[1], x.shape[1])), np.empty((q.shape[1], x.shape[1]))
    for a, b in zip(q, x, strict=True):
        total += np.multiply(a[:, None], b[None, :], out=product)
    return total


def best_vectors(batches: Iterator[pa.RecordBatch], q_keys: pa.Array, q_vectors: pa.ListArray, k: int) -> Iterator[pa.RecordBatch]:
    """``(q_key, key, similarity)`` out of batches of ``(key, vector)``: what may be among the ``k`` best of a query by similarity, then key.

    At least those are there, so a rank limit over all batches gives the best. Keys aren't null; a query doesn't meet its own key. A
    similarity is above 0, and one that is no number is above all others, as Spark orders.
    """
    names = pc.unique(q_keys)
    q_codes = np.asarray(pc.index_in(q_keys, names))
    queries = {n: (rows, v, _norms(v)) for n, (rows, v) in _by_length(q_vectors).items()}
    least = np.zeros(len(q_keys))  # of each query, what its k-th best so far has
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))  # of equal ones the smaller key comes first
        keys = batch.column(0)
        codes = np.asarray(pc.fill_null(pc.index_in(keys, names), -1))
        parts = []
        with np.errstate(all="ignore"):
            for n, (places, x) in _by_length(batch.column(1)).items():
                if n not in queries:
                    continue
                rows, q, q_norms = queries[n]
                norms, step = _norms(x), max(LEAST, PAIRS // len(rows))
                for at in range(0, len(places), step):
                    here = slice(at, at + step)
                    share = _dots(q, x[:, here]) / (q_norms[:, None] * norms[None, here])
                    own = codes[places[here]]
                    for i in np.flatnonzero(own >= 0):
                        share[q_codes[rows] == own[i], i] = 0
                    if share.shape[1] >= k:
                        least[rows] = np.fmax(least[rows], np.partition(share, -k, axis=1)[:, -k])
                    a, b = np.nonzero(~(share <= 0) & ~(share < least[rows, None]))
                    parts.append((rows[a], places[at + b], share[a, b]))
        if not parts:
            continue
        q, x, share = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((x, -share, ~np.isnan(share), q))
        q, x, share = q[order], x[order], share[order]
        first = np.searchsorted(q, q)  # where the rows of this query begin
        kept = np.arange(len(q)) - first < k
        q, x, share = q[kept], x[kept], share[kept]
        yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(q)), keys.take(pa.array(x)), pa.array(share)], ["q_key", "_key", "similarity"])
