"""Corpus encoding with a public byte-level BPE vocabulary (problem 6).

Method: prefix-sharing trie traversal. The distinct pre-tokens of a batch are sorted, which is the
depth-first order of their trie; walking that order keeps one state per depth, the last token of the
encoding of the prefix, so a shared prefix is encoded once for all words below it. A token ``t`` ends
the encoding of a prefix exactly if the prefix without ``t`` ends in a token that stays apart from
``t`` when the two are merged on their own, so one state per depth is enough to read off a whole word.

No shuffle: every task keeps a bounded memory of words already encoded. The vocabulary file is read
once per worker process.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pre-token pattern published with the vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker remembers before it starts afresh; a bound on memory only.
REMEMBERED_WORDS = 400_000


class TrieEncoder:
    """Encodes words with a rank file (``base64 rank`` a line); merge order is rank order."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.longest = max(map(len, self.ranks))
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PRE_TOKEN).findall

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: merges the lowest-ranked neighbours until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens, put side by side, are their own encoding."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > 2 * REMEMBERED_WORDS:
                self._apart.clear()
            known = self._apart[left, right] = self.merge(left + right) == [left, right]
        return known

    def _encode_sorted(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted words; the state at depth d is the last token of the encoding of the first d bytes."""
        ranks, longest, apart = self.ranks, self.longest, self.apart
        last: list[bytes] = [b""]
        before = b""
        for word in words:
            n, shared, most = len(word), 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    if token in ranks and (start == 0 or apart(last[start], token)):
                        last.append(token)
                        break
            before = word
            ids, end = [], n
            while end:
                token = last[end]
                ids.append(ranks[token])
                end -= len(token)
            ids.reverse()
            yield tuple(ids)

    def learn(self, words: set[str]) -> None:
        fresh = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        for (_, word), ids in zip(fresh, self._encode_sorted([b for b, _ in fresh])):
            self._words[word] = ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts; null and empty texts have no ids."""
        split, known = self._split, self._words
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        words = [split(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(words)).difference(known)
        if fresh:
            self.learn(fresh)
        ids = list(map(known.__getitem__, chain.from_iterable(words)))
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        return np.concatenate([[0], total[ends]]).astype(np.int32), flat


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, batch: int = 512) -> DataFrame:
    """``(key, ids ARRAY<INT>)``: the token ids of every row's text, without special tokens.

    Texts are taken as they are: neither trimmed nor normalised, and a string that looks like a special
    token is plain text. An empty and a null text give an empty list; a null key stays null; every input
    row gives one output row, repeated rows too; an empty table gives an empty one; other columns of the
    input are ignored, so their names can't clash.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                offsets, flat = use.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "ids"])

    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("k", key)


def decode(ids: list[int], path: str = DEFAULT_VOCABULARY) -> str:
    """The text of a list of ids; inverse of the encoding for well-formed texts."""
    back = _by_id(path)
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _by_id(path: str) -> dict[int, bytes]:
    return {v: k for k, v in encoder(path).ranks.items()}
