"""Text read in the wrong character encoding (problem 8).

Method: expectation-maximization with latent encoding chains. Each record has one latent chain, ``none`` or a
pair of encodings (written in, read in) by which some or all of its words went, once or several times. A chain
explains a word if undoing it gives a likelier one under a character model of the corpus; a record's evidence for a
chain is the sum over its words, each of which may have escaped. Chains have a prior in each group (source) of
records: the E-step gives every record its posterior, the M-step pools the posteriors into the priors, so that
weak evidence counts where a source is known to garble that way. A record is affected if the posterior of
``none`` is below one half, or if it holds the replacement character that stands for a lost one.

Two passes read the texts: one counts the pairs of neighbouring characters of words that aren't plain ASCII (a
table bounded by the alphabets, rarer characters being counted by block), one scores. EM runs on the few
records that have any evidence at all. Nothing is sampled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.sources.tables import small, written

LOST = chr(0xFFFD)
_TOKENS = re.compile(r"[^ \t\n\r\f\v]+").findall
# a character that is neither plain ASCII nor a space or mark without width
_MARKED = re.compile(f"[^\\x00-\\x7f\\s{''.join(map(chr, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]))}]").search
_NUMBER = re.compile(r"[0-9][0-9.,]*")
#: Words a worker remembers; a bound on memory only.
REMEMBERED = 300_000
#: Share of a garbled record's words that went through the chain, at the least.
SHARE = 0.5
PRIOR = 1e-3
#: Pairs of characters that the driver and the workers can hold; all are kept, and a collection of more is refused.
MOST_PAIRS = 1_000_000
#: Groups up to which priors are sent to the tasks, and rounds after which EM that doesn't settle is an error.
MOST_SENT, MOST_ROUNDS = 10_000, 200

# Encodings in which UTF-8 has been read, and (read in, written in) pairs of older encodings.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2")
LEGACY = (
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"),
    ("cp1252", "cp932"), ("cp437", "cp932"), ("mac_roman", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "gbk"),
)


@lru_cache(maxsize=64)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; bytes without a character, and the C1 controls of cp1252, stand for themselves."""
    table = {chr(b): b for b in range(128, 256)} if encoding == "cp1252" else {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return table


def _utf8_undo(encoding: str) -> Callable[[str], str | None]:
    """Undoes UTF-8 read as ``encoding``, again and again; None if nothing in the word looks so."""
    table = _bytes_of(encoding)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = chars(0x80, 0xBF)
    pattern = re.compile(f"{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}}")
    # closing quotes whose last byte cp1252 doesn't have, and a grave a whose second half was taken for a space
    bare = re.compile("(?<![A-Z\xc0-\xde])\xc3$")
    cut = re.compile(f"{chars(0xE2, 0xE2)}{chars(0x80, 0x80)}(?!{tail})[?{LOST}]?")

    def decode(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def undo(word: str) -> str | None:
        out = word
        while True:  # every turn that changes the word makes it shorter, or mends its last letter
            new = pattern.sub(decode, out)
            if encoding == "cp1252":
                new = bare.sub("\xe0", cut.sub(chr(0x201D), new))
            if new == out:
                return out if out != word else None
            out = new

    return undo


def _gbk_undo(word: str) -> str | None:
    """Undoes UTF-8 read as gbk; a character that was cut off at the end of a run is lost."""

    def decode(m: re.Match) -> str:
        try:
            raw = m.group().rstrip(LOST).encode("gbk")
        except UnicodeEncodeError:
            return m.group()
        out = raw.decode("utf-8", "ignore")
        return out if len(out.encode("utf-8")) >= len(raw) - 2 and (out or m.group().endswith(LOST)) else m.group()

    out = _HAN_RUN.sub(decode, word)
    return out if out != word else None


_HAN_RUN = re.compile(f"[{chr(0x2E80)}-{chr(0x9FFF)}][{chr(0x2E80)}-{chr(0x9FFF)}{chr(0x20AC)}{LOST}]*")


def _legacy_undo(read: str, wrote: str) -> Callable[[str], str | None]:
    table = _bytes_of(read)

    def undo(word: str) -> str | None:
        raw = bytearray()
        for c in word:
            b = ord(c) if c < "\x80" else table.get(c, -1)
            if b < 0:
                return None
            raw.append(b)
        try:
            out = raw.decode(wrote)
        except UnicodeDecodeError:
            return None
        return out if out != word and not any("\x80" <= c < "\xa0" for c in out) else None

    return undo


@lru_cache(maxsize=1)
def chains() -> tuple[tuple[str, Callable[[str], str | None]], ...]:
    found = [(f"utf-8 as {e}", _utf8_undo(e)) for e in UTF8_READ_AS] + [("utf-8 as gbk", _gbk_undo)]
    return tuple(found + [(f"{w} as {r}", _legacy_undo(r, w)) for r, w in LEGACY])


def _kind(c: str) -> str:
    """The character as the model counts it: itself in the alphabets and punctuation of the texts, else its block."""
    o = ord(c)
    return c if o < 0x530 or 0x2000 <= o < 0x2300 or 0x2500 <= o < 0x2600 or 0x3000 <= o < 0x3100 else chr(0xE000 + (o >> 8) % 0x1000)


def _plain(word: str) -> str:
    """The word as it is modelled: numbers are alike, and marks around a word don't count."""
    return "".join(map(_kind, _NUMBER.sub("0", word)))


class CharacterModel:
    """Log-probability of a word by pairs of neighbouring characters, smoothed by single ones."""

    def __init__(self, pairs: dict[str, int]):
        self.pairs = pairs
        self.first: Counter = Counter()
        self.single: Counter = Counter()
        for p, n in pairs.items():
            self.first[p[0]] += n
            self.single[p[1]] += n
        self.total = sum(self.single.values()) or 1
        self.size = len(self.single) + 1
        self._seen: dict[str, float] = {}

    def pair(self, p: str) -> float:
        known = self._seen.get(p)
        if known is None:
            single = (self.single.get(p[1], 0) + 0.05) / (self.total + 0.05 * self.size + 3000)
            known = self._seen[p] = math.log((self.pairs.get(p, 0) + 3 * single) / (self.first.get(p[0], 0) + 3))
        return known

    def score(self, word: str) -> float:
        w = f"\x02{_plain(word)}\x03"
        return sum(self.pair(w[i : i + 2]) for i in range(len(w) - 1))


def _utf8_like(word: str) -> bool:
    """Whether some reading of UTF-8 explains the word by characters of the alphabets that are modelled one by one, or by Han."""
    for _, undo in chains()[: len(UTF8_READ_AS) + 1]:
        was = undo(word)
        if was is not None and all(c in word or _kind(c) == c or "\u3400" <= c <= "\u9fff" for c in was):
            return True
    return False


# a bar after a plain character, or at the start, sets columns apart; one after another character may be the half of a garbled one
_BAR = re.compile(r"(?<![^\x00-\x7f])\|")


def _parts(token: str) -> list[str]:
    """The columns of a token that are set apart by bars; joined by bars they are the token again."""
    return _BAR.split(token)


def _foreign(text: str) -> list[str]:
    """The words of a text that aren't plain ASCII; columns set apart by bars are words of their own."""
    if text.isascii():
        return []
    return [w for t in _TOKENS(text) if not t.isascii() for w in _parts(t) if _MARKED(w)]


def count_pairs(texts: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters over the words that no reading of UTF-8 can explain; a ValueError beyond ``MOST_PAIRS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(_foreign(t))
            if len(words) > REMEMBERED:
                _add(words, pairs)
        _add(words, pairs)
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["p", "n"])

    found = texts.select("t").mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    rows = found.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"over {MOST_PAIRS} distinct pairs of characters: the character model would not be whole")
    return {r.p: r.n for r in sorted(rows, key=lambda r: (-r.n, r.p))}


def _add(words: Counter, pairs: Counter) -> None:
    for w, n in words.items():
        if LOST not in w and not _utf8_like(w):
            w = f"\x02{_plain(w)}\x03"
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] += n
    words.clear()


class Scorer:
    """Evidence of words for chains."""

    def __init__(self, pairs: dict[str, int]):
        self.model = CharacterModel(pairs)
        self.known: dict[str, tuple[tuple[int, float, str], ...]] = {}

    def word(self, word: str) -> tuple[tuple[int, float, str], ...]:
        """``(chain, log-likelihood ratio, word before it was garbled)`` of the chains that the word speaks for."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            own = self.model.score(word)
            out = []
            for c, (_, undo) in enumerate(chains()):
                was = undo(word)
                if was is not None and (gain := self.model.score(was) - own) > 0:
                    out.append((c, gain, was))
            found = self.known[word] = tuple(out)
        return found

    def record(self, text: str) -> dict[int, tuple[float, int]]:
        """Evidence of a record and number of words that speak for it, by chain."""
        out: dict[int, tuple[float, int]] = {}
        for w, n in Counter(_foreign(text)).items():
            for c, gain, _ in self.word(w):
                # a word may have escaped: log((1 - share) + share * ratio); repeated words are one observation and a bit
                e = gain + math.log(SHARE) if gain > 30 else math.log1p(SHARE * math.expm1(gain))
                a, k = out.get(c, (0.0, 0))
                out[c] = (a + e * (1 + 0.1 * min(n - 1, 5)), k + n)
        return out

    def repair(self, text: str, chain: int) -> str:
        def whole(m: re.Match) -> str:
            t = m.group()
            if t.isascii():
                return t
            return "|".join(next((was for c, _, was in self.word(w) if c == chain), w) if _MARKED(w) else w for w in _parts(t))

        return re.sub(r"[^ \t\n\r\f\v]+", whole, text)


def _records(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    return df.select(df[key].cast("long").alias("k"), F.coalesce(df[group].cast("string"), F.lit("")).alias("g"), df[text].alias("t")).where("k is not null and t is not null")


def garbled(df: DataFrame, key: str, text: str, group: str, tolerance: float = 1e-3) -> tuple[DataFrame, Scorer]:
    """``(k, chain, posterior, lost)`` of every affected record, and the scorer that repairs.

    EM goes on until no prior of any group moves by more than ``tolerance``.

    ``chain`` is the likeliest chain's number (-1 if only lost characters tell), ``posterior`` the probability that
    the record is affected at all. Null, empty and plain ASCII texts and null keys are never affected; records
    with a null group form a group; rows of one key count once, the likelier one first; an empty table gives an
    empty one; other columns are ignored.
    """
    rows = _records(df, key, text, group)
    foreign = rows.where(F.length("t") != F.octet_length("t"))
    scorer = Scorer(count_pairs(foreign))
    model = rows.sparkSession.sparkContext.broadcast(scorer.model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model.value)
        for b in batches:
            out = []
            for k, g, t in zip(*(c.to_pylist() for c in b.columns)):
                lost = LOST in t
                found = own.record(t)
                if lost or found:
                    out.append((k, g, lost, [{"c": c, "e": e} for c, (e, _) in found.items()]))
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "g", "lost", "e"), o)) for o in out], schema=_SCHEMA)

    evidence = written(foreign.mapInArrow(run, "k long, g string, lost boolean, e array<struct<c:int,e:double>>"))
    totals = written(rows.groupBy("g").agg(F.count("*").alias("total")))
    names = len(chains())
    # one row of a few hundred bytes a group: sent to the tasks while there are few groups, joined by a shuffle else
    sent = F.broadcast if totals.count() <= MOST_SENT else lambda d: d
    prior = totals.select("g", "total", F.array_repeat(F.lit(PRIOR), names).alias("p"))
    for _ in range(MOST_ROUNDS):
        mass = _posterior(evidence, sent(prior)).select("g", F.explode("w").alias("w")).groupBy("g", "w.c").agg(F.sum("w.p").alias("m"))
        mass = mass.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("m"))
        # one pseudo-record a chain, spread by the first prior, keeps every chain possible
        share = F.transform(F.sequence(F.lit(0), F.lit(names - 1)), lambda c: (F.coalesce(F.try_element_at("m", c), F.lit(0.0)) + 50 * PRIOR) / (F.col("total") + 50))
        moved = F.array_max(F.zip_with("p", "now", lambda a, b: F.abs(a - b)))
        prior = written(prior.join(sent(mass), "g", "left").withColumn("now", share).select("g", "total", F.col("now").alias("p"), moved.alias("moved")))
        if (prior.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"priors still move by more than {tolerance} after {MOST_ROUNDS} rounds")
    post = _posterior(evidence, sent(prior))
    best = F.array_max(F.transform("w", lambda w: F.struct(w["p"].alias("p"), (-w["c"]).alias("c"))))
    chosen = post.select("k", "lost", F.when((F.size("w") > 0) & (F.col("none") < 0.5), -best["c"]).otherwise(-1).alias("chain"), F.when(F.col("lost"), 1.0).otherwise(1 - F.col("none")).alias("posterior"))
    chosen = chosen.where("posterior > 0.5")
    top = F.max_by(F.struct("chain", "posterior", "lost"), F.struct("posterior", "chain"))
    return chosen.groupBy("k").agg(top.alias("r")).select("k", "r.*"), scorer


_SCHEMA = pa.schema([("k", pa.int64()), ("g", pa.string()), ("lost", pa.bool_()), ("e", pa.list_(pa.struct([("c", pa.int32()), ("e", pa.float64())])))])


def _posterior(evidence: DataFrame, prior: DataFrame) -> DataFrame:
    """E-step: ``none`` and the chains' posteriors ``w`` of every record with evidence."""
    x = evidence.join(prior, "g")
    # relative to the greatest evidence, so that nothing overflows
    x = x.withColumn("top", F.greatest(F.coalesce(F.array_max(F.transform("e", lambda e: e["e"])), F.lit(0.0)), F.lit(0.0)))
    odds = F.transform("e", lambda e: F.struct(e["c"].alias("c"), (F.try_element_at("p", e["c"] + 1) * F.exp(e["e"] - F.col("top"))).alias("o")))
    x = x.withColumn("o", odds).withColumn("z", F.exp(-F.col("top")) + F.aggregate("o", F.lit(0.0), lambda a, o: a + o["o"]))
    return x.select("k", "g", "lost", (F.exp(-F.col("top")) / F.col("z")).alias("none"), F.transform("o", lambda o: F.struct(o["c"].alias("c"), (o["o"] / F.col("z")).alias("p"))).alias("w"))


def repaired(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """``(key, chain, posterior, complete, repaired)``: every affected record with its text as it was written.

    ``complete`` is false where characters were lost, or where nothing could be undone; the text is then repaired as
    far as possible. Cases as in :func:`garbled`; of rows with one key and different texts each is repaired.
    """
    found, scorer = garbled(df, key, text, group)
    found = written(found)
    model = df.sparkSession.sparkContext.broadcast(scorer.model.pairs)
    names = [n for n, _ in chains()]
    joined = _records(df, key, text, group).join(small(found), "k").select("k", "chain", "posterior", "t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scorer(model.value)
        for f in frames:
            texts = [own.repair(t, c) if c >= 0 else t for t, c in zip(f["t"], f["chain"])]
            whole = [LOST not in r and r != t for t, r in zip(f["t"], texts)]
            yield pd.DataFrame({"k": f["k"], "chain": [names[c] if c >= 0 else None for c in f["chain"]], "posterior": f["posterior"], "complete": whole, "repaired": texts})

    return joined.mapInPandas(run, "k long, chain string, posterior double, complete boolean, repaired string").withColumnRenamed("k", key)
