"""Sections of a filing found by their headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import clean_section, trimmed

# Headings of the three sections, and of whatever item comes next (not at any line start but after a newline).
HEADINGS = {
    "item_1a": r"(?iU)Item\s+1A\.?\s*[\-—:]?\s*Risk\s+Factors",
    "item_7": r"(?iU)Item\s+7\.?\s*[\-—:]?\s*Management.?s\s+Discussion\s+and\s+Analysis",
    "item_8": r"(?iU)Item\s+8\.?\s*[\-—:]?\s*Financial\s+Statements",
}
NEXT = r"(?U)(?:^|\n)\s*I[Tt][Ee][Mm]\s+\d+[A-Za-z]?\."
MARK = "\x01"
#: Wider headings, for filings that write "Discussion of Results" or "Statements and Notes"; to be passed in.
WIDER_HEADINGS = {
    "item_1a": HEADINGS["item_1a"],
    "item_7": r"(?iU)Item\s+7\.?\s*[\-—:]?\s*Management(?:.?s)?\s+Discussion\s+(?:and\s+Analysis|of\s+Results)",
    "item_8": r"(?iU)Item\s+8\.?\s*[\-—:]?\s*(?:Financial\s+Statements|Statements\s+and\s+Notes)",
}
REACH, LEAST, APART, LONGEST, LOOK = 1000, 200, 1000, 50_000, 500


_AT = "array<struct<at:int,len:int>>"


def with_offsets(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``ARRAY<STRUCT<at, len>>`` of the matches, in order, as positions from 0.

    A sentinel is put before every match, so the lengths of the pieces between are the offsets. The pieces are a
    column of their own, for they are used twice.
    """
    df = df.withColumn("_pieces", F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1"), MARK))
    head = lambda p: F.length(F.regexp_extract(p, f"^({pattern})", 1))
    start = F.struct(F.length(F.element_at("_pieces", 1)).alias("pos"), F.expr(f"cast(array() as {_AT})").alias("found"))
    step = lambda a, p: F.struct((a["pos"] + F.length(p)).alias("pos"), F.concat(a["found"], F.array(F.struct(a["pos"].alias("at"), head(p).alias("len")))).alias("found"))
    found = F.aggregate(F.slice("_pieces", 2, F.greatest(F.size("_pieces"), F.lit(1))), start, step, lambda a: a["found"])
    return df.withColumn(name, F.when(F.size("_pieces") > 1, found).otherwise(F.expr(f"cast(array() as {_AT})"))).drop("_pieces")


def with_bounds(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name STRUCT<a, b>``, the place of a section; null if there is none.

    It starts at the first heading that is followed by text within 1,000 characters (an entry in a table of contents
    isn't), or at the only heading there is; it ends before the next item's heading at least 1,000 characters on that
    is followed by text, else 50,000 characters on or with the filing.
    """
    t = F.col(text)
    df = with_offsets(df, text, pattern, "_found")
    real = F.filter("_found", lambda m: F.length(trimmed(F.substring(t, m["at"] + m["len"] + 1, REACH - m["len"]))) > LEAST)
    start = F.coalesce(F.try_element_at(real, F.lit(1))["at"], F.when(F.size("_found") == 1, F.try_element_at("_found", F.lit(1))["at"]))
    df = df.withColumn("_a", start).withColumn("_rest", F.substring(t, F.col("_a") + APART + 1, F.length(t)))
    df = with_offsets(df, "_rest", NEXT, "_ends")
    ends = F.filter("_ends", lambda m: F.length(trimmed(F.substring(F.col("_rest"), m["at"] + 1, F.lit(LOOK)))) > LEAST)
    end = F.coalesce(F.col("_a") + APART + F.try_element_at(ends, F.lit(1))["at"], F.least(F.length(t), F.col("_a") + LONGEST))
    return df.withColumn(name, F.when(F.col("_a").isNotNull(), F.struct(F.col("_a").alias("a"), end.alias("b")))).drop("_found", "_rest", "_ends", "_a")


def extract(df: DataFrame, keys: list[str], text: str, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """``(keys, section, a, b, section_text)`` of every section found that isn't empty once cleaned.

    Null texts have none; each input row is handled on its own. The places are worked out in columns, each step once;
    the rows come out of a generator, through which no filter is pushed that would work them out again.
    """
    df = df.select(*keys, F.replace(F.col(text), F.lit(MARK), F.lit(" ")).alias("_t"))
    for s, p in headings.items():
        df = with_bounds(df, "_t", p, f"_{s}")
    parts = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"_{s}").alias("x")) for s in headings])
    rows = df.select(*keys, "_t", F.explode_outer(parts).alias("p")).where("p.x is not null")
    cut = rows.select(*keys, "p.section", "p.x.a", "p.x.b", F.explode_outer(F.array(clean_section(F.substring("_t", F.col("p.x.a") + 1, F.col("p.x.b") - F.col("p.x.a"))))).alias("section_text"))
    return cut.where("section_text <> ''")
