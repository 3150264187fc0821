"""Text expressions. All stay inside Spark's own functions; null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the scripts that wrote the tables count it, and the line breaks.
_WIDE = "".join(map(chr, [0x1680, 0x2000])) + "-" + "".join(map(chr, [0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACES = rf"\t-\r\x1c- \x85\xa0{_WIDE}"
_WIDE_SPACES = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = f"[{_SPACES}]"
BREAK = rf"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85{chr(0x2028)}{chr(0x2029)}]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}++$", "")


def words(c: Column) -> Column:
    """Runs of characters that aren't white space, in order."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    # wide spaces as plain ones, then one letter for each word: classes of plain characters are matched fastest
    plain = F.translate(c, _WIDE_SPACES, " " * len(_WIDE_SPACES))
    letters = F.regexp_replace(plain, r"[\t-\r\x1c- ]*+[^\t-\r\x1c- ]++[\t-\r\x1c- ]*+", "x")
    return F.when(plain.rlike(r"[^\t-\r\x1c- ]"), F.length(letters)).otherwise(0)


def line_count(c: Column) -> Column:
    """Lines of the text without white space at its ends; 0 for an empty one."""
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(BREAK)) + 1).cast("int")


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Parts between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, separator), trimmed), lambda x: x != "")


def term_count(c: Column, term: str, lowered: bool = False) -> Column:
    """Occurrences of a term that don't overlap; as a substring, whatever the case. ``lowered``: the text is in lower case."""
    low = c if lowered else F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("int")


def clean_section(c: Column) -> Column:
    """A section without long gaps, page footers and the rules of tables, in this order."""
    # The three patterns.
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"\n[A-Za-z\s]+\|\s*\d{4}\s*Form\s*10-K\s*\|\s*\d+\n", "\n")
    return trimmed(F.regexp_replace(c, r"\|[\s\-|]+\|", ""))


def context_sentences(c: Column, terms: list[str], chars: int = 400, most: int = 3) -> Column:
    """The first ``most`` different sentences that hold any of the terms, cut to ``chars`` characters."""
    sentences = F.split(c, r"(?<=[.!?])\s+")
    hit = F.filter(sentences, lambda s: F.greatest(*[F.contains(F.lower(s), F.lit(t.lower())) for t in terms], F.lit(False)))
    return F.slice(F.array_distinct(F.transform(hit, lambda s: F.substring(trimmed(s), 1, chars))), 1, most)


def title_case(c: Column) -> Column:
    """Underscores as spaces, each letter after a character that is no letter in upper case (``item_1a`` gives ``Item 1A``)."""
    spaced = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    letters = F.split(spaced, "")
    letter = lambda x: x.rlike(r"\p{L}")
    raised = F.transform(letters, lambda x, i: F.when((i == 0) | ~letter(F.coalesce(F.try_element_at(letters, i), F.lit(" "))), F.upper(x)).otherwise(x))
    return F.array_join(raised, "")


def signed(c: Column, digits: int = 3) -> Column:
    """A number with its sign and a fixed number of digits; null as ``N/A``."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string(f"%+.{digits}f", c.cast("double")))


def per_cent(c: Column, digits: int = 1) -> Column:
    """A share in per cent; null as ``N/A``."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f%%", c.cast("double") * 100))


def stamp(c: Column | None = None) -> Column:
    """A timestamp as it stands in file names, of now by default; no query's result holds it."""
    return F.date_format(c if c is not None else F.current_timestamp(), "yyyyMMdd_HHmmss")


def without_zeros(c: Column) -> Column:
    """A number in text without leading zeros; ``0`` for nothing but zeros."""
    return F.when(c.rlike("^0+$"), "0").otherwise(F.regexp_replace(c, "^0+", ""))
