"""Files of the pipeline: names, JSON records, pages and their tables, series, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filingloom.functions.text import word_count

NAME = r"^([A-Z]+)_(?:10K_)?(\d{4}-\d\d-\d\d)(?:_(item_\w+?))?(?:[._]|$)"


def file_keys(name: Column) -> list[Column]:
    """``ticker`` and ``filing_date`` out of a file's name without folders; null where it has none."""
    part = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    return [part(1).alias("ticker"), part(2).try_cast("date").alias("filing_date")]


def file_section(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, NAME, 3), F.lit(""))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, ticker, filing_date, section, text)``, one row a file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = spark.read.text(path, wholetext=True).select(name.alias("file_name"), F.col("value").alias("text"))
    return df.select("file_name", *file_keys(F.col("file_name")), file_section(F.col("file_name")).alias("section"), "text")


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON records of one file each; a file that can't be read is left out."""
    parsed = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.from_json(F.ltrim("value"), schema).alias("r"), F.try_parse_json("value").isNotNull().alias("good"))
    return parsed.where("good").select("file_name", "r.*")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, d, close)`` of CSV files named by ticker; rows without a date or value are left out."""
    df = spark.read.csv(path, header=True, schema="Date string, Close string", enforceSchema=False)
    ticker = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"^([^_.]+)", 1)
    return df.select(ticker.alias("ticker"), F.col("Date").substr(1, 10).try_cast("date").alias("d"), F.col("Close").try_cast("double").alias("close")).where("d is not null and close is not null")


class _Page(HTMLParser):
    """Text and tables of a page; script and style are left out, cells of nested tables belong to the inner one.

    In the text a table stands as rows of cells between bars, with a rule under the first, where it ends.
    """

    _BLOCKS = {"p", "div", "br", "tr", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")
        if tag in self._BLOCKS and not self.open:
            self.out.append("\n" + "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.out.append("\n" + as_rows(self.open.pop()) + "\n")
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not self.open:
            self.out.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.open:
            if self.open[-1] and self.open[-1][-1]:
                self.open[-1][-1][-1] += data
        else:
            self.out.append(data)

    def close(self):
        super().close()
        while self.open:  # tables that the page doesn't end
            self.out.append("\n" + as_rows(self.open.pop()) + "\n")


def as_rows(cells: list[list[str]]) -> str:
    """A table as lines of cells between bars; rows are filled up to the longest."""
    width = max(map(len, cells), default=0)
    lines = ["| " + " | ".join([" ".join(c.split()) for c in r] + [""] * (width - len(r))) + " |" for r in cells if width]
    return "\n".join(lines[:1] + ["|" + "---|" * width] * bool(lines) + lines[1:])


def parse_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, text, tables ARRAY<STRUCT<index, rows, cols, cells>>)`` of HTML pages, in Arrow batches; null pages give null text."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, h in zip(f["k"], f["h"]):
                page = _Page()
                if h is not None:
                    page.feed(h)
                    page.close()
                tables = [{"index": i, "rows": len(t), "cols": max(map(len, t), default=0), "cells": [[c.strip() for c in r] for r in t]} for i, t in enumerate(page.tables)]
                text = "\n".join(line for line in (" ".join(x.split()) for x in "".join(page.out).split("\n")) if line) if h is not None else None
                rows.append((k, text, tables))
            yield pd.DataFrame(rows, columns=["k", "text", "tables"])

    schema = f"k {kind}, text string, tables array<struct<index:int,rows:int,cols:int,cells:array<array<string>>>>"
    return df.select(df[key].alias("k"), df[html].alias("h")).mapInPandas(run, schema).withColumnRenamed("k", key)


def table_cells(pages: DataFrame, key: str) -> DataFrame:
    """``(key, table_ix, row_ix, cells)``: the tables of pages in long form."""
    t = pages.select(key, F.explode("tables").alias("t")).select(key, F.col("t.index").alias("table_ix"), F.posexplode("t.cells").alias("row_ix", "cells"))
    return t


def parse_outputs(pages: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a parse leaves behind: ``metadata`` (counts and the tables' sizes of each page) and ``tables`` (each table in long form).

    A page without html has a metadata row with ``success`` false, so that failures are rows too.
    """
    size = F.transform("tables", lambda t: F.struct(t["index"].alias("index"), t["rows"].alias("rows"), t["cols"].alias("cols")))
    meta = pages.select(key, *fields, F.col("text").isNotNull().alias("success"), F.coalesce(F.length("text"), F.lit(0)).alias("total_chars"), word_count(F.coalesce("text", F.lit(""))).alias("total_words"), F.size("tables").alias("table_count"), size.alias("tables"))
    return meta, table_cells(pages, key)


def filing_list(df: DataFrame, key: str, cik: str, arrays: list[str], limit: int = 1, form: str = "10-K", site: str = "") -> DataFrame:
    """``(key, n, filing_date, accession, document, year, url)``: the first ``limit`` filings of a form, out of parallel arrays.

    ``arrays`` names the columns of forms, accession numbers, dates and documents, in this order; amendments have another form. The
    order is that of the arrays; in the url leading zeros of the number and dashes of the accession are dropped.
    """
    forms, accessions, dates, documents = arrays
    rows = F.filter(F.arrays_zip(forms, accessions, dates, documents), lambda x: x[forms] == form)
    out = df.select(key, F.col(cik).alias("_cik"), F.posexplode(F.slice(rows, 1, limit)).alias("n", "_f"))
    accession = F.replace(F.col(f"_f.{accessions}"), F.lit("-"), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_replace("_cik", "^0+", ""), F.lit("")), F.lit("0"))
    url = F.concat_ws("/", F.lit(site), F.lit("Archives/edgar/data"), number, accession, F.col(f"_f.{documents}"))
    day = F.col(f"_f.{dates}")
    return out.select(key, "n", day.alias("filing_date"), accession.alias("accession"), F.col(f"_f.{documents}").alias("document"), F.substring(day, 1, 4).alias("year"), url.alias("url"))


def _tables(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def index_bulk(df: DataFrame, path: str, by: str = "ticker") -> None:
    """Adds rows to an index: a Parquet table with a partition for each value of ``by``, which a filtered search reads alone."""
    df.write.mode("append").partitionBy(by).parquet(path)


def index_delete(spark: SparkSession, path: str, value: str, by: str = "ticker") -> bool:
    """Removes one value's partition from an index; false if there is none. Nothing else is read or written."""
    named = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    part, system = _tables(spark, f"{path}/{by}={named}")
    return bool(system.delete(part, True))


def index_stats(spark: SparkSession, path: str, by: str = "ticker") -> DataFrame:
    """``(by, documents)`` of an index."""
    return spark.read.parquet(path).groupBy(by).agg(F.count("*").alias("documents"))


def cached_series(spark: SparkSession, cache: str, ticker: str, fetch: Callable[[str], DataFrame] | None = None, refresh: bool = False) -> DataFrame:
    """``(d, close)`` of a ticker, sorted: from the cache, else from ``fetch``, which is then cached.

    A cache that can't be read is fetched again; ``refresh`` fetches in any case. Without a cache and without ``fetch`` it is empty.
    """
    part = f"{cache}/ticker={ticker}"
    if not refresh:
        try:
            return spark.read.schema("d date, close double").parquet(part).orderBy("d")
        except AnalysisException:  # there is none
            pass
    if fetch is None:
        return spark.createDataFrame([], "d date, close double")
    fetched = fetch(ticker).select(F.col("d").cast("date").alias("d"), F.col("close").cast("double").alias("close")).where("d is not null and close is not null")
    fetched.write.mode("overwrite").parquet(part)
    return spark.read.schema("d date, close double").parquet(part).orderBy("d")


def cached_tickers(spark: SparkSession, cache: str) -> list[str]:
    """The tickers that a cache has a series of, sorted; folders are listed, nothing is read."""
    root, system = _tables(spark, cache)
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    return sorted(n.removeprefix("ticker=") for n in names if n.startswith("ticker="))


def write_table(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned; with ``overwrite`` only the partitions that ``df`` has are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def storage(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, files, mb)`` of everything below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), (F.sum("length") / 1e6).alias("mb"))
