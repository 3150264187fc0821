import datetime as dt

from pyspark.sql import functions as F

from filingloom.sources import files
from filingloom.sources.tables import section_key
from filingloom.streaming import arrivals

PAGE = "<html><head><style>p{}</style><script>x()</script></head><body><h2>Item 7</h2><p>Net &amp; gross</p><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table><table></table></body></html>"


def test_names(spark):
    names = ["AAPL_2025-10-31_item_1a.txt", "AAPL_10K_2024-11-01.html", "MSFT_2023-07-27_sentiment.json", "odd", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(*files.file_keys(F.col("n")), files.file_section(F.col("n")).alias("s")).collect()
    assert [(r.ticker, r.filing_date, r.s) for r in got] == [("AAPL", dt.date(2025, 10, 31), "item_1a"), ("AAPL", dt.date(2024, 11, 1), None), ("MSFT", dt.date(2023, 7, 27), None), (None, None, None), (None, None, None)]


def test_section_keys(spark):
    keys = spark.createDataFrame([(k,) for k in ("Item 1A", "ITEM_1A", "1a", "item1a", None)], "s string").select(section_key("s").alias("k")).collect()
    assert [r.k for r in keys] == ["item_1a"] * 4 + [None]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "AB_2024-01-02_item_7.txt").write_text("one\ntwo")
    assert [(r.ticker, r.section, r.text) for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == [("AB", "item_7", "one\ntwo")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"ticker": "AB", "extra": 1}')
    (tmp_path / "j" / "b.json").write_text('{"ticker": ')
    assert [r.ticker for r in files.read_records(spark, str(tmp_path / "j"), "ticker string").collect()] == ["AB"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "AB.csv").write_text("Date,Close\n2024-01-02,3.5\nbad,1\n2024-01-03,\n")
    assert [(r.ticker, r.close) for r in files.read_series(spark, str(tmp_path / "p")).collect()] == [("AB", 3.5)]
    assert {r.files for r in files.storage(spark, str(tmp_path / "j")).collect()} == {2}


def test_pages(spark):
    pages = files.parse_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string"), "id", "html")
    by = {r.id: r for r in pages.collect()}
    assert by[1].text.split("\n")[:2] == ["## Item 7", "Net & gross"] and "x()" not in by[1].text
    assert by[1].text.split("\n")[2:] == ["| a | b |", "|---|---|", "| 1 | 2 |"]
    assert [(t.rows, t.cols) for t in by[1].tables] == [(2, 2), (0, 0)] and by[2].text is None and by[3].text == ""
    assert [r.cells for r in files.table_cells(pages, "id").orderBy("row_ix").collect()] == [["a", "b"], ["1", "2"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, n string")
    files.write_table(df, str(tmp_path / "t"), "k")
    files.write_table(df.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    files.write_json(df, str(tmp_path / "j"))
    assert '"n":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())


def test_streams(spark, tmp_path):
    rows = [(i, "sentiment", f"f{i % 3}", dt.datetime(2026, 1, 1, i % 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id long, stage string, file_name string, loaded_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals.stream_table(spark, str(tmp_path / "in"), df.schema)
    assert arrivals.loads_per_window(stream).isStreaming
    batch = arrivals.loads_per_window(df).collect()
    assert sum(r.records for r in batch) == 12 and len(batch) == 4
    q = arrivals.write_stream(arrivals.first_arrivals(stream, ["file_name"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_tables_within_tables_and_parse_outputs(spark):
    html = "<p>x</p><table><tr><td>out<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr>"
    pages = files.parse_pages(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html")
    assert pages.where("id = 1").first().text.split("\n") == ["x", "| in |", "|---|", "| out | b |", "|---|---|", "| c | |"]
    meta, tables = files.parse_outputs(pages, "id", [])
    by = {r.id: r for r in meta.collect()}
    assert (by[1].success, by[1].table_count, [(t.rows, t.cols) for t in by[1].tables]) == (True, 2, [(2, 2), (1, 1)])
    assert (by[2].success, by[2].total_words, by[2].table_count) == (False, 0, 0) and tables.count() == 3


def test_filing_list(spark):
    rows = [("AB", "0000320193", ["10-K/A", "10-K", "8-K", "10-K"], ["0-1", "00-11-2", "x", "3-4"], ["2024-01-01", "2023-11-03", "2023-01-01", "2022-10-28"], ["z.htm", "a.htm", "q", "b.htm"]), ("CD", "0", [], [], [], []), ("EF", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ticker string, cik string, form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>")
    arrays = ["form", "accessionNumber", "filingDate", "primaryDocument"]
    got = files.filing_list(df, "ticker", "cik", arrays, 5, site="https://example.org").collect()
    assert [(r.n, r.filing_date, r.accession, r.year, r.url) for r in got] == [
        (0, "2023-11-03", "00112", "2023", "https://example.org/Archives/edgar/data/320193/00112/a.htm"),
        (1, "2022-10-28", "34", "2022", "https://example.org/Archives/edgar/data/320193/34/b.htm"),
    ]
    assert files.filing_list(df, "ticker", "cik", arrays).count() == 1


def test_index_tables(spark, tmp_path):
    path = str(tmp_path / "ix")
    df = spark.createDataFrame([("A", 1, [0.1]), ("A", 2, [0.2]), ("B/C", 3, [0.3])], "ticker string, id int, v array<float>")
    files.index_bulk(df, path)
    files.index_bulk(df.where("id = 3").withColumn("id", F.lit(4)), path)
    assert {(r.ticker, r.documents) for r in files.index_stats(spark, path).collect()} == {("A", 2), ("B/C", 2)}
    assert files.index_delete(spark, path, "B/C") and not files.index_delete(spark, path, "none")
    assert {(r.ticker, r.documents) for r in files.index_stats(spark, path).collect()} == {("A", 2)}


def test_cached_series(spark, tmp_path):
    cache, calls = str(tmp_path / "c"), []

    def fetch(ticker):
        calls.append(ticker)
        return spark.createDataFrame([("2024-01-03", 2.0), ("2024-01-02", 1.0), (None, 3.0)], "d string, close double")

    assert files.cached_tickers(spark, cache) == [] and files.cached_series(spark, cache, "AB").count() == 0
    for _ in range(2):
        assert [r.close for r in files.cached_series(spark, cache, "AB", fetch).collect()] == [1.0, 2.0]
    assert calls == ["AB"] and files.cached_tickers(spark, cache) == ["AB"]
    files.cached_series(spark, cache, "AB", fetch, refresh=True)
    assert calls == ["AB", "AB"]
