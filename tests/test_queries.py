import os

import pytest

from compare import DATA, both
from filingloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    ours, theirs = both(spark, registry.queries()[name], registry.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_retrieve_fallback_by_keywords(spark, tmp_path, monkeypatch):
    """Documents that name tickers and sources, most of them without a vector; no text is looked through once for each pair."""
    import compare

    rows = [(i, f"T{i % 400}", "item_7" if i % 300 else None, "press note", f"t{i % 7 * 100} wrote a {'press' * (i % 2)} item_{i % 9} " + ("note|" * (i % 3 == 0)) if i % 11 else None) for i in range(1, 1201)]
    spark.createDataFrame(rows, "doc_id bigint, ticker string, section string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "kept"))
    spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(90, 210)], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "vectors"))
    data = tmp_path / "data"
    data.mkdir()
    for name, place in (("documents", "kept"), ("embeddings", "vectors")):
        next((tmp_path / place).glob("*.parquet")).rename(data / f"{name}.parquet")
    monkeypatch.setattr(compare, "DATA", str(data))
    query = registry.queries()["retrieve_fallback"]
    ours, theirs = both(spark, query, registry.oracle_sql()["retrieve_fallback"])
    assert ours == theirs and sum("keyword" in r for r in ours) == 50
    assert "Contains(" not in query(spark, str(data))._jdf.queryExecution().toString()
