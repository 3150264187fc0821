import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import DATA, both  # noqa: E402
from filingloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    ours, theirs = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    queries.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
