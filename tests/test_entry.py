import glob
import os
import re

import __spark_entry__ as entry
from filingloom.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert set(registry.queries()) <= set(found) and len(registry.queries()) > 50


def test_nothing_outside_the_text_operators_imports_them():
    for path in glob.glob(f"{ROOT}/filingloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"filingloom\.llm|from \.+llm|import llm", open(path).read()), path


def test_flagship(spark):
    if os.path.isdir(entry.FLAGSHIP_DIR):
        df = entry.entry(spark)
        assert df.columns == ["section", "signal", "n"] and df.count() > 0


def test_only_the_absence_of_the_text_operators_is_forgiven():
    source = open(f"{ROOT}/__spark_entry__.py").read()
    assert "ModuleNotFoundError" in source and "except ImportError" not in source
