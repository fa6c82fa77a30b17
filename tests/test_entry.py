import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from quillspan.plans import registry

SF = "/root/testdata/sf0.001"
CORE = registry.collect("QUERIES")
ORACLE = registry.collect("ORACLE")


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for f in os.listdir(SF):
        d.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return d


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_contract(spark):
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and set(CORE) <= set(q)
    df = entry.entry(spark)
    assert df.columns == ["sha256", "copies", "first_id", "bytes"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = CORE[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr(tuple(plain(x) for x in r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(ORACLE)))
def test_query_runs(spark, name):
    assert CORE[name](spark, SF).count() >= 0


def test_core_does_not_import_the_training_data_subpackage():
    root = os.path.dirname(os.path.abspath(registry.__file__))
    for base, _, names in os.walk(os.path.dirname(root)):
        if os.path.basename(base) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(base, n)).read()
                assert not re.search(r"quillspan\.llm|from \.*llm", text), n
