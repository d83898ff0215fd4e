"""The contract: registries agree, every query runs on the smallest tables, SQL twins give the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HERE = {k: v for k, v in entry_module.queries().items() if not k.startswith(("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "pipeline")) or k == "op_counts"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def test_registry():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(HERE) > 80


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(HERE))
def test_query(spark, tiny, name):
    df = HERE[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted((plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    sql = entry_module.oracle_sql().get(name)
    if not sql:
        assert got is not None
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((plain([row[i] for i in order]) for row in result.fetchall()), key=repr)
