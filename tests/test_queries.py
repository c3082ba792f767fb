import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from assize.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(spark, duck, name):
    a, b = core.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(core.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "assize")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "assize.llm" not in f.read(), n


def test_scans_are_pruned(spark):
    plan = core.QUERIES["binary_accuracy"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "reasoning_content" not in plan and "PushedFilters: [IsNotNull(eval_mode), EqualTo(eval_mode,binary)" in plan.replace("...", "")
