import os

import duckdb
import pytest

pytest.importorskip("assize.llm")
from assize.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    a, b = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(str, map(tuple, a.select(columns).collect()))) == sorted(map(str, b.select(*columns).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_with_distinct_rows(spark, name):
    df = QUERIES[name](spark, FOLDER).toPandas()
    assert len(df) > 0 and not df.astype(str).duplicated().any()


def test_found_columns(spark):
    want = {
        "p2_found": [("field_name", "string"), ("record_id", "bigint")],
        "p3_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p5_found": [("field_name", "string"), ("record_id", "bigint"), ("defect", "string")],
        "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint"), ("variant", "string")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, FOLDER).dtypes == columns, name


def test_broken_and_cut_agree(spark):
    cut = {tuple(r) for r in QUERIES["p2_found"](spark, "/root/testdata/sf0.01").collect()}
    broken = {(r.field_name, r.record_id) for r in QUERIES["p5_found"](spark, "/root/testdata/sf0.01").where("defect = 'truncated'").collect()}
    answers = {r for r in cut if r[0] != "r1_reasoning_trace_summarized"}
    assert len(answers ^ broken) <= 0.02 * len(answers)
