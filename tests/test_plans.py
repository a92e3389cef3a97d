"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from framelake.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def rows(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)) or v is pd.NA:
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return round(float(v), 9) if isinstance(v, (int, float, np.number)) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    if len(want) > 100_000:  # too many to compare as Python values
        got, want = (x[sorted(x.columns)].sort_values(sorted(x.columns), ignore_index=True) for x in (got, want))
        return pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and (df.count() > 0 or name == "op054_hamming_pairs")  # no near texts among so few


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_limits_below_the_shuffle(spark, data):
    plan = QUERIES["op069_topk_per_file"](spark, data)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_filter_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["op021_sharpness_gate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sharpness_center,75.0)" in plan and "embedding" not in plan
