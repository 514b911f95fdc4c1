"""Every query of the numerical engine against its SQL on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = db.execute(registry.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["el_sin", "op_times", "mm_transpose", "red_sum_1", "scan_cumsum_1", "str_upper", "dt_add_days", "mm_gram"])
def test_no_python_in_the_plan(spark, name):
    assert "Python" not in plan(registry.QUERIES[name](spark, SF)) and "Arrow" not in plan(registry.QUERIES[name](spark, SF))


def test_flagship_plan(spark):
    text = plan(registry.QUERIES["flagship_net_by_flag"](spark, SF))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1 and "l_shipdate" not in text
