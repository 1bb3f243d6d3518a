"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os
from math import atan, cos, erfc, exp, pi, prod, sin, sqrt

import duckdb
import pytest

from varlake import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    assert rows(catalog.QUERIES[key](spark, DATA).toPandas()) == rows(con.execute(catalog.ORACLE[key]).to_arrow_table().to_pandas())


@pytest.mark.parametrize("key", ["TST4_pvalues", "TST7_SET4_graded_set", "TST9_dependence", "TST10_moment_pvalues", "TST12_ks", "FN_SPECIAL"])
def test_query_runs(spark, key):
    assert catalog.QUERIES[key](spark, DATA).count() > 0


def test_tails_of_returns_can_be_written(spark, tmp_path):
    """Column names differ, and the values are those of the tails' closed forms."""
    catalog.QUERIES["FN_SPECIAL"](spark, DATA).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("t").sort_index()
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    z = dict(con.execute(f"WITH {catalog.RETS} SELECT t, abs(ret - avg(ret) OVER ()) / stddev_pop(ret) OVER () FROM rets").fetchall())
    assert got.columns.tolist() == ["series", "student_t", "normal", "chi2_2", "chi2_7"] and got.index.tolist() == sorted(z)

    def student(x, df=30):
        a = atan(x / sqrt(df))
        return 1 - sin(a) * sum(prod((2 * i - 1) / (2 * i) for i in range(1, k + 1)) * cos(a) ** (2 * k) for k in range(df // 2))

    for name, tail in {
        "student_t": student, "normal": lambda x: erfc(x / sqrt(2)) / 2, "chi2_2": lambda x: exp(-x / 2),
        "chi2_7": lambda x: erfc(sqrt(x / 2)) + sqrt(2 * x / pi) * exp(-x / 2) * (1 + x / 3 + x * x / 15),
    }.items():
        assert got[name].tolist() == pytest.approx([tail(z[t]) for t in got.index], abs=1e-9)
