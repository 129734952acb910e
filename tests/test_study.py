import duckdb
import pytest

from tidemark import study
from tidemark.operators import study as Y

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(study.QUERIES))
def test_query_equals_sql(spark, con, name):
    rows = lambda names, found: sorted((tuple(str(dict(zip(names, r))[c]) for c in sorted(names)) for r in found))
    df = study.QUERIES[name](spark, SF)
    want = con.execute(study.ORACLES[name])
    names = [d[0] for d in want.description]
    got, want = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want


def test_small_tables(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.5), ("c", None), ("d", 0.03)], "name string, p double")
    assert [r.name for r in Y.accepted(t, "p").collect()] == ["a"]
    assert Y.columns_only_in(t, t.select("p")) == ["name"]
    assert Y.accepted(t.limit(0), "p").count() == 0 and Y.null_shares(t.limit(0), ["p"]).first().share is None
    assert {r.name: r.x for r in Y.looked_up(t, Y.F.lit(1), {1: 2.0}, "x").collect()} == dict.fromkeys("abcd", 2.0)
