"""Every query with SQL gives the rows that DuckDB gets from it, on tables made here."""

import duckdb
import pytest

from sheetwise.plans import registry


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    emb = "transform(sequence(0, 63), k -> cast(sin(id * 0.7 + k * (1 + id % 7)) as float))"
    spark.range(120).selectExpr("id as vec_id", f"{emb} as embedding", "cast(id % 10 as int) as label").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    spark.range(300).selectExpr("id as p_partkey", "cast(1 + id * 37 % 50 as int) as p_size", "900 + (id * 7919 % 1009) * 1.0 as p_retailprice").selectExpr("p_partkey", "p_size", "cast(p_retailprice as double) as p_retailprice").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.range(500).selectExpr("cast(1 + id * 31 % 50 as double) as l_quantity", "cast(id * 17 % 11 as double) / 100 as l_discount").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    spark.range(200).selectExpr("id as event_id", "cast(timestamp_seconds(1700000000 + id * 7919 % 100000) as timestamp_ntz) as ts", "id % 9 as user_id").coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "part", "lineitem", "events"):
        con.register(t, con.sql(f"SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')").to_arrow_table())
    return at, con


CHEAP = [n for n in registry.oracle_sql() if not n.startswith(("curve_", "surface_"))] + ["curve_trefoil", "curve_pentagram", "surface_boy", "surface_cube", "surface_tangent_spheres"]


@pytest.mark.parametrize("name", CHEAP)
def test_oracle(spark, data, name):
    at, con = data
    df = registry.queries()[name](spark, at)
    cols = sorted(df.columns)
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    want = sorted((tuple(r[found.columns.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert all(a == b or isinstance(a, float) and abs(a - b) < 2e-5 for a, b in zip(x, y)), (x, y)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
