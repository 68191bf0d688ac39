"""Every query of the catalog at the smallest scale, against its SQL where it has one."""

import duckdb
import pandas as pd
import pytest

from readloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "" if v is None or v is pd.NA or v != v else round(v, 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_partitions_do_not_change_a_draw(spark):
    a = catalog.simulated_mixtures(spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        b = catalog.simulated_mixtures(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "uxm_atlas" in e.queries()
