"""Every query with an oracle against it, on the smallest tables."""

import duckdb
import pytest

from shapewright.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted(tuple("none" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert norm(got.select(*columns).collect()) == norm(duck.sql(f"select {listed} from ({ORACLES[name]})").fetchall())


def test_a_key_of_zero_is_a_time(spark, tmp_path):
    """The first supplier's key is zero, and its variation is not the later one of its nation."""
    c = duckdb.connect()
    c.sql("create table supplier as select i::bigint s_suppkey, (i % 2)::int s_nationkey from (values (0), (2), (3), (5), (6), (9)) t(i)")
    c.sql("insert into supplier values (7, 0)")
    c.sql(f"copy supplier to '{tmp_path}/supplier.parquet'")
    got = QUERIES["merge_empty_arrays"](spark, str(tmp_path))
    columns = sorted(got.columns)
    listed = ", ".join(f'"{x}"' for x in columns)
    want = norm(c.sql(f"select {listed} from ({ORACLES['merge_empty_arrays']})").fetchall())
    assert norm(got.select(*columns).collect()) == want and len(want) == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
