"""Driver contract: entry, queries and oracle names line up; every query runs on sf0.001."""

import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["seq", "title"] and len(rows) > 0


def test_oracles_cover_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no smoke data")
def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SMOKE)
        df.write.format("noop").mode("overwrite").save()
        assert df.columns, name


def test_cluster_shuffle_sizing():
    from broadsheet.session import MAX_SHUFFLE_PARTITIONS, shuffle_partitions_for
    assert shuffle_partitions_for(10**6) == 200
    assert shuffle_partitions_for(10**12) == 7451          # 1 TB at 128 MiB each
    assert shuffle_partitions_for(100 * 10**12) == MAX_SHUFFLE_PARTITIONS
