"""Queries of the cascade on keys that very many records share: whole results, and no class of records goes through the driver."""

import re

import duckdb
import pytest
from conftest import rows

from tonearm import session
from tonearm.plans.queries import ORACLE, QUERIES

#: Query by number of the finding (round 2).
QUERY = {
    "F2": "match_filename", "F5": "sync_preference", "F6": "compare_rewrite_locations", "F7": "match_cross_source", "F8": "match_stats_by_tier", "F9": "review_status_counts",
}


@pytest.fixture(scope="module")
def part(tmp_path_factory):
    """1,200 records of one artist with three titles: their classes take some 10 kB as files and 100 kB as rows."""
    d = tmp_path_factory.mktemp("part")
    duckdb.sql(
        "COPY (SELECT i AS p_partkey, 'red ring ' || i % 3 AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, (i * 7 % 50)::INTEGER AS p_size, 900 + (i * 13 % 400) / 10 AS p_retailprice "
        f"FROM range(1200) t(i)) TO '{d}/part.parquet' (FORMAT parquet)"
    )
    return str(d)


@pytest.mark.parametrize("finding", QUERY)
def test_classes_of_hot_keys_are_not_sent_out(spark, part, monkeypatch, finding):
    name, setting = QUERY[finding], "spark.sql.autoBroadcastJoinThreshold"
    # In proportion to the table: what is harmless, and the threshold, which the files stay below and the rows do not.
    monkeypatch.setattr(session, "HARMLESS", 40_000, raising=False)
    had = spark.conf.get(setting)
    spark.conf.set(setting, "40000")
    try:
        df = QUERIES[name](spark, part)
        joins = re.findall(r"(\w+Join) \[rank#\d+, tier#\d+, key#\d+(, band#\d+)?", df._jdf.queryExecution().executedPlan().toString())
        assert any(band for _, band in joins) and {kind for kind, _ in joins} == {"SortMergeJoin"}
        got = rows(df)
    finally:
        spark.conf.set(setting, had)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS FROM '{part}/part.parquet'")
    assert got and got == sorted(db.sql(ORACLE[name]).fetchall(), key=repr)
