"""Every imaging query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ionlake.plans import queries as imaging

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(imaging.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = imaging.QUERIES[name](spark, SF).toPandas(), duck.execute(imaging.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(str, f[columns].itertuples(index=False, name=None))) for f in (ours, theirs.astype(ours.dtypes))]
    assert rows[0] == rows[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, capsys):
    imaging.QUERIES["global_mz_range"](spark, SF).explain("formatted")
    shown = capsys.readouterr().out
    assert "ReadSchema: struct<event_id:bigint>" in shown


@pytest.mark.parametrize("name", ["align_linear", "pipeline_full", "peaks_wavelet"])
def test_partitions_do_not_matter(spark, name):
    few, many = (imaging.QUERIES[name](spark, SF) for _ in range(2))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(str, few.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(str, many.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a
