"""Spectral views over the given tables: each row of points is one (m/z, intensity) of a pixel's spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a user is a spectrum, m/z comes from the event's number."""
    return _table(spark, sf_dir, "events").select(
        (F.col("user_id") + 1).alias("spectrum_id"),
        (F.col("user_id") % 15 + 1).cast("int").alias("x"),
        (F.floor(F.col("user_id") / 15) + 1).cast("int").alias("y"),
        F.col("event_id").alias("pos"),
        (100 + (F.col("event_id") % 1000) / 10).alias("mz"),
        F.col("value").alias("intensity"),
    )


def pts_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: a supplier is a spectrum, prices are m/z; positions number the rows by all that they hold."""
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("spectrum_id"),
        (F.col("l_suppkey") % 10 + 1).cast("int").alias("x"),
        (F.floor(F.col("l_suppkey") / 10) + 1).cast("int").alias("y"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.col("l_extendedprice").alias("mz"),
        F.col("l_quantity").alias("intensity"),
    )


def pts_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: profile spectra on a regular axis; the label is a region."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return rows.select(
        (F.col("vec_id") + 1).alias("spectrum_id"),
        (F.col("vec_id") % 25 + 1).cast("int").alias("x"),
        (F.floor(F.col("vec_id") / 25) + 1).cast("int").alias("y"),
        F.col("pos").cast("long").alias("pos"),
        (100 + 0.5 * F.col("pos")).alias("mz"),
        F.abs(F.col("value").cast("double")).alias("intensity"),
        F.col("label").alias("region"),
    )


def spectra(points: DataFrame, by: str = "mz") -> DataFrame:
    """One row a spectrum with its arrays in m/z order, positions break ties, or in order of position."""
    rows = points.groupBy("spectrum_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct(*(("mz", "pos") if by == "mz" else ("pos", "mz")), "intensity"))).alias("p"))
    return rows.select("spectrum_id", "x", "y", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def checker_mask(points: DataFrame) -> DataFrame:
    """Pixels of a view off every third diagonal."""
    return points.select("x", "y").distinct().where((F.col("x") + F.col("y")) % 3 != 0)


EV = """p as (select user_id+1 spectrum_id, cast(user_id%15+1 as int) x, cast(floor(user_id/15.0e0)+1 as int) y, event_id pos,
 100+(event_id%1000)/10.0e0 mz, value intensity from events)"""
LI = """p as (select l_suppkey+1 spectrum_id, cast(l_suppkey%10+1 as int) x, cast(floor(l_suppkey/10.0e0)+1 as int) y, l_orderkey*8+l_linenumber pos,
 l_extendedprice mz, l_quantity intensity from lineitem)"""
EM = """p as (select vec_id+1 spectrum_id, cast(vec_id%25+1 as int) x, cast(floor(vec_id/25.0e0)+1 as int) y, cast(k as bigint) pos, 100+0.5e0*k mz,
 abs(cast(embedding[k+1] as double)) intensity, label region from embeddings, range(64) r(k))"""
MASK = "mask as (select distinct x, y from p where (x+y)%3<>0)"
