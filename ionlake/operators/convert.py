"""Matching scans to pixels by time, and rendering pixels from the scans they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a time range aims at.
ROWS_A_RANGE = 100_000


def _ranged(rows: DataFrame, t: str) -> DataFrame:
    """Adds ``range``: the number of one of equally wide time ranges, enough of them for ROWS_A_RANGE rows each on average."""
    span = rows.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / ROWS_A_RANGE))
    return rows.crossJoin(F.broadcast(span.select("lo", width.alias("width")))).withColumn("range", F.floor((F.col(t) - F.col("lo")) / F.col("width"))).drop("lo", "width")


def _with_neighbours(rows: DataFrame, t: str, key: str) -> DataFrame:
    """Adds ``before`` and ``after``: the times of the rows next to each by (t, key). Ranges are sorted apart; one row a range carries over their borders."""
    ranged = _ranged(rows, t)
    line = Window.orderBy("range")
    ends = ranged.groupBy("range").agg(F.min(t).alias("low"), F.max(t).alias("high")).select("range", F.lag("high").over(line).alias("carry_before"), F.lead("low").over(line).alias("carry_after"))
    inner = Window.partitionBy("range").orderBy(t, key)
    placed = ranged.join(ends, "range").withColumn("before", F.coalesce(F.lag(t).over(inner), F.col("carry_before"))).withColumn("after", F.coalesce(F.lead(t).over(inner), F.col("carry_after")))
    return placed.drop("range", "carry_before", "carry_after")


def match_times(scans: DataFrame, pixels: DataFrame) -> DataFrame:
    """(pixel, t, first_scan, last_scan): the scans that a pixel's time spans, from scans (scan, t) and pixels (pixel, t), times not decreasing with the numbers.

    k counts the scans before the pixel's time. Once all scans are before it nothing is left: (n + 1, n). Scans and
    pixels are ordered within time ranges; the scans and the largest k of each range, one row a range, carry over.
    """
    both = _ranged(scans.select("t", F.lit(1).alias("is_scan"), F.lit(None).cast("long").alias("pixel")).union(pixels.select("t", F.lit(0), "pixel")), "t")
    line, earlier = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("range").agg(F.sum("is_scan").alias("s")).select("range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"), F.sum("s").over(Window.partitionBy()).alias("n"))
    inner = Window.partitionBy("range").orderBy("t", "is_scan", "pixel")
    k = F.coalesce(F.sum("is_scan").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("offset")
    counted = both.join(sums, "range").withColumn("k", k).where("is_scan = 0")
    carry = counted.groupBy("range").agg(F.max("k").alias("top")).select("range", F.lag("top").over(line).alias("carry"))
    previous = F.coalesce(F.lag("k").over(Window.partitionBy("range").orderBy("t", "pixel")), F.col("carry"), F.lit(1))
    last = F.greatest(F.lit(1), F.col("k"))
    first = F.least(last, F.greatest(F.lit(1), previous))
    spent = F.col("k") >= F.col("n")
    return counted.join(carry, "range").select("pixel", "t", F.when(spent, F.col("n") + 1).otherwise(first).alias("first_scan"), F.when(spent, F.col("n")).otherwise(last).alias("last_scan"))


def scan_weights(matched: DataFrame, scans: DataFrame) -> DataFrame:
    """(pixel, scan, weight) of every scan in a pixel's range: the share of the scan that the pixel's time covers.

    One scan: pixel time over scan time. Otherwise the first counts from the pixel's start to the next scan, the
    last from its start to the next pixel, those between in full. Nothing is negative; the last pixel and scan
    last as long as those before them.
    """
    step = lambda c: F.greatest(F.coalesce(F.col("after") - F.col(c), F.col(c) - F.col("before"), F.lit(1)), F.lit(1))
    p = _with_neighbours(matched, "t", "pixel").withColumn("dp", step("t")).where("first_scan <= last_scan").drop("before", "after")
    s = _with_neighbours(scans.select("scan", F.col("t").alias("ts")), "ts", "scan").select("scan", "ts", step("ts").alias("ds"))
    rows = p.select("*", F.explode(F.sequence("first_scan", "last_scan")).alias("scan")).join(s, "scan")
    one = F.col("first_scan") == F.col("last_scan")
    first = (F.col("ts") + F.col("ds") - F.col("t")) / F.col("ds")
    last = (F.col("t") + F.col("dp") - F.col("ts")) / F.col("ds")
    weight = F.when(one, F.col("dp") / F.col("ds")).when(F.col("scan") == F.col("first_scan"), first).when(F.col("scan") == F.col("last_scan"), last).otherwise(1.0)
    return rows.select("pixel", "scan", F.greatest(F.lit(0.0), weight).alias("weight"))


def render(weights: DataFrame, points: DataFrame) -> DataFrame:
    """(pixel, pos, intensity): the weighted sum of the scans' intensities, by position on their axis."""
    return weights.join(points, "scan").groupBy("pixel", "pos").agg(F.sum(F.col("weight") * F.col("intensity")).alias("intensity"))
