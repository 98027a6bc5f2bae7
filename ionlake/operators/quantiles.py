"""Exact quantiles of large groups, by histograms that are refined until what is left of a group is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.operators.tables import settled

#: Powers of two between the least and the greatest share of a range that a double can hold.
OCTAVES = 1080
#: Bins a round, rows of a group that are sorted in the end, and groups whose state is sent to all tasks.
BINS, FEW, BROADCAST_GROUPS = 512, 1024, 50_000


def _met(rows: DataFrame, state: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """The rows inside the ranges of ``state``, once for each range of their group."""
    ranges = state.select(*[F.col(k).alias(f"of_{k}") for k in keys], "target", "low", "high", "skip")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = F.col("v").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(ranges) if groups <= BROADCAST_GROUPS else ranges, same & inside)


def quantiles(rows: DataFrame, keys: list[str], value: Column | str, q: float = 0.5, name: str = "value") -> DataFrame:
    """(keys..., ``name``): the q-quantile of ``value`` in each group, between neighbours linearly; nulls and NaN don't count.

    A group is never gathered. A round counts the rows of each group in BINS parts of the range that still holds the
    wanted rank, one row a bin; the part with the rank becomes the next range, cut to the least and greatest value in
    it. Parts are equal in one round and grow by powers of two in the next, which long tails need. Groups that hold
    FEW rows or one value there are done and finish by sorting those. A quantile between two ranks follows both.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = rows.select(*keys, v.alias("v")).where("v is not null and not isnan(v)")
    sizes = values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = (F.col("n") - 1) * F.lit(float(q))
    targets = F.explode(F.array(F.struct(F.lit(0).alias("target"), F.floor(place).alias("skip")), F.struct(F.lit(1).alias("target"), F.ceil(place).alias("skip")))).alias("t")
    state = settled(sizes.select(*keys, "low", "high", "n", (place - F.floor(place)).alias("share"), targets).select(*keys, "low", "high", "n", "share", "t.*"))
    groups = state.count()
    turn = 0
    while state.where(f"n > {FEW} and low < high").limit(1).count():
        todo, done = state.where(f"n > {FEW} and low < high"), state.where(f"not (n > {FEW} and low < high)")
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        octave = F.when(share > 0, 1 + F.greatest(F.lit(0.0), F.log2(share) + OCTAVES) * ((BINS - 2) / OCTAVES)).otherwise(0.0)
        bin_of = F.least(F.lit(BINS - 1), F.floor(octave if turn % 2 else share * BINS))
        turn += 1
        counts = _met(values, todo, keys, groups).groupBy(*keys, "target", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("skip").alias("skip"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "target").orderBy("bin"))
        found = counts.withColumn("upto", upto).where("upto > skip and upto - n <= skip").withColumn("skip", F.col("skip") - F.col("upto") + F.col("n"))
        shares = todo.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("target").alias("of_target"), "share")
        same = F.col("target") == F.col("of_target")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        state = settled(found.join(shares, same).select(*keys, "low", "high", "n", "share", "target", "skip").unionByName(done))
    flat = state.where("low = high").select(*keys, "target", "share", F.col("low").alias("v"))
    several = state.where("low < high")
    ranked = _met(values, several, keys, groups).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "target").orderBy("v")) - 1).where("rank = skip")
    exact = ranked.select(*keys, "target", F.col("v"))
    shares = several.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("target").alias("of_target"), "share")
    same = F.col("target") == F.col("of_target")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    both = flat.unionByName(exact.join(shares, same).select(*keys, "target", "share", "v"))
    low, high = (F.max(F.when(F.col("target") == t, F.col("v"))) for t in (0, 1))
    return both.groupBy(*keys).agg((low + (high - low) * F.max("share")).alias(name))
