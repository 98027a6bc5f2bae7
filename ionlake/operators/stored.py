"""Points stored by blocks of spectra, with the spectra's statistics beside: images that read only candidates' blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import imaging, spectra
from ionlake.operators.tables import settled

#: Blocks of a stored data set, each a folder; and the shares a block's points are sorted in.
BLOCKS, SHARES = 64, 8


def store_points(points: DataFrame, folder: str, blocks: int = BLOCKS) -> None:
    """Writes ``stats`` (one row a spectrum) and ``points`` (block=k/, sorted by m/z) into a folder.

    Spectra whose m/z ranges begin alike share a block, so that a window touches few of them.
    """
    stats = settled(spectra.statistics(points))
    bounds = sorted(set(stats.approxQuantile("MinMZ", [k / blocks for k in range(1, blocks)], 0.2 / blocks)))
    block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("MinMZ"))) if bounds else F.lit(0)
    placed = settled(stats.withColumn("block", block.cast("int")))
    placed.write.option("compression", "zstd").parquet(f"{folder}/stats")
    where = placed.select(F.col("SpectrumID").alias("spectrum_id"), "block")
    dealt = points.join(where, "spectrum_id").repartition("block", F.pmod(F.xxhash64("spectrum_id"), F.lit(SHARES)))
    dealt.sortWithinPartitions("block", "mz").write.option("compression", "zstd").partitionBy("block").parquet(f"{folder}/points")


def stats_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/stats")


def candidate_points(spark: SparkSession, folder: str, masses: list[float], tol: float) -> DataFrame:
    """The points in any mass's window, of the spectra whose m/z range meets one.

    The candidates come from the stored statistics. Their blocks, at most as many as were stored, become a filter on
    the partitions, and the windows one on m/z; both reach the scan. No aggregate over points is needed for either.
    """
    meets = [(F.lit(m + tol) >= F.col("MinMZ")) & (F.lit(m - tol) <= F.col("MaxMZ")) for m in masses]
    found, inside = meets[0], imaging.in_window(masses[0], tol)
    for other, m in zip(meets[1:], masses[1:], strict=True):
        found, inside = found | other, inside | imaging.in_window(m, tol)
    hit = stats_of(spark, folder).where(found).select(F.col("SpectrumID").alias("spectrum_id"), "block")
    blocks = [r["block"] for r in hit.select("block").distinct().collect()]  # at most the stored blocks
    rows = spark.read.parquet(f"{folder}/points").where(F.col("block").isin(blocks)).where(inside)
    return rows.join(hit.select("spectrum_id"), "spectrum_id", "left_semi").drop("block")
