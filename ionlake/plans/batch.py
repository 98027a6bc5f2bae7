"""Ion images of one data set for a list of masses, written as bitmaps."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.operators import imaging
from ionlake.operators.tables import numbered, settled
from ionlake.sources import imzml
from ionlake.sources.files import Registry, dense, write_bmp


def parse_masses(text: str) -> list[float]:
    """Comma-separated positive numbers; anything else is refused."""
    masses = [float(t) for t in text.split(",")]
    if any(m <= 0 for m in masses):
        raise ValueError("masses must be positive")
    return masses


def image_files(points: DataFrame, masses: list[float], tol: float, folder: str, name: str, levels: int = 256, method: str = "triq", median: bool = False, mask: DataFrame | None = None, registry: Registry | None = None) -> list[str]:
    """One plan makes all images; each finished raster is small and is fetched on its own."""
    rows = imaging.masked(points, mask) if mask is not None else points
    make = imaging.ion_images if len(masses) <= imaging.FEW_MASSES else imaging.ion_images_bucketed
    images = make(rows, masses, tol)
    levelled = (imaging.triq(images, levels, by=("mass",)) if method == "triq" else imaging.quantize_linear(images, levels, by=("mass",))).persist()
    os.makedirs(folder, exist_ok=True)
    out = []
    for mass in sorted(masses):
        one = levelled.where(F.col("mass") == mass).select("x", "y", F.col("level").cast("double").alias("level"))
        path = f"{folder}/{name.replace('.', '_')}_{str(mass).replace('.', '_')}.bmp"
        write_bmp(dense(imaging.median3(one, "level") if median else one, "level"), path)
        out.append(path)
    levelled.unpersist()
    if registry:
        registry.update(name, has_images=True, image_folder=folder)
    return out


def convert(spectra: DataFrame, pixels: DataFrame, path: str, compressed: bool = False) -> None:
    """A run of scans (spectrum_id, scan_time_ms, mz, intensity) rendered to the pixels (x, y, t) and written as imzML, y upwards."""
    from ionlake.operators import convert as ops

    start = spectra.agg(F.min("scan_time_ms").alias("zero"))
    timed = spectra.where("scan_time_ms is not null").crossJoin(F.broadcast(start)).select("spectrum_id", (F.col("scan_time_ms") - F.col("zero")).alias("t"), "mz", "intensity", "mode")
    ids = timed.select("spectrum_id", "t")
    scans = settled(numbered(ids, ["t", "spectrum_id"], "scan"))
    order = settled(numbered(pixels.select("x", "y", "t"), ["t", "y", "x"], "pixel"))
    weights = ops.scan_weights(ops.match_times(scans.select("scan", "t"), order.select("pixel", "t")), scans.select("scan", "t"))
    rows = timed.join(scans.select("spectrum_id", "scan"), "spectrum_id").select("scan", "mode", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p"))
    summed = ops.render(weights, rows.select("scan", "pos", F.col("p.intensity").alias("intensity")))
    firsts = weights.groupBy("pixel").agg(F.min("scan").alias("scan"))
    axis = firsts.join(rows, "scan").select("pixel", "pos", F.col("p.mz").alias("mz"))
    modes = weights.join(timed.join(scans, "spectrum_id").select("scan", "mode"), "scan").groupBy("pixel").agg(F.max("mode").alias("mode"))
    arrays = axis.join(summed, ["pixel", "pos"]).groupBy("pixel").agg(F.sort_array(F.collect_list(F.struct("pos", "mz", "intensity"))).alias("p"))
    height = pixels.agg(F.max("y").alias("h"))
    out = order.join(arrays, "pixel", "left").join(modes, "pixel", "left").crossJoin(F.broadcast(height)).select(
        F.col("pixel").alias("spectrum_id"), "x", (F.col("h") - F.col("y") + 1).cast("int").alias("y"), F.lit("").alias("native_id"), F.coalesce("mode", F.lit("UNKNOWN")).alias("mode"),
        F.coalesce(F.col("p.mz"), F.array().cast("array<double>")).alias("mz"), F.coalesce(F.col("p.intensity"), F.array().cast("array<double>")).alias("intensity"),
    )
    imzml.save(out, path, compressed)
