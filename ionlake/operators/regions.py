"""Masks as pixel tables: thresholds, connected regions, morphology. A pixel is (x, y), counted from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionlake.operators.tables import settled

#: Columns of a tile; no row of a tile has more than half as many runs.
TILE = 256


def otsu_threshold(image: DataFrame, value: str = "intensity", bins: int = 256) -> DataFrame:
    """One row, ``threshold``: the middle of the histogram bin that parts the pixels into the two most different classes.

    The pixels are counted in ``bins`` equal bins; what follows works on one row a bin. Where all pixels agree it is
    their value.
    """
    span = image.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / step))).otherwise(0)
    counts = image.crossJoin(F.broadcast(span)).groupBy(at.alias("bin"), "low", "high").agg(F.count("*").cast("double").alias("n"))
    middle = F.col("low") + (F.col("bin") + 0.5) * step
    upto, every = Window.orderBy("bin"), Window.partitionBy()
    below, mass = F.sum("n").over(upto), F.sum(F.col("n") * middle).over(upto)
    all_n, all_mass = F.sum("n").over(every), F.sum(F.col("n") * middle).over(every)
    rows = counts.select("bin", "low", "high", middle.alias("middle"), below.alias("b"), (all_n - below).alias("a"), mass.alias("m"), (all_mass - mass).alias("r"))
    spread = F.when((F.col("b") > 0) & (F.col("a") > 0), F.col("b") * F.col("a") * (F.col("m") / F.col("b") - F.col("r") / F.col("a")) ** 2)
    best = rows.withColumn("spread", F.round(spread, 6)).agg(F.max_by(F.struct("middle"), F.struct(F.coalesce("spread", F.lit(-1.0)), -F.col("bin"))).alias("b"), F.max("low").alias("low"), F.max("high").alias("high"))
    return best.select(F.when(F.col("high") > F.col("low"), F.col("b.middle")).otherwise(F.col("low")).alias("threshold"))


def binarized(image: DataFrame, value: str = "intensity", scale: float = 1.0) -> DataFrame:
    """The pixels (x, y) whose value reaches the threshold times ``scale``."""
    return image.crossJoin(F.broadcast(otsu_threshold(image, value))).where(F.col(value) >= F.col("threshold") * scale).select("x", "y")


def runs(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, y, tile, x0, x1): the unbroken runs of each row, cut at the tiles' borders; ``id`` orders them by (y, x0)."""
    pixels = mask.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct().withColumn("tile", F.floor((F.col("x") - 1) / tile))
    row = Window.partitionBy("y", "tile").orderBy("x")
    islands = pixels.withColumn("island", F.col("x") - F.row_number().over(row)).groupBy("y", "tile", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return islands.select(F.struct("y", F.col("x0").alias("x")).alias("id"), "y", "tile", "x0", "x1")


def touching(found: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v) of runs that touch: one above the other in a tile, or end to end across a tile's border."""
    upper, lower = (found.select(F.col("id").alias(f"id_{s}"), F.col("y").alias(f"y_{s}"), F.col("tile").alias(f"tile_{s}"), F.col("x0").alias(f"x0_{s}"), F.col("x1").alias(f"x1_{s}")) for s in "ab")
    above = (F.col("tile_a") == F.col("tile_b")) & (F.col("y_a") + 1 == F.col("y_b")) & (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a"))
    beside = (F.col("y_a") == F.col("y_b")) & (F.col("x1_a") + 1 == F.col("x0_b"))
    ends = (upper.where(F.col("x1_a") % tile == 0), lower.where(F.col("x0_b") % tile == 1))
    pairs = upper.join(lower, above).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    return pairs.union(ends[0].join(ends[1], beside).select("id_a", "id_b"))


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, root) from a forest (node, root) in which every parent is smaller: pointers double until none moves."""
    now = settled(hooks)
    while True:
        up = now.select(F.col("node").alias("over"), F.col("root").alias("top"))
        after = settled(now.join(up, F.col("root") == F.col("over"), "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("node", "root")
        now = after.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node that is not the least of its component, the least one.

    In a round every node hooks to its least smaller neighbour; trees shrink to their roots, and the edges between
    roots are the next round's. Hubs are minima and joins, never lists.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down, found = settled(down), None
    while down.limit(1).count():
        roots = _roots(down.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"))
        a, b = (roots.select(F.col("node").alias(f"n_{s}"), F.col("root").alias(f"r_{s}")) for s in "ab")
        moved = down.join(a, F.col("u") == F.col("n_a"), "left").join(b, F.col("v") == F.col("n_b"), "left").select(F.coalesce("r_a", "u").alias("u"), F.coalesce("r_b", "v").alias("v"))
        down = settled(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("over"), F.col("root").alias("top"))
            found = found.join(up, F.col("root") == F.col("over"), "left").select("node", F.coalesce("top", "root").alias("root")).union(roots)
    if found is None:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return settled(found)


def regions(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """(x, y, region_y, region_x): the 4-connected regions of a mask, named by their first pixel in reading order.

    Each row is cut into runs; runs that touch are the graph whose components are the regions. An edge joins runs of
    neighbouring rows within a tile, or of neighbouring tiles within a row, so no join meets more than a tile's row.
    A repeated pixel counts once; an empty mask has no regions.
    """
    found = settled(runs(mask, tile))
    rooted = found.join(components(touching(found, tile)), F.col("id") == F.col("node"), "left").withColumn("first", F.coalesce("root", "id"))
    return rooted.select(F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"), F.col("y").cast("int").alias("y"), F.col("first.y").cast("int").alias("region_y"), F.col("first.x").cast("int").alias("region_x"))


def region_at(mask: DataFrame, x: int, y: int) -> DataFrame:
    """The pixels of the region that holds (x, y): what a flood fill from there reaches. Empty off the mask."""
    labelled = settled(regions(mask))
    seed = labelled.where((F.col("x") == x) & (F.col("y") == y)).select("region_y", "region_x")
    return labelled.join(F.broadcast(seed), ["region_y", "region_x"], "left_semi").select("x", "y")


def area_opened(mask: DataFrame, least: int) -> DataFrame:
    """Regions of fewer pixels go."""
    labelled = settled(regions(mask))
    large = labelled.groupBy("region_y", "region_x").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.join(large, ["region_y", "region_x"], "left_semi").select("x", "y")


def complement(mask: DataFrame, width: int, height: int) -> DataFrame:
    """The raster's pixels that the mask does not hold."""
    grid = mask.sparkSession.range(1, height + 1).select(F.col("id").cast("int").alias("y")).select("y", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("x")).select("x", "y")
    return grid.join(mask.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), ["x", "y"], "left_anti")


def area_closed(mask: DataFrame, least: int, width: int, height: int) -> DataFrame:
    """Holes of fewer pixels are filled: regions of the complement."""
    return complement(area_opened(complement(mask, width, height), least), width, height)


def _moved(mask: DataFrame, offsets: Column) -> DataFrame:
    across = mask.select("x", "y", F.explode(offsets).alias("dx")).select((F.col("x") + F.col("dx")).alias("x"), "y").distinct()
    return across.select("x", F.explode(offsets).alias("dy"), "y").select("x", (F.col("y") + F.col("dy")).alias("y")).distinct()


def dilated(mask: DataFrame, size: int) -> DataFrame:
    """A square of ``size`` ones around each pixel, along x and then along y; pixels may leave the raster."""
    return _moved(mask, F.sequence(F.lit(-(size // 2)), F.lit((size - 1) // 2)))


def closed(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Dilation, then erosion, by a square of ``size`` ones.

    Erosion is the dilation of the other pixels by the mirrored square, on a raster with ``size`` more on every side.
    """
    grown = dilated(mask, size).select((F.col("x") + size).cast("int").alias("x"), (F.col("y") + size).cast("int").alias("y"))
    rest = complement(grown, width + 2 * size, height + 2 * size)
    gone = _moved(rest, F.sequence(F.lit(-((size - 1) // 2)), F.lit(size // 2)))
    kept = complement(gone, width + 2 * size, height + 2 * size).select((F.col("x") - size).alias("x"), (F.col("y") - size).alias("y"))
    return kept.where(F.col("x").between(1, width) & F.col("y").between(1, height)).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def region_of_interest(image: DataFrame, width: int, height: int, value: str = "intensity", scale: float = 1.0, noise: float = 0.1, hole: float = 0.05, size: int = 2) -> dict[str, DataFrame]:
    """The steps of a mask over a raster's pixels: threshold, without specks, without holes, smoothed."""
    area = width * height
    binary = settled(binarized(image, value, scale))
    opened = settled(area_opened(binary, round(area * noise)))
    filled = settled(area_closed(opened, round(area * hole), width, height))
    return {"binary": binary, "opened": opened, "closed": filled, "smoothed": closed(filled, size, width, height)}
