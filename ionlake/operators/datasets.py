"""Tables of data sets and files: order of names, neighbours, duplicate numbers, distinct additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: str, digits: int = 20) -> Column:
    """A key under which names sort with their numbers as numbers: every run of digits filled up with zeros."""
    parts = F.regexp_extract_all(F.col(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, digits, "0")).otherwise(p)), "")


def with_neighbours(images: DataFrame, folder: str, name: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the names around each in its folder's natural order; the ends are their own."""
    line = Window.partitionBy(folder).orderBy(natural_key(name), name)
    return images.withColumn("previous", F.coalesce(F.lag(name).over(line), F.col(name))).withColumn("next", F.coalesce(F.lead(name).over(line), F.col(name)))


def has_duplicates(rows: DataFrame, index: str) -> DataFrame:
    """One row: the rows, the distinct indices, and whether they differ."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct(index).alias("n_distinct")).withColumn("duplicates", F.col("n") != F.col("n_distinct"))


def appended(listed: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The list with what it doesn't hold yet; entries that are there stay as they are."""
    return listed.unionByName(more.dropDuplicates([key]).join(listed.select(key), key, "left_anti").select(*listed.columns))


def image_capable(entries: DataFrame) -> DataFrame:
    return entries.where("is_imzml")


def together(files: dict[str, DataFrame]) -> DataFrame:
    """The rows of several data sets with the ``file`` that each comes from."""
    found = None
    for name, rows in files.items():
        one = rows.withColumn("file", F.lit(name))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no files")
    return found


def flat_index(width: int) -> Column:
    """The number of a pixel (x, y) of a full raster, row by row from 1."""
    return (F.col("y") - 1) * width + F.col("x")
