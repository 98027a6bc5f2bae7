"""Mixing sources to target sizes by entropy balancing.

Every document gets the rate exp(lambda * size / mean size), at most 2, with one lambda a source: of all rates
that meet the source's token target these stay closest (in relative entropy) to taking each document once.
The lambdas solve the convex dual by Newton steps, each one aggregation over the table of distinct
(source, size) counts, which holds all that the dual reads. Rates become whole copies by carrying the rounding
error from document to document, from long to short ones, within groups of bounded size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionlake.llm.common import WORD, Scratch, text_of

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
GROUP = 4096
ROUNDS, NEAR = 60, 1e-9


def size_of(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): the weights in turn share SHARE of all, none above MOST times its own.

    A source stops at its limit in order of limit by weight; the level at which the first one stays below its
    limit is the level of all the rest. One row a source passes through these windows.
    """
    ranked = sources.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.lit(WEIGHTS[-1])
    for k, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(F.col("turn") % len(WEIGHTS) == k, w).otherwise(weight)
    ranked = ranked.withColumn("weight", weight).withColumn("limit", MOST * F.col("source_size"))
    line = Window.orderBy(F.col("limit") / F.col("weight"), "turn")
    everything = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("below", F.col("limit") > F.col("level") * F.col("weight"))
    rest = F.min(F.when(F.col("below"), F.struct("turn_in_line", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("turn_in_line", F.row_number().over(line)).withColumn("rest", rest)
    return ranked.withColumn("target", F.least("limit", F.coalesce(F.col("rest") * F.col("weight"), F.col("limit")))).drop(
        "turn", "weight", "limit", "level", "below", "turn_in_line", "rest"
    )


def tilts(counts: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds lambda (``tilt``) to ``sources`` by Newton steps kept inside a bracket that each step narrows.

    A source whose target is its limit gets an infinite tilt; one without words stays at 0.
    """
    start = F.when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), F.lit(float("inf"))).otherwise(F.lit(0.0))
    now, path = scratch.write(
        sources.withColumn("mean", F.col("source_size") / F.col("n_docs")).select(
            "source", "source_size", "n_docs", "target", "mean", F.when(F.col("source_size") == 0, 0.0).otherwise(start).alias("tilt"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(False).alias("done")
        )
    )
    for _ in range(ROUNDS):
        open_ones = now.where("not done and source_size > 0 and tilt < double('Infinity')")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(1.0)))
        taken = F.col("docs") * F.col("size")
        sums = counts.join(open_ones, F.col("from").eqNullSafe(F.col("source"))).groupBy("source").agg(
            F.sum(taken * F.least(rate, F.lit(MOST))).alias("reached"), F.sum(F.when(rate < MOST, taken * rate * x).otherwise(0.0)).alias("slope")
        )
        sums = sums.withColumnRenamed("source", "of")
        joined = now.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        gap = F.col("reached") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > low) & (step < high)
        moved = F.when(F.coalesce(inside, F.lit(False)), step).otherwise((low + high) / 2)
        near = F.abs(gap) <= NEAR * F.col("source_size")
        after, new = scratch.write(
            joined.select(
                "source", "source_size", "n_docs", "target", "mean",
                F.when(F.col("reached").isNull() | near, F.col("tilt")).otherwise(moved).alias("tilt"),
                F.when(F.col("reached").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("reached").isNull(), F.col("high")).otherwise(high).alias("high"),
                (F.col("reached").isNull() | near).alias("done"),
            ).coalesce(1)
        )
        scratch.drop(path)
        now, path = after, new
        if not now.where("not done").head(1):
            break
    return now


def _rounded(groups: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one group, the error carried on: its sum ends within half of its shortest document."""
    rows = groups.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable")
    carried, copies = 0.0, []
    for size, rate in zip(rows["size"].to_numpy(), rows["rate"].to_numpy(), strict=True):
        if size == 0:
            copies.append(1)
            continue
        due = rate * size + carried
        times = min(int(MOST), max(0, int(due / size + 0.5)))
        carried = due - times * size
        copies.append(times)
    rows["copies"] = copies
    return rows[["doc_id", "source", "size", "nth", "source_size", "target", "rate", "copies"]]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, nth, source_size, target, rate, copies, taken for every row of ``docs``.

    A null text has no words; a null source is a source, after all others. Documents without words are taken
    once and count nothing. ``nth`` tells rows apart that agree in doc_id, source and size, in the order of
    their texts' hashes. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), F.xxhash64(text_of()).alias("order"))
    sizes = scratch.keep(sizes.withColumn("nth", nth()))
    counts = scratch.keep(sizes.groupBy(F.col("source").alias("from"), "size").agg(F.count("*").alias("docs")))
    sources = counts.groupBy(F.col("from").alias("source")).agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum("docs").alias("n_docs"))
    solved = tilts(counts, targets(sources), scratch)
    of = solved.select(F.col("source").alias("of"), "source_size", "n_docs", "target", "mean", "tilt")
    rated = sizes.join(of, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("tilt") == float("inf"), F.lit(MOST)).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(1.0))), F.lit(MOST)))
    grouped = rated.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0)).withColumn(
        "part", F.pmod(F.xxhash64(F.col("doc_id"), F.col("order"), F.lit("part")), F.ceil(F.col("n_docs") / GROUP)).cast("long")
    )
    rounded = grouped.groupBy("source", "part").applyInPandas(
        _rounded, "doc_id long, source string, size long, nth int, source_size long, target double, rate double, copies int"
    )
    return rounded.withColumn("taken", F.col("copies") * F.col("size"))


def nth():
    return F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("order"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("k_doc"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("nth").alias("k_nth"), F.col("copies").alias("k_copies"))
    names = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), F.xxhash64(text_of()).alias("order")
    ).withColumn("nth", nth())
    same = (
        F.col("doc_id").eqNullSafe(F.col("k_doc")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("nth") == F.col("k_nth"))
    )
    joined = inner.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("k_copies"))))
    return joined.select("row.*")
