"""Links within hash buckets, found without expanding a bucket into pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch
from ionlake.llm.graph import components

#: Members of a bucket whose pairs are compared at once.
SMALL = 8
#: Pairs that comparing in full may form, as a multiple of the rows in buckets; beyond, another centre is tried
#: first, as long as the last one left no more than this share of the pairs before it.
FULL, WORTH = 0.5, 0.8
#: The same multiple where the members carry what tells which pairs can be links: ruling a pair out is then a few instructions.
FULL_CARRIED = 64


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (bucket, id, ...) whose bucket holds more than one, with the number that it holds."""
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(shared, "bucket")


def _alike(percent: int, sketched: int):
    """Whether sets a and b can be alike enough by their sizes n and, if ``sketched``, their parity sketches of so many 64-bit words.

    An element flips one bit of its set's sketch, so two sets differ in at least as many elements as their
    sketches do in bits; alike ones differ in at most (100 - percent) / (100 + percent) of both sizes' sum.
    """
    fits = (F.col("a") != F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    if not sketched:
        return fits
    apart = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(sketched)), F.lit(0))
    return fits & (apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _crossing(placed: DataFrame) -> float:
    """Pairs in one bucket and different components, counted from the components' sizes."""
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").cast("double").alias("n"))
    crossed = sizes.groupBy("bucket").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("c"))
    return crossed.agg(F.sum("c")).first()[0] or 0.0


def fields_apart(words: list[str]) -> Column:
    """In how many fields of two bits the sides' columns of these names (longs, with _a and _b behind them) differ."""
    odd = [F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b")) for w in words]
    return sum((F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in odd), F.lit(0))


def _stars(placed: DataFrame, carried: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pairs of each bucket's members with its centre, and the (bucket, id) of the centres."""
    centre = placed.groupBy("bucket").agg(F.max(F.struct("degree", F.xxhash64("id", "bucket").alias("order"), "id", *carried, "part")).alias("c"))
    centre = scratch.keep(centre)
    sides = [F.col("id").alias("a"), F.col("c.id").alias("b"), *[F.col(f"{at}{c}").alias(f"{c}_{x}") for c in carried for at, x in (("", "a"), ("c.", "b"))]]
    return placed.join(centre, "bucket").where("id <> c.id and part <> c.part").select(*sides), centre.select("bucket", F.col("c.id").alias("id"))


def linked_components(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    percent: int,
    sketches: Callable[[DataFrame], DataFrame] | None = None,
    words: int = 0,
    carried: tuple[str, ...] = ("n",),
    alike: Column | None = None,
) -> DataFrame | None:
    """(node, component) of all nodes that have a confirmed link to a member of one of their buckets.

    ``members`` has (bucket, id, n, members), n the size of the id's set and members that of the bucket;
    ``sketches`` gives (id, sketch), parity sketches of ``words`` longs, for a table of ids, and is asked only for
    ids that are compared in full; ``confirm`` keeps the pairs (u, v) that are links. In place of sizes and sketches
    members may have the columns ``carried``, and ``alike`` tells by both sides', with _a and _b behind their names, whether a pair
    can be a link: it is part of every join, so that none forms a pair that it rules out. A round compares each bucket's members with one centre,
    the one that meets most others over all its buckets (the text that the copies were made from, say), unless
    they are in the centre's component by then. When the pairs that stay in different components of one bucket
    are few enough, or another centre would not help, they are compared in full, and that is the end. A centre
    that was compared with all its bucket leaves it. The pairs of buckets of up to SMALL members come before all
    rounds, which work on the larger ones alone (with ``alike`` they are confirmed together with the first round's). Pairs whose set sizes or sketches rule the threshold out
    are not formed; none is confirmed twice.
    """
    kind = members.schema["id"].dataType.simpleString()
    none = members.sparkSession.createDataFrame([], f"u {kind}, v {kind}")
    fits = lambda full: _alike(percent, words * full) if alike is None else alike
    small = members.where(F.col("members") <= SMALL)
    one, other = (small.select("bucket", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in carried]) for x in "ab")
    pairs = one.join(other, "bucket").where("a < b").where(fits(False)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    members = members.where(F.col("members") > SMALL)
    degrees = members.groupBy("id").agg(F.sum("members").alias("degree"))
    members = scratch.keep(members.drop("members").join(degrees, "id"))
    spent, rows, last, before = None, members.count(), False, float("inf")
    if rows and alike is not None:  # the first centres' pairs are confirmed together with those of the small buckets
        meets, spent = _stars(members.withColumn("part", F.col("id")), carried, scratch)
        pairs = pairs.union(meets.where(alike).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()
    tried, found = scratch.keep(pairs), None
    if tried.head(1):
        found = scratch.keep(components(scratch.keep(confirm(tried)), scratch))
    else:
        tried = none
    while rows and not last:
        if spent is not None:
            members = members.join(spent, ["bucket", "id"], "left_anti")
        placed = members.withColumn("part", F.col("id"))
        if found is not None:
            placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        if found is not None or spent is not None:
            several = placed.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket")
            placed = scratch.keep(placed.join(several, "bucket"))
            #: What is one component stays one, so later rounds need no more than these.
            members, crossing = placed.drop("part"), _crossing(placed)
            if not crossing:
                break
            last, before = crossing <= (FULL if alike is None else FULL_CARRIED) * rows or crossing > WORTH * before, crossing
        if last:
            more = [*carried, "part"]
            if sketches:
                placed, more = placed.join(scratch.keep(sketches(placed.select("id").distinct())), "id"), [*more, "sketch"]
            one, other = (placed.select("bucket", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more]) for x in "ab")
            meets = one.join(other, "bucket").where("part_a < part_b")
        else:
            meets, spent = _stars(placed, carried, scratch)
        pairs = meets.where(fits(last)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        fresh = scratch.keep(pairs.join(tried, ["u", "v"], "left_anti"))
        if fresh.head(1):
            linked, tried = scratch.keep(confirm(fresh)), tried.union(fresh)
            links = linked if found is None else found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(linked)
            found = scratch.keep(components(links, scratch))
        scratch.release()
    return found
