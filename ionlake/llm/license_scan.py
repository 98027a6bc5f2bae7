"""Licence scans in DataFrame expressions: TF-IDF cosine to templates, then inheritance down directories.

A file's statement is one of its pieces that hold a word of licences: a line's or paragraph's sentence, a paragraph,
or the whole text. Pieces and templates (names in common phrases, headers, whole licence texts) are sparse vectors of
tf * idf, with the frequencies of all files and templates; they are joined by term, and cosines divide by the full
norms of both sides. A file takes its nearest template, or the licence that an SPDX tag names. A file without a
statement of its own inherits from the licence file of its nearest ancestor directory, found by joining each directory
with those above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, text_of
from ionlake.llm.license_texts import NAMES, all_templates

#: A piece with one of these may be a statement.
MARKS = r"(?i)licen[cs]|copyright|all rights reserved|public domain|permission is hereby granted|permission to use|redistribution and use|creative commons|cc by|cc0|reproduced without|unauthorized copying|free software"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"
#: From one end mark that white space follows to the next; a dot inside a number or name ends nothing.
SENTENCE = r"[^.!?]+(?:[.!?]+[^.!? \t\r\n][^.!?]*)*[.!?]*"
TERM = r"\p{L}+[0-9]*|[0-9]+(?:\.[0-9]+)*"
LEAST = 0.6
#: Share of a text in marked sentences from which the text as a whole is a licence file.
COVERED = 0.5


def terms(text: Column) -> Column:
    """Lower-case words and numbers, a version's parts kept together."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, text): a fixed list."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(all_templates())], "template int, license string, text string")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def pieces(text: Column) -> Column:
    """The text, its paragraphs, and the sentences of its lines and paragraphs, as far as they hold a mark."""
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    every = F.concat(F.array(text), paragraphs, F.flatten(F.transform(F.split(text, "\n"), sentences)), F.flatten(F.transform(paragraphs, sentences)))
    return F.array_distinct(F.filter(every, lambda x: x.rlike(MARKS)))


def idf(df: Column, total: Column) -> Column:
    return F.log((1 + total) / (1 + df)) + 1


def detected(files: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """(path, license, score) of the files with a piece whose cosine with a template is ``least`` or more.

    tf is 1 + ln(count). The best piece counts, of equal scores the first identifier; an SPDX tag has score 1. The
    templates and their terms are a fixed list, hence broadcast.
    """
    spark = files.sparkSession
    given = templates(spark)
    texts = files.select("text").union(given.select("text"))
    total = files.count() + given.count()
    counted = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    #: Only texts with a mark are cut; a piece that many files hold is scored once, known by two hashes.
    cut = files.where(F.col("text").rlike(MARKS)).select("path", F.explode(pieces(F.col("text"))).alias("piece")).where("piece <> ''")
    marked = scratch.keep(cut.select("path", F.xxhash64("piece").alias("p1"), F.xxhash64(F.lit(1), "piece").alias("p2"), "piece"))
    tf = (1 + F.log(F.count("*"))).alias("tf")
    once = marked.groupBy("p1", "p2").agg(F.first("piece").alias("piece"))
    held = once.select("p1", "p2", F.explode(terms(F.col("piece"))).alias("term")).groupBy("p1", "p2", "term").agg(tf)
    held = scratch.keep(held)
    known = given.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(tf)
    wanted = held.select("term").union(known.select("term")).distinct()
    weights = scratch.keep(wanted.join(counted, "term").select("term", idf(F.col("df"), F.lit(total)).alias("idf")))
    w = (F.col("tf") * F.col("idf")).alias("w")
    near = scratch.keep(known.join(weights, "term").select("template", "license", "term", w))
    norms = near.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    units = near.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("unit"))
    weighed = scratch.keep(held.join(weights, "term").select("p1", "p2", "term", w))
    sizes = weighed.groupBy("p1", "p2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(F.broadcast(units), "term").groupBy("p1", "p2", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    near = dots.join(sizes, ["p1", "p2"]).select("p1", "p2", "license", F.round(F.col("dot") / F.col("size"), 6).alias("score")).where(F.col("score") >= least)
    top = near.groupBy("p1", "p2").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("b"))
    scored = marked.select("path", "p1", "p2").join(top, ["p1", "p2"]).select("path", F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"))
    tag = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    tags = files.where(F.col("text").contains("SPDX-License-Identifier:")).select("path", tag.alias("license"), F.lit(1.0).alias("score"))
    named = F.regexp_replace("license", "-(only|or-later)$", "")
    tags = tags.select("path", F.when(named.isin(list(NAMES)), named).otherwise(F.col("license")).alias("license"), "score")
    best = scored.union(tags).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and those above it, the root '' last, with their depths."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """file_id, path, license, score, origin ('header', 'inherited' or 'none') and from_path for every row.

    ``files`` has (file_id, path, text, is_license). A file's own statement wins; otherwise the licence file in
    its folder or the nearest one above, of several in one folder the one with the best score, then the least
    path. Null texts are empty, null paths are files of the root that no one else can point to. Rows that share
    a path share its best statement. Texts are read as a whole, whatever their length, and other columns not at all. Only distinct folders are joined with the folders above them, so a folder with a
    third of all files is one row there.
    """
    scratch = Scratch(files.sparkSession, "licences")
    slim = scratch.keep(files.select("file_id", F.col("path").cast("string").alias("path"), F.coalesce("is_license", F.lit(False)).alias("is_license")))
    own = scratch.keep(detected(files.select(F.col("path").cast("string").alias("path"), text_of().alias("text")).where("path is not null"), scratch, least))
    named = slim.where("is_license and path is not null").select("path").distinct().join(own, "path")
    givers = named.groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("score")).alias("order"), F.col("path").alias("from_path"), "license")).alias("g"))
    folders = slim.select(directory(F.coalesce("path", F.lit(""))).alias("folder")).distinct()
    reach = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.depth", "a.above")
    nearest = reach.join(givers, "above").groupBy("folder").agg(F.max(F.struct("depth", "g")).alias("n")).select("folder", F.col("n.g").alias("g"))
    rows = slim.withColumn("folder", directory(F.coalesce("path", F.lit("")))).join(own, "path", "left").join(nearest, "folder", "left")
    has, lent = F.col("license").isNotNull(), F.col("g").isNotNull()
    return rows.select(
        "file_id",
        "path",
        F.coalesce("license", "g.license").alias("license"),
        F.coalesce("score", -F.col("g.order")).alias("score"),
        F.when(has, "header").when(lent, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("g.from_path")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree source/language/thousand of ids.

    A document whose text consists for COVERED or more of marked sentences is a licence file. By its digest it stands
    in the folder of its thousand, of its language, or of its source. A file's name has its id and its text's digest,
    so rows with a null or repeated id are files of their own as long as their texts differ.
    """
    text = text_of()
    covered = F.aggregate(F.filter(sentences(text), lambda x: x.rlike(MARKS)), F.lit(0), lambda n, x: n + F.length(x))
    licence = F.when(text.rlike(MARKS), covered >= COVERED * F.length(text)).otherwise(False)
    parts = [F.coalesce(F.col("source"), F.lit("unknown")), F.coalesce(F.col("lang"), F.lit("unknown")), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("unknown"))]
    depth = F.when(F.col("is_license"), F.ascii("hash") % 3 + 1).otherwise(3)
    folder = F.when(depth == 3, F.concat_ws("/", *parts)).when(depth == 2, F.concat_ws("/", *parts[:2])).otherwise(parts[0])
    name = F.concat_ws("-", F.when(F.col("is_license"), F.lit("LICENSE")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.md5(text).alias("hash"), licence.alias("is_license"))
    return rows.select(F.col("doc_id").alias("file_id"), F.concat(folder, F.lit("/"), name, F.lit(".txt")).alias("path"), "text", "is_license")
