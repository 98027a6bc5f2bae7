"""A training corpus in stages: each works on all that its predecessor kept.

toxicity: documents that the classifier rejects go.
line_dedup: repeated and nearly repeated lines go, the first of each stays; no document goes.
minhash_dedup: one document of each group of near duplicates (five-word shingles, similarity 0.8) stays.
mix: documents are taken 0, 1 or 2 times so that their sources meet their target sizes.
bpe: token counts and digests of ids and decoded text, one row for each copy taken.

Every stage reads the columns doc_id, text, lang and source; all but the last carry all others along, whatever their
names, and the last returns what its contract names. A null text is an empty one, a null doc_id or source is a value
of its own; texts are read whole. Rows that share an id are judged by their own texts. An empty table gives an empty
table. Documents without words stay in all stages; of equal rows minhash_dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionlake.llm import bpe, entropy_mix, line_dedup, minmax_dedup, toxicity
from ionlake.llm.common import Scratch, table
from ionlake.llm.queries import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose score reaches the fixed threshold; an empty text has the score of no words."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat an earlier one; null texts stay null, a null id comes first."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike; rows with a null id or without words all stay."""
    return minmax_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row without words once."""
    return entropy_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of ``docs``; an empty text has no tokens."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the training nor the signatures nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
