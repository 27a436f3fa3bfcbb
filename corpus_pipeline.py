"""A corpus pipeline over `documents`: quality, lines, near-duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of `documents`, and extra ones
that came in; the last returns token ids and what they decode to. Whatever the
stage: no rows give no rows, texts of any length are taken whole, and extra
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.

    Null and empty texts have too few words and go. Each row is judged by its text alone, so repeated
    rows stay or go together, and a null id changes nothing. The trees learn from labelled documents of
    docs; without any, only the base rules hold.
    """
    from chunkyard.llm import quality
    from chunkyard.llm.frames import reach, table

    reach(spark)
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest id; n_chars, if it is there, follows the text.

    Null texts stay null, empty ones empty. Rows of one id are one document. Rows without an id lose what
    others have and keep no shared line. Repeated rows lose the same lines. All rows stay.
    """
    from chunkyard.llm import line_dedup
    from chunkyard.llm.frames import reach

    reach(spark)
    kept = line_dedup.keep_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Null and empty texts are linked with nothing and stay; a null id is chosen only in a group without
    another. Of rows that repeat both id and text, one stays.
    """
    from chunkyard.llm import near_dedup
    from chunkyard.llm.frames import reach

    reach(spark)
    return near_dedup.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and empty texts have no words and stay; repeated rows stay or go together. Items without words
    have no window; without items all documents stay.
    """
    from chunkyard.llm import decontaminate
    from chunkyard.llm.frames import reach, table

    reach(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row; null and empty texts have no ids and decode to the empty text."""
    from chunkyard.llm import bpe
    from chunkyard.llm.frames import reach

    reach(spark)
    return bpe.round_trip(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]

#: Boosted trees can't be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkyard.llm.frames import settled, table

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs)
    return docs
