"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes the documents that its predecessor kept, written and read again; all but
the last return the columns of documents, extra ones with them. No documents give none.
Nulls, empty texts and repeated rows are treated as the stages' functions say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterloom.llm import base, lines, minhash, mixing, packing, perplexity

NEAR_PERCENT = 80  # shared five-word shingles of two near-duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and their language's perplexity bands. Null and empty texts fail; null languages are one of their own; repeated rows pass alike."""
    return perplexity.passed(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier one has, or nearly has; n_chars follows the text. Of equals the first by doc_id and line stays, null ids last; null texts have no lines and stay."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; repeated rows of it stay. Texts without words and rows without an id stay."""
    return minhash.deduplicated(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time. Null sources are one of their own; texts without words aren't part of the words that are shared out."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
#: Hashed seeds, a language model and tokenizer ids are beyond SQL. Tests compare line_dedup and near_dedup with brute force
#: in place, and the functions that quality, mix and pack call on small tables of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = base.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
