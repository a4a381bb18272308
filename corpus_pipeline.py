"""A training corpus from `documents`: language, near duplicates, benchmark passages, mixing, token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontamination, language, mixing, shingle_join, token_output
from tallyframe.llm.common import materialize, table
from tallyframe.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a language, or with one that the model is not sure of, go."""
    return language.keep_identified(docs.select(COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the least document of each group of similar ones stays. Five-word shingles, 0.8 or more."""
    from fractions import Fraction

    return shingle_join.keep_first(docs.select(COLUMNS), k=5, threshold=Fraction(8, 10))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages of benchmark items are cut out of the texts; documents that then have no words go."""
    from pyspark.sql import functions as F

    docs = docs.select(COLUMNS)
    got = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark"), cut=True)
    got = got.filter((F.size("spans") == 0) | F.col("text").rlike(r"[^\x00-\x20]"))
    return got.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the words that the mix takes, a row for each time round of a document."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token records; returns what is read back from the files."""
    return token_output.token_records(docs.select(COLUMNS), tokenizer_path("word_bpe_49k.json")).drop("shard", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]

#: SQL cannot express the classifier, so run() is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
