"""A corpus, cleaned in five stages. Each is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next.

All stages but the last return the columns of documents. Null and empty texts
pass the first four; an empty table passes all; further columns are kept, with
their names; repeated rows share their document's fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm import bpe_text, decontaminate, repeats, simhash, toxicity
from quiverlake.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.3 or more; learns from the labelled rows that aren't held out, of the documents it gets."""
    return toxicity.keep_civil(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts linked by equal words or a verified similarity of 0.8 or more on five-word shingles."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out of texts that a document with a smaller doc_id has in 13 words' sequence; n_chars follows, and documents of repeats alone go."""
    return repeats.without_repeats(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, whole or edited, by an alignment of half its perfect score or more."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text that is left."""
    return bpe_text.bpe_digests(docs, bpe_text.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_copies),
    ("bpe", encode),
]

#: A classifier, fingerprints and subword merges aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
