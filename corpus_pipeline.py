"""A corpus pipeline over `documents`: toxicity, near-duplicates, repeated passages, secrets, packing.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spliceatlas.llm import minhash, packing, secret_scan, substring, toxicity
from spliceatlas.llm._store import Scratch
from spliceatlas.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5 go; the others stay as they are."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return minhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that start elsewhere too are cut; texts without such words stay verbatim."""
    return substring.cut_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET]; documents without any stay as they are."""
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned scores, banded signatures and tokenizer merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written result of the one before."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
