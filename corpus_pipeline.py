"""A training corpus from the table documents: language ID, near-duplicate removal, removal of repeated passages,
mixing of sources, tokens. Each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, langid, mixing, ngram_join, substring
from pulsegrid.llm.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or with a narrow margin go."""
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, dictionaries, keep=tuple(docs.columns), prefix="__lid_")
    return found.where("NOT __lid_rejected").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that one of a smaller id has; those of which nothing is left go. n_chars, where there is such a column, follows the text."""
    found = substring.remove(docs, window=13, prefix="__sub_")
    found = found.where("__sub_n_removed < __sub_n_words OR __sub_n_words = 0")
    if "n_chars" in docs.columns:
        own = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("__sub_n_removed") > 0, own).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text that they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can't express language ID by compression; tests hold each stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
