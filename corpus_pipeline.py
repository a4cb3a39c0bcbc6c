"""From raw documents to token ids: language, repeated lines, near duplicates, source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.llm import bpe, langid, linededup, mix, neardup
from mlframe.llm.common import documents, small_batches
from mlframe.llm.queries import tokenizer_file
from mlframe.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go."""
    small_batches(spark)
    samples = langid.labelled_sample(docs, F.lit(True))
    found = langid.identify(docs, samples)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, to their true ends, from all documents but the first."""
    out = linededup.dedup_runs(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    small_batches(spark)
    return neardup.first_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources draw them."""
    return mix.mixed(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of the text decoded from them."""
    small_batches(spark)
    back = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_file(), decoded=True)
    return back.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Automata, darts and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
