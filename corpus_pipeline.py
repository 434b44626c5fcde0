"""The corpus pipeline: documents in, token ids in training order out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import exact_dedup, mixing, order_minhash, sentencepiece_tok, toxicity
from tidewell.llm.queries import MIX_BLOCK, MIX_WEIGHTS, TOKENIZER
from tidewell.llm.shared import new_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact copies one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one stays."""
    return order_minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix, column mix_pos."""
    return mixing.mixed(docs, MIX_WEIGHTS, block=MIX_BLOCK)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids: doc_id, source, mix_pos (where the mix has run), ids, n_tokens, round_trip. Other columns, lang and n_chars among them, end here."""
    keep = ("doc_id", "source", *(c for c in ("mix_pos",) if c in docs.columns))
    return sentencepiece_tok.tokenised(docs, sentencepiece_tok.load_model(TOKENIZER), keep=keep).select("row.*", "ids", "n_tokens", "round_trip")


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("sentencepiece", encode)]

#: A trained classifier, minimum hashes and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
