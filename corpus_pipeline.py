"""Corpus pipeline: language, exact copies, near copies, mixture, token ids; each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.base import fold, prepare, table
from ridelens.llm.exact_dedup import drop_duplicates
from ridelens.llm.jaccard_join import jaccard_components
from ridelens.llm.language_id import fit_language_id, identify
from ridelens.llm.mixing import WEIGHTS, mix, quality_domains
from ridelens.llm.piece_codec import encode

BROADCAST_ROWS = 400_000  # lists of ids are broadcast up to this number of rows, joined beyond


def _few(ids: DataFrame) -> DataFrame:
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go: no letter, or a calibrated score below the bound."""
    prepare(spark)
    model = fit_language_id(docs, fold("doc_id") != 0)
    whole = docs.select("text", F.struct("*").alias("__doc"))
    return identify(whole, model, carry=("__doc",)).where("accepted").select("__doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    prepare(spark)
    return drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8), the one with the smallest id."""
    prepare(spark)
    found = jaccard_components(docs, n=5, percent=80)
    gone = _few(found.where("component_id <> doc_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept at their fitted rates: nothing is repeated, every good document stays, and of what is kept junk
    and toxic text have their shares of the weights at most, as far as the good documents allow."""
    prepare(spark)
    rates = mix(docs, quality_domains(table(spark, sf_dir, "labels")), WEIGHTS, most=1.0)
    gone = _few(rates.where("copies < 1").select("doc_id"))
    return docs.join(gone, F.expr("true") & docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their digest and that of the decoded text."""
    import public_tokenizers

    prepare(spark)
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result goes to the shared folder as Parquet and is read again."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
