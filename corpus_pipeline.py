"""A pipeline over the documents table; each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, langid, ngram_join, pii
from tessella.llm.common import read
from tessella.storage import scratch

#: A text is rejected where less than this share of its n-grams is known from the learned languages, however many these are.
MIN_KNOWN = 0.1
#: Bytes of encoded stretches that a worker keeps in a generation: fewer than by default, as executors have served four stages by then.
KEPT_BYTES = 24_000_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: null, blank and letterless texts, and those that no learned language claims. The rest stays,
    and lang becomes the predicted language, which goes with each document to the end."""
    labelled = docs.where(~langid.held_out())
    return langid.reject_unidentified(docs, langid.train(labelled), MIN_KNOWN, lang_col="lang")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked at a Jaccard similarity of 0.8 the one with the smallest id stays, and once
    if its row is repeated."""
    found = ngram_join.ngram_jaccard_join(docs)
    extra = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; all documents stay, n_chars follows the text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, and the identified language."""
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), stretch_bytes=KEPT_BYTES, carried=("lang",)))


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
