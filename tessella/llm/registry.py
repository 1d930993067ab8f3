"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tessella.llm.bpe import digests, encode_documents
from tessella.llm.common import among, id_filter, read
from tessella.llm.decontaminate import contaminated
from tessella.llm.langid import language_id
from tessella.llm.licences import licence_scan
from tessella.llm.ngram_join import ngram_jaccard_join
from tessella.llm import oracles, suffix_dedup, topk
from tessella.llm.pii import pii
from tessella.llm.token_counts import Ledger, count_tokens
from tessella.llm.topk import exact_top_k
from tessella.llm.training_order import training_order
from tessella.storage import scratch

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_licence_scan(spark, sf_dir):
    """The documents as files of a tree source/lang/doc_id."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licence_scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op2_bpe_chunk_reuse(spark, sf_dir):
    return digests(encode_documents(read(spark, sf_dir, "documents"), WORD_BPE))


def op3_no_random_access_top_k(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op4_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.repeated_spans(read(spark, sf_dir, "documents")))


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(read(spark, sf_dir, "documents"))


def _labelled_totals(spark, sf_dir, ranks_path, versions):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ledger = Ledger(spark, scratch(spark, "ledger"))
    label = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic = 1 OR quality = 0")
    inserts = count_tokens(docs, ranks_path).withColumn("op", F.lit("insert"))
    ledger.apply("insert-all", inserts)
    every = F.explode(F.array(*(F.lit(v) for v in versions))).alias("tokenizer_version")
    gone = ledger.documents(label.where("toxic = 1").select("doc_id", every)).select(
        "doc_id", "source", "lang", "tokenizer_version", F.col("tokens").alias("n_tokens"), F.lit("delete").alias("op"))
    poor = label.where("toxic = 0").select("doc_id")
    tidied = among(docs, id_filter(poor.select(F.col("doc_id").alias("id")))).withColumn("text", F.trim(F.regexp_replace("text", r"[ \t\n]+", " ")))
    revised = count_tokens(tidied, ranks_path).join(poor, "doc_id", "left_semi").withColumn("op", F.lit("revise"))
    ledger.apply("labels", gone.unionByName(revised))
    ledger.apply("insert-all", inserts)
    return ledger.totals()


def op6_delta_token_counts(spark, sf_dir):
    """All documents are inserted; then those labelled as toxic are deleted and those labelled as poor are revised to the count of their
    text without runs of white space; the first batch is sent once more, which changes nothing."""
    return _labelled_totals(spark, sf_dir, BYTE_RANKS, ("byte_bpe_50k", "words_v1"))


def token_counts_words(spark, sf_dir):
    """The job of op6_delta_token_counts with the one tokenizer version that SQL can express."""
    return _labelled_totals(spark, sf_dir, None, ("words_v1",))


def op7_greedy_tiling_decontamination(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_weak_supervision_pii(spark, sf_dir):
    return pii(read(spark, sf_dir, "documents"))


def op9_string_kernel_langid(spark, sf_dir):
    return language_id(read(spark, sf_dir, "documents"))


def op10_feistel_training_order(spark, sf_dir):
    """The shards are written to the shared folder; the rows are read from them."""
    return training_order(read(spark, sf_dir, "documents"), BYTE_RANKS, scratch(spark, "shards"))


def pii_base_counts(spark, sf_dir):
    """The columns of op8_weak_supervision_pii that SQL can express."""
    return op8_weak_supervision_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def language_fixed_parts(spark, sf_dir):
    """What SQL can express of op9_string_kernel_langid: which documents are held out, and which have no language."""
    return op9_string_kernel_langid(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_bpe_chunk_reuse, op3_no_random_access_top_k, op4_suffix_array_dedup, op5_ngram_jaccard_join, op6_delta_token_counts, op7_greedy_tiling_decontamination, op8_weak_supervision_pii, op9_string_kernel_langid, op10_feistel_training_order, token_counts_words, pii_base_counts, language_fixed_parts)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
ORACLE |= {
    "op3_no_random_access_top_k": topk.ORACLE, "op5_ngram_jaccard_join": oracles.JACCARD, "token_counts_words": oracles.WORDS_V1,
    "pii_base_counts": oracles.PII_COUNTS, "language_fixed_parts": oracles.LANGUAGE_PARTS,
}
