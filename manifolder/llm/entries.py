"""One query for each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.llm import lm_score, media, mixing, packing, simhash, sql, token_store, topk, toxicity, url_rules, warc
from manifolder.llm.runtime import read_table

TOKENIZER = "byte_bpe_50k.json"


RULES = [
    url_rules.Rule("com/en/", "block"),
    url_rules.Rule("example.com/en/7", "allow"),
    url_rules.Rule("net/de/", "allow"),
    url_rules.Rule("example.net/de/8", "block"),
    url_rules.Rule("org/es/", "block"),
]


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.stupid_backoff(spark, read_table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.stored_tokens(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(spark, read_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(spark, read_table(spark, sf_dir, "pages"), RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(spark, read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mixing aims at: the part of op7_mixing that SQL can express, over all documents."""
    sizes = mixing.document_sizes(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    targets = mixing.source_targets(sizes).withColumnRenamed("source", "of")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_to_media(read_table(spark, sf_dir, "documents")))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, read_table(spark, sf_dir, "embeddings"), every=50)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALL = (
    op1_stupid_backoff, op2_token_store, op3_simhash, op4_url_rules, op5_toxicity, op6_best_fit_packing, op7_mixing, op8_media,
    op9_top_k, op10_warc, mixing_targets,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The others need hashes, tokenizers, trained models or media codecs that SQL lacks; op7 solves and rounds step by step.
SQL = {
    "op1_stupid_backoff": sql.STUPID_BACKOFF,
    "op4_url_rules": sql.URL_RULES,
    "op9_top_k": sql.TOP_K,
    "op10_warc": sql.WARC,
    "mixing_targets": sql.MIXING_TARGETS,
}
