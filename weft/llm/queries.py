"""The numbered queries: each applies its operator to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import credentials, embedding_dedup, host_rules, jaccard_join, langid, line_dedup, merkle, mixing, packing, substring_dedup, token_files, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_host_rules(spark, sf_dir):
    return host_rules.judge(documents(spark, sf_dir))


@query
def op7_harmonic_packing(spark, sf_dir):
    p = packing.pack(documents(spark, sf_dir), "byte_bpe_50k.json")
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_credential_links(spark, sf_dir):
    s = credentials.scan(documents(spark, sf_dir))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(credentials.span_text(F.col("base")), 256).alias("base_sha256"),
                    credentials.span_text(F.sort_array(F.concat("base", "linked"))).alias("spans"))


@query
def op9_token_files(spark, sf_dir):
    return token_files.token_files(documents(spark, sf_dir), "word_bpe_49k.json")


@query
def op10_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op3_substring_dedup(spark, sf_dir):
    d = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.join_groups(documents(spark, sf_dir))


@query
def op5_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


@query
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return merkle.fold(merkle.manifest(docs, merkle.tampered(docs)))


@query
def op13_warc_pages(spark, sf_dir):
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("digest_ok")


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
