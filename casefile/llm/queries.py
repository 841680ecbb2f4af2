"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casefile.llm import balltree, html_template, huffman, language_id, matroska, merkle, mixing, pii, prefix_trie, sentencepiece_bpe, simhash, substring_dedup, url_graph
from casefile.session import ship

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
BYTES_IDS = 50_257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out("doc_id")
    model = language_id.fit(docs.filter(~out))
    predicted = language_id.identify_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.sentencepiece_digest(table(spark, sf_dir, "documents"), PIECES)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.matroska_digest(table(spark, sf_dir, "documents"))


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(table(spark, sf_dir, "pages"))


def op6_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op7_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.integer_vectors(table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.huffman_token_files(table(spark, sf_dir, "documents"), BYTES, BYTES_IDS)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_sentencepiece, op4_matroska, op5_html_template, op6_url_graph, op7_balltree, op8_huffman, op9_simhash, op10_mixing, op11_pii, op12_merkle, op13_prefix_trie)}
