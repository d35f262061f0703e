"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfare.llm import alignment, audio, html_text, jaccard_join, mixing, order_minhash, packing, pii, prefix_trie, quality_rules, token_counts, token_store, toxicity
from lumenfare.llm.common import prepare, shared_path, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(prepare(spark), sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and scores of a public model read as a unigram vocabulary."""
    return token_counts.count_tokens(table(prepare(spark), sf_dir, "documents"), token_counts.sentencepiece_vocabulary(tokenizer("piece_bpe_32k.model")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(prepare(spark), sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(prepare(spark), sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(prepare(spark), sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(prepare(spark), sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the store in the shared folder and reads it back."""
    path = shared_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_store.read_store(spark, path)


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.align(audio.media_of(table(prepare(spark), sf_dir, "embeddings")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(prepare(spark), sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_next(table(prepare(spark), sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(prepare(spark), sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_toxicity, op4_pii, op5_html, op6_jaccard, op7_quality, op8_mixing, op9_token_store, op10_audio, op11_alignment, op12_order_minhash, op13_prefix_trie)}

#: The others can't be said in SQL: each is held against a brute-force version in tests/llm.
ORACLE_SQL: dict[str, str] = {"op13_prefix_trie": prefix_trie.SQL}
