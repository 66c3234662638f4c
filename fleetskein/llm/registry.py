"""The package's registered queries and their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetskein.llm import bpe_duckdb, collocations, katz, langid, lexical_search, license_scan, minhash_oph, perspectives, quality_lines, retrieval_packing, secrets_crf, sentence_spans, topk_svd

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that cuts texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: the special token of the 50k byte vocabulary.
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.dialogues(table(spark, folder, "conversations"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_texts(table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_crf.digest(table(spark, folder, "documents"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_duckdb.digests(vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN, table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"), PATTERN, special=SPECIAL)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_oph.near_duplicates(table(spark, folder, "documents"), shingle=4)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    cut = sentence_spans.remove_repeats(table(spark, folder, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return cut.select("doc_id", "n_sentences", "n_removed", F.array_join(spans, ",").alias("removed"), "text")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return topk_svd.top_k(table(spark, folder, "embeddings"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    kept = quality_lines.clean_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(table(spark, folder, "documents"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perspectives": op1,
    "op2_katz": op2,
    "op3_secrets": op3,
    "op4_bpe": op4,
    "op5_langid": op5,
    "op6_packing": op6,
    "op7_minhash": op7,
    "op8_sentence_spans": op8,
    "op9_topk": op9,
    "op10_quality_lines": op10,
    "op11_collocations": op11,
    "op12_license_scan": op12,
    "op13_lexical_search": op13,
}
STATEMENTS: dict[str, str] = {
    "op1_perspectives": perspectives.SQL,
    "op9_topk": topk_svd.SQL,
    "op11_collocations": collocations.SQL,
    "op12_license_scan": license_scan.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
