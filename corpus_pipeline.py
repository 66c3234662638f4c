"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept and returns documents of the same columns; the last
returns the packed pieces. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetskein.llm import minhash_oph, quality_lines, registry, retrieval_packing, secrets_crf, sentence_spans
from fleetskein.session import discard, passing, written


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that no result's name can clash with theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Back to the columns of ``like``; n_chars follows the text where there is such a column."""
    size = F.length("text").cast(like.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in like.columns else None
    own = lambda c: F.col(c) if c in ("doc_id", "text") else size if c == "n_chars" else F.col("_rest")[c].alias(c)
    return docs.select(*map(own, like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the rules or lose too much text. Null and empty texts fail."""
    # Stored before it is filtered, so that no text is measured a second time for the filter.
    found = written(quality_lines.clean_lines(_apart(docs)).select("doc_id", "_rest", "kept", "cleaned"), "lines")
    return _with_text(found.where("kept").withColumn("text", F.col("cleaned")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; of equal rows one."""
    with passing():
        rows = minhash_oph.near_duplicates(docs).groupBy("doc_id").agg(F.count_if("kept").alias("_times"))
        # Ids that go are fewer than those that stay; each list is written, so that its real size decides how it is joined.
        rows = written(rows.where("_times <> 1").select(F.col("doc_id").alias("_id"), "_times"), "decided", keep=True)
    several = written(rows.where("_times > 1"), "several")
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["_id"])
    once = docs.join(rows, same(rows), "left_anti")
    return once.unionByName(docs.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences go; a document that had nothing else goes with them."""
    cut = sentence_spans.remove_repeats(_apart(docs))
    return _with_text(cut.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; all documents stay."""
    return _with_text(secrets_crf.redacted(secrets_crf.scan(_apart(docs), secrets_crf.learn(docs))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return retrieval_packing.pack(docs, registry.vocabulary("byte_bpe_50k.tiktoken"), registry.PATTERN, special=registry.SPECIAL)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express MinHash, the trained field or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing():
            done = written(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
