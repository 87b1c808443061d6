"""From raw documents to token ids, in five stages; each is written as Parquet and read again as the next one's documents.

quality: rows that the classifier rejects go. near_dedup: one row of each class of near-duplicates stays. decontaminate:
rows that hold a benchmark item go. secrets: secrets in texts are replaced by a placeholder, n_chars follows. bpe: texts
are encoded, and decoded from the ids again. Columns other than those the stages are about pass through whatever their
names; the stages' own columns have names that no table has. Null and empty texts are of one class and stay or go as the
classifier says; repeated rows are one document; very long texts are worked on whole; an empty table gives an empty one.
The table between two stages is deleted once the next is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselattice.llm import bpe, decontaminate, near_dedup, quality, secret_scan
from caselattice.llm.names import unused
from caselattice.llm.storage import discard, stored

#: The classifier and the greedy choice of one document a class are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but `keep` under a name of its own, and what turns the names back, in order."""
    names = {c: c if c in keep else f"_held{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda df: df.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held, back = _aside(docs, "text")
    return back(quality.score_quality(held, "text", model).filter("predicted = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, back = _aside(docs, "doc_id", "text")
    return back(near_dedup.keep_one(held))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, back = _aside(docs, "text")
    return back(decontaminate.find_leaks(held, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("leaks") == 0))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, back = _aside(docs, "text", "n_chars")
    clean = secret_scan.redact(secret_scan.find_secrets(held, "text"), "text")
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size("secrets") > 0, counted).otherwise(F.col("n_chars")))
    return back(clean)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, text as decoded from the ids (null texts: empty), and token_ids and n_tokens, which get
    underscores before them where documents has columns of these names."""
    held, back = _aside(docs)
    text = held.columns[docs.columns.index("text")]
    read = bpe.decode_bpe(bpe.encode_bpe(held, text, "token_ids"), "token_ids", "decoded").withColumn(text, F.decode("decoded", "UTF-8"))
    ids, n = unused(docs, "token_ids", "n_tokens")
    return read.select(*[F.col(h).alias(c) for h, c in zip(held.columns, docs.columns, strict=True)], F.col("token_ids").alias(ids), F.size("token_ids").alias(n))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("secrets", hide_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if hasattr(last, "_stored_at"):
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
