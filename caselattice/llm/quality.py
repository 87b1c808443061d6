"""Quality classifier: supervised subword embeddings over case and punctuation as they stand.

Learns from at most 2 * per_class labelled documents, those of the smallest hashes of their ids in each class, so that the
sample does not change with partitioning; the classes' true shares then correct the score. Defined results: null and
empty texts get the score of the classes' shares; without labels of both classes every text gets the share of label 1
(0.5 without any). Rows of labels that name no document or hold a null teach nothing and are in no share, nor is an id that
is labelled both ways. Documents that share an id teach by one text, the least. A score of just the threshold is predicted
1. Very long texts are read whole. The operator's own columns replace columns of the same names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselattice.llm import subword_model
from caselattice.llm.text_kernel import PRINT_BYTES, Features

PER_CLASS = 1500
THRESHOLD = 0.3


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text, modulo folds, is this fold; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> subword_model.Model:
    """documents (doc_id, text), labels (doc_id, quality): a model whose classes are 0 and 1."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    agreed = named.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("most")).filter("quality = most").drop("most")
    usable = agreed.join(documents.select("doc_id"), "doc_id", "left_semi")
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picks = [usable.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # Broadcast: at most 2 * per_class ids.
    sample = documents.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    y, docs = subword_model.featurize(sample, "text", "quality", Features(PRINT_BYTES))
    model = subword_model.learn(y, docs, Features(PRINT_BYTES))
    if model.classes != [0, 1]:
        p = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
        p = min(max(p, 0.01), 0.99)
        return subword_model.Model([0, 1], model.features, np.zeros((model.features.size, 2)), np.log([1 - p, p]))
    fair = np.array([y.count(c) / len(y) for c in (0, 1)])
    true = np.array([shares[c] / sum(shares.values()) for c in (0, 1)])
    model.bias = model.bias + np.log(true / fair)
    return model


def score_quality(df: DataFrame, text: str, model: subword_model.Model, threshold: float = THRESHOLD) -> DataFrame:
    """Appends score (probability of label 1) and predicted (1 from the threshold on)."""
    columns = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return subword_model.score(df, text, model, columns, lambda p: [pa.array(p[:, 1]), pa.array((p[:, 1] >= threshold).astype(np.int32))])
