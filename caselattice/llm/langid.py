"""Language identification: averaged hashed subword embeddings, a linear softmax and a calibrated rejection.

Learns from about per_lang documents of every language, picked by a hash of the id; a fifth of them sets the temperature
and the least score from which on a prediction is trusted. Defined results: text that is null or has no letter gets `und`
and score 0; if nothing could be learned, so does every text. `rejected` marks predictions below the trusted score; their
best language is still given. Rows that share an id and a language teach by one text, the least; ties between languages go
to the first by name. Very long texts are read whole. The operator's own columns replace columns of the same names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselattice.llm import subword_model
from caselattice.llm.names import unused
from caselattice.llm.text_kernel import WORD_BYTES, Features

PER_LANG = 800
#: Share of calibration rows that a trusted prediction gets right, at least.
TRUST = 0.99


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo folds, is this fold; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> tuple[subword_model.Model, float]:
    """documents (doc_id, text, lang): the model and the least trusted score."""
    usable = documents.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # A row a language, as many as the model then has classes.
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    features = Features(WORD_BYTES)
    nothing = subword_model.Model([None], features, np.zeros((features.size, 1)), np.zeros(1)), 0.0
    if not counts:
        return nothing
    share = F.map_from_arrays(F.array(*[F.lit(r["lang"]) for r in counts]), F.array(*[F.lit(per_lang / r["n"]) for r in counts]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # One text an id, so that a repeated id does not fill the sample.
    sample = usable.filter(place < F.element_at(share, F.col("lang"))).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    y, docs = subword_model.featurize(sample, "text", "lang", features)
    if not y:
        return nothing
    back = np.arange(len(y)) % 5 == 4
    pick = lambda values, keep: [v for v, k in zip(values, keep, strict=True) if k]
    model = subword_model.learn(pick(y, ~back), pick(docs, ~back), features)
    seen = [i for i in range(len(y)) if back[i] and y[i] in model.classes and len(docs[i][0])]
    subword_model.calibrate(model, [y[i] for i in seen], [docs[i] for i in seen])
    return model, _trusted_from(model, [y[i] for i in seen], [docs[i] for i in seen])


def _trusted_from(model: subword_model.Model, labels: list, docs: list) -> float:
    """The least score such that the calibration rows from it on are right in TRUST of the cases."""
    if not labels:
        return 0.0
    z = np.stack([n @ model.scores[i] / n.sum() for i, n in docs]) + model.bias
    p = subword_model.softmax(z * model.temperature)
    right = np.array([model.classes[k] == y for k, y in zip(p.argmax(1), labels, strict=True)])
    order = np.argsort(-p.max(1))
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TRUST)
    return float(p.max(1)[order][good[-1]]) if len(good) else 1.0


def predict_language(df: DataFrame, text: str, model: subword_model.Model, trusted: float = 0.0) -> DataFrame:
    """Appends lang_pred, score and rejected."""
    columns = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def answer(p: np.ndarray) -> list[pa.Array]:
        best = p.argmax(1)
        return [pa.array([model.classes[k] for k in best], pa.string()), pa.array(p.max(1)), pa.array(p.max(1) < trusted)]

    if model.classes == [None]:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    letters = F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))
    (lettered,) = unused(df, "_letters")
    marked = subword_model.score(df.withColumn(lettered, letters), text, model, columns, answer)
    known = F.col(lettered)
    return marked.withColumns({"lang_pred": F.when(known, F.col("lang_pred")).otherwise("und"), "score": F.when(known, F.col("score")).otherwise(0.0), "rejected": ~known | F.col("rejected")}).drop(lettered)
