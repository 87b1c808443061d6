"""Averaged hashed subword embeddings with a softmax on top, learned by stochastic gradient descent in numpy.

A text's vector is the mean of the learned vectors of its hashed words and byte n-grams; a linear softmax over it gives
the classes. Once learned, embedding and output are multiplied into one table of scores a feature, which says the same:
the mean of products is the product of the mean. The features of the training sample are computed on the executors;
only their buckets and counts come to the driver, at most `rows of the sample * buckets`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caselattice.llm.text_kernel import Features, as_bytes

#: Rows of an Arrow batch that is turned into Python objects at once.
_STEP = 256


@dataclass
class Model:
    """Scores a text as softmax(temperature * (mean feature score + bias))."""

    classes: list
    features: Features
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        total, count = self.features.sums(texts, self.scores)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) * self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def featurize(sample: DataFrame, text: str, label: str, features: Features) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and (buckets, counts) of a bounded sample, ordered by content: the result depends on the rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                found = [features.counts(x) for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())],
                    names=["label", "ids", "counts"],
                )

    schema = T.StructType([T.StructField("label", sample.schema[label].dataType), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    rows = sorted(((r["label"], bytes(r["ids"]), bytes(r["counts"])) for r in sample.select(label, text).mapInArrow(run, schema).collect()), key=lambda r: (r[1], r[2], str(r[0])))
    return [r[0] for r in rows], [(np.frombuffer(i, np.uint32), np.frombuffer(n, np.float32)) for _, i, n in rows]


def learn(labels: list, docs: list, features: Features, dim: int = 16, steps: int = 12000, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits a model in about `steps` steps, whole passes over the examples; with fewer than two classes it is a constant."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dim, 1 / dim, (features.size, dim)).astype(np.float32)
    output, bias = np.zeros((max(1, len(classes)), dim), np.float32), np.zeros(max(1, len(classes)), np.float32)
    which = np.array([classes.index(x) for x in labels], int)
    epochs = -(-steps // max(1, len(labels)))
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs if len(classes) > 1 else 0):
        for k in rng.permutation(len(labels)):
            ids, counts = docs[k]
            now, done = rate * (1 - done / steps), done + 1
            if not len(ids):
                continue
            share = counts / counts.sum()
            mean = share @ embedding[ids]
            p = softmax((output @ mean + bias)[None])[0]
            p[which[k]] -= 1
            back = output.T @ p
            output -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            # A feature's own step does not shrink with the length of the text, else rare features of long texts never move.
            embedding[ids] -= (now * np.minimum(1.0, share * 50))[:, None] * back
    return Model(classes or [None], features, (embedding @ output.T).astype(np.float64), bias.astype(np.float64))


def calibrate(model: Model, labels: list, docs: list) -> None:
    """Sets the temperature at which held-back rows are likeliest."""
    if not labels or len(model.classes) < 2:
        return
    z = np.stack([(n @ model.scores[i] / n.sum() if len(i) else np.zeros(len(model.classes))) for i, n in docs]) + model.bias
    y = np.array([model.classes.index(x) for x in labels])
    grid = np.exp(np.linspace(np.log(0.1), np.log(30), 60))
    loss = [-np.log(np.maximum(softmax(z * t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])


def score(df: DataFrame, text: str, model: Model, columns: T.StructType, answer) -> DataFrame:
    """Appends columns computed by answer(probabilities) -> list of Arrow arrays, from whole texts."""
    where = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in columns.names]
    schema = T.StructType([df.schema[i] for i in kept] + columns.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                p = model.probabilities(as_bytes(part.column(where)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *answer(p)], names=schema.names)

    return df.mapInArrow(run, schema)
