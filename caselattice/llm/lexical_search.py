"""Ranked lexical search: an inverted index in fixed windows of documents, scored by scatter-adds.

The words of a block of queries are looked for in every whole text. Each task deals its documents to windows of at most
WINDOW and stores the window's postings, sorted by term: which documents hold it, how often. A second job goes through the
windows: for each query the postings of its terms are added into one array of WINDOW scores, the bits of touched documents
are or-ed, and touched documents are harvested into the query's heap, whose least score sifts the next window. A task sends
on its heaps; a query's best of some salted parts are ranked last.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; they are compared whole, not by
hash. With N documents that have a term, L their terms, n a document's, df the documents with a term and tf its occurrences,
a term's weight is floor(1000 ln((2N+2)/(2df+1))) and counts (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, once
for each occurrence in the query.

Defined results: null and empty texts have no term, whether documents or queries; they count in nothing. Equal scores go by
ascending document id, nulls last; every row is a document of its own, repeated ids included. Repeated queries, equal in id
and text, are one query; a null id is an id. Very long texts are read whole; a window closes early where they fill it. Empty
tables give an empty table. Only the two id columns and the texts are read, so further columns cannot clash.

Queries are broadcast in blocks of about TERMS terms, each with its own pass over the corpus; what comes to the driver is a
block and its terms' document counts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caselattice.llm.storage import stored
from caselattice.llm.text_kernel import WORD_BYTES, as_bytes

#: Documents of a window: its scores are 64 KB. A window with as many words is closed, too.
WINDOW, WINDOW_WORDS = 8192, 4_000_000
#: Terms of the queries that are broadcast at once, about.
TERMS = 1_000_000
#: Parts in which a query's candidates are ranked first.
SALTS = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _window_schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(ids)), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int16())), ("tfs", pa.list_(pa.int32()))])


def build_windows(documents: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row a window: the documents with a term of the vocabulary, and for each such term its documents and counts, all
    terms' one after another. n_docs and n_words count every document that has any term."""
    ids_type = documents.schema[doc_id].dataType.simpleString()
    schema = f"n_docs long, n_words long, ids array<{ids_type}>, sizes array<long>, terms array<int>, dfs array<int>, docs array<short>, tfs array<int>"
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        find = known.get
        n_docs = n_words = 0
        ids, sizes, docs, terms = [], [], [], []

        def closed(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal n_docs, n_words, ids, sizes, docs, terms
            keys, tfs = np.unique(np.concatenate(terms).astype(np.int64) * WINDOW + np.repeat(np.arange(len(docs)), docs), return_counts=True) if terms else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            names, dfs = np.unique(keys // WINDOW, return_counts=True)
            row = [n_docs, n_words, ids, sizes, names, dfs, (keys % WINDOW).astype(np.int16), tfs]
            n_docs = n_words = 0
            ids, sizes, docs, terms = [], [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _window_schema(kind))], schema=_window_schema(kind))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = terms_of(raw)
                if not words:
                    continue
                n_docs, n_words = n_docs + 1, n_words + len(words)
                held = [t for t in map(find, words) if t is not None]
                if held:
                    ids.append(key)
                    sizes.append(len(words))
                    docs.append(len(held))
                    terms.append(np.array(held, np.int32))
                if len(ids) == WINDOW or n_words >= WINDOW_WORDS:
                    yield closed(kind)
        if n_docs:
            yield closed(kind)

    return documents.select(doc_id, text).mapInArrow(index, schema)


def weigh(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best_of(windows: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_words: int, top: int, ids_type: str) -> DataFrame:
    """(query, doc, score): each task's best documents of each query. queries: the (term, times) of each."""
    shared = windows.sparkSession.sparkContext.broadcast(([(np.array([t for t, _ in q], np.int32), np.array([k for _, k in q], np.int64)) for q in queries], weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        heaps: list[list] = [[] for _ in asked]
        at = np.full(len(weights), -1, np.int32)
        scores = np.zeros(WINDOW, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in range(batch.num_rows):
                ids, sizes, terms, dfs, docs, tfs = (batch.column(c)[row].values for c in range(6))
                ids = ids.to_pylist()
                sizes, terms, dfs, docs, tfs = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, terms, dfs, docs, tfs))
                m = 75 + (25 * sizes * n_docs) // n_words
                gains = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs]) * np.repeat(weights[terms], dfs)
                ends = np.cumsum(dfs)
                starts = ends - dfs
                bits = []
                for s, e in zip(starts, ends):
                    touched = np.zeros(WINDOW, bool)
                    touched[docs[s:e]] = True
                    bits.append(np.packbits(touched))
                at[terms] = np.arange(len(terms))
                for q, (names, times) in enumerate(asked):
                    places = at[names]
                    if (places < 0).all():
                        continue
                    occupied = np.zeros(WINDOW // 8, np.uint8)
                    for p, k in zip(places, times):
                        if p >= 0:
                            scores[docs[starts[p] : ends[p]]] += k * gains[starts[p] : ends[p]]
                            occupied |= bits[p]
                    touched = np.flatnonzero(np.unpackbits(occupied))
                    got = scores[touched]
                    scores[touched] = 0
                    heap = heaps[q]
                    keep = got >= max(heap[0][0] if len(heap) == top else 1, 1)
                    if keep.sum() > 4 * top:
                        keep &= got >= np.partition(got[keep], -top)[-top]
                    for d, x in zip(touched[keep].tolist(), got[keep].tolist()):
                        # Among equal scores the least id is the greatest entry, a null id the least.
                        entry = (x, _Backward(ids[d]))
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
                at[terms] = -1
        if kind is None:
            return
        found = [(q, d.value, x) for q, heap in enumerate(heaps) for x, d in heap]
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], kind), pa.array([r[2] for r in part], pa.int64())], ["query", "doc", "score"])

    return windows.select("ids", "sizes", "terms", "dfs", "docs", "tfs").mapInArrow(score, f"query int, doc {ids_type}, score long")


class _Backward:
    """Orders ids from the greatest to the least, null before all."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __lt__(self, other: _Backward) -> bool:
        return self.value != other.value and (self.value is None or (other.value is not None and self.value > other.value))

    def __eq__(self, other) -> bool:
        return self.value == other.value


def _ranked(found: DataFrame, keys: list[Column], top: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, top: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's `top` documents of all rows, ranks from 1; see the module."""
    spark = documents.sparkSession
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    ids_type, key_type = documents.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType
    size = asked.agg(F.sum(F.ceil(F.octet_length("text") / 4))).first()[0] or 0
    blocks = max(1, math.ceil(size / TERMS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        rows = [(r.id, Counter(terms_of(r.text.encode()))) for r in dealt.where(F.col("block") == b).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in rows for t in c}))}
        windows = stored(build_windows(documents, doc_id, text, vocabulary))
        n_docs, n_words = (x or 0 for x in windows.agg(F.sum("n_docs"), F.sum("n_words")).first())
        dfs = windows.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect()
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for r in dfs:
            weights[r.terms] = weigh(n_docs, r.df)
        best = _best_of(windows, [[(vocabulary[t], k) for t, k in c.items()] for _, c in rows], weights, n_docs, max(1, n_words), top, ids_type)
        salted = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))), [F.col("query"), F.col("salt")], top)
        ranked = _ranked(salted.drop("salt", "rank"), [F.col("query")], top)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(rows)], StructType([StructField("query", IntegerType()), StructField("id", key_type)]))
        found.append(ranked.join(F.broadcast(names), "query").select(F.col("id").alias(query_id), "rank", F.col("doc").alias(doc_id), "score"))
    return reduce(DataFrame.unionByName, found)

