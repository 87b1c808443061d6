"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Every text is cut into overlapping chunks, each pre-tokenised from its own start: of TASK_CHARS characters within the text's
task, and those of more than chunk_chars first into chunks that any task may take. The pre-token boundaries of two neighbours agree somewhere in
their overlap (from one common boundary on they agree for good, as a match depends on what follows alone), and there
the text is stitched: the pieces between such boundaries are encoded apart and their ids joined. If an overlap holds no
common boundary, as in one run of letters longer than it, the stitch pre-tokenises on from the last sure boundary until
it meets the next chunk's, and goes on from there in later chunks. A task remembers the ids of short pre-tokens. Decoding concatenates the bytes of the ids.

Defined results: null text counts as empty and gives no ids; ids decode to the very bytes; a null list of ids decodes to
the empty text; an id outside the vocabulary is an error. Other columns pass through. `ids` takes the place of the text:
decoding restores it."""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselattice.llm.storage import stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
#: Chunks of a text within its task, and pre-tokens whose ids a task remembers.
TASK_CHARS, TASK_OVERLAP, KNOWN = 1600, 64, 500_000
#: A match that ends this near to the end of a chunk might go on, or be another, in the whole text.
_MARGIN = 4


class Vocabulary:
    """Ranks as read by the driver; the encoder is built once in each Python worker."""

    _built: dict = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.lines, self.pattern = f.read(), pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}

    def encoder(self) -> tiktoken.Encoding:
        key = ("encoder", hash(self.lines), self.pattern)
        if key not in self._built:
            self._built[key] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return self._built[key]

    def pieces(self) -> list[bytes]:
        key = ("pieces", hash(self.lines))
        if key not in self._built:
            ranks = self.ranks()
            table = [b""] * (max(ranks.values()) + 1)
            for piece, i in ranks.items():
                table[i] = piece
            self._built[key] = table
        return self._built[key]


def boundaries(text: str, pattern: regex.Pattern, start: int = 0) -> Iterator[int]:
    """Ends of the pre-tokens from start on."""
    for m in pattern.finditer(text, start):
        yield m.end()


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk): chunks of `size` characters, each with `overlap` characters of the next."""
    for start in range(0, max(1, len(text)), size):
        yield start, text[start : start + size + overlap]


def stitch(text: str, chunks: list[tuple[int, list[int]]], pattern: regex.Pattern, overlap: int) -> list[int]:
    """Boundaries at which the whole text may be cut, first 0 and last its length.

    chunks: start and absolute pre-token ends of each, in order. A chunk's ends are sure from a boundary on that is
    sure in the one before, and up to _MARGIN before the chunk's end."""
    cuts, sure, walk = [0], {0}, None
    for k, (start, ends) in enumerate(chunks):
        limit = len(text) if k == len(chunks) - 1 else chunks[k + 1][0] + overlap - _MARGIN
        own = {e for e in (start, *ends) if e <= limit}
        # A piece that ended in white space would lose sight of what follows, on which the end of such a match depends.
        joints = {e for e in own if not text[e - 1].isspace()}
        met = min(joints & sure, default=None)
        if met is None:
            # No common boundary in the overlap: walk on from the last sure one until this chunk's are met or end. A walk
            # that has not met a chunk's goes on in the next, so no stretch of the text is walked twice.
            at = max(sure)
            if walk is None:
                walk, sure = boundaries(text, pattern, at), {at}
            while at <= limit and at not in joints and (e := next(walk, None)) is not None:
                at = e
                sure.add(e)
            met = min(joints & sure, default=None)
            if met is None:
                continue
        cuts.append(met)
        sure, walk = {met, *(e for e in own if e > met)}, None
    return sorted({*cuts, len(text)})


def pre_tokens(text: str, pattern: regex.Pattern, size: int, overlap: int) -> list[str]:
    """The text's pre-tokens: those of overlapping chunks, each from the first boundary that it shares with the one before.

    A chunk's ends are sure as in stitch, which also settles texts in which two chunks share no boundary."""
    out, last, last_ends = [], [], []
    starts = range(0, max(1, len(text) - overlap), size)
    for start in starts:
        tokens = pattern.findall(text[start : start + size + overlap])
        ends = list(accumulate(map(len, tokens), initial=start))
        if ends[-1] != min(len(text), start + size + overlap):
            raise ValueError("the pattern must match every character")
        at = 0
        if start:
            i, limit = bisect_left(last_ends, start), start + overlap - _MARGIN
            while i < len(last_ends) and at < len(ends) and last_ends[i] != ends[at]:
                i, at = (i + 1, at) if last_ends[i] < ends[at] else (i, at + 1)
            if i == len(last_ends) or at == len(ends) or ends[at] > limit:
                chunks = [(s, [s + e for e in boundaries(text[s : s + size + overlap], pattern)]) for s in starts]
                cuts = stitch(text, chunks, pattern, overlap)
                return [t for a, b in zip(cuts, cuts[1:], strict=False) for t in pattern.findall(text[a:b])]
            out += last[:i]
        # From the shared boundary on.
        last, last_ends = tokens[at:], ends[at:]
    return out + last


def _encode(df: DataFrame, text: str, ids: str, vocabulary: Vocabulary) -> DataFrame:
    where = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in (text, ids)]
    schema = T.StructType([df.schema[i] for i in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, encoder = regex.compile(vocabulary.pattern), vocabulary.encoder()
        # A pre-token need not be split again.
        encode = getattr(encoder, "_encode_single_piece", encoder.encode_ordinary)
        known: dict[str, list[int]] = {}

        def encoded(whole: str) -> list[int]:
            found: list[int] = []
            for token in pre_tokens(whole, compiled, TASK_CHARS, TASK_OVERLAP):
                part = known.get(token)
                if part is None:
                    part = encode(token)
                    if len(token) < 64:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[token] = part
                found += part
            return found

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [encoded(x) if x else [] for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def _encode_long(df: DataFrame, text: str, ids: str, vocabulary: Vocabulary, size: int, overlap: int) -> DataFrame:
    """The long texts' way: cut, pre-tokenise, stitch, encode, join."""
    others = [c for c in df.columns if c not in (text, ids)]
    pattern = vocabulary.pattern
    # The number tells rows apart in one stored table, which all that follows reads.
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others"))
    others_type = numbered.schema["_others"].dataType
    shape = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_start", T.LongType()), T.StructField("_chunk", T.StringType()), T.StructField("_others", others_type)])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for start, piece in cut(batch.column(1)[k].as_py(), size, overlap):
                    rest = batch.column(2).slice(k, 1) if start == 0 else pa.nulls(1, batch.column(2).type)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([start], pa.int64()), pa.array([piece], pa.string()), rest], names=shape.names)

    chunks = stored(numbered.mapInArrow(chunk, shape).repartition("_row", "_start"))
    with_ends = T.StructType([*shape.fields, T.StructField("_ends", T.ArrayType(T.LongType()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                start = part.column(1)[0].as_py()
                ends = [start + e for e in boundaries(part.column(2)[0].as_py(), compiled)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([ends], pa.list_(pa.int64()))], names=with_ends.names)

    pieces_of = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_piece", T.LongType()), T.StructField("_text", T.StringType())])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_start")
        whole = "".join(c[:size] for c in rows["_chunk"])
        cuts = stitch(whole, [(int(s), [int(x) for x in e]) for s, e in zip(rows["_start"], rows["_ends"], strict=True)], regex.compile(pattern), overlap)
        return pd.DataFrame({"_row": int(rows["_row"].iloc[0]), "_piece": range(len(cuts) - 1), "_text": [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})

    ends = chunks.mapInArrow(split, with_ends)
    # Each row's other columns ride on its first chunk and meet the joined ids by the row's number.
    pieces = ends.drop("_others").groupBy("_row").applyInPandas(join, pieces_of).repartition("_row", "_piece")
    encoded = _encode(pieces, "_text", "_ids", vocabulary).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_piece", "_ids"))).alias("_all"))
    joined = encoded.select("_row", F.flatten(F.transform("_all", lambda x: x["_ids"])).alias("_joined"))
    rest = chunks.filter(F.col("_start") == 0).select("_row", "_others")
    return joined.join(rest, "_row").select(*[F.col("_others")[c].alias(c) for c in others], F.col("_joined").alias(ids))


def encode_bpe(df: DataFrame, text: str, ids: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Replaces the column text by ids (array of int)."""
    vocabulary = Vocabulary(ranks, pattern)
    long = F.coalesce(F.char_length(F.col(text)) > chunk_chars, F.lit(False))
    return _encode(df.filter(~long), text, ids, vocabulary).unionByName(_encode_long(df.filter(long), text, ids, vocabulary, chunk_chars, overlap))


def decode_bpe(df: DataFrame, ids: str, out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """Appends the bytes of the ids as a binary column."""
    vocabulary = Vocabulary(ranks, "")
    where = df.columns.index(ids)
    kept = [i for i, c in enumerate(df.columns) if c != out]
    schema = T.StructType([df.schema[i] for i in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary.pieces().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [b"".join(map(piece, x or ())) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
