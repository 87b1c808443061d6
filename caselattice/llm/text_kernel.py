"""Bytes of Arrow text columns, and vectorised hashes of words and character n-grams over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z lower-cased; every ASCII byte that is no letter or digit a space; other bytes as they are.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: White space and control bytes a space; other bytes as they are.
PRINT_BYTES = bytes(b if b > 32 and b != 127 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(29))


def word_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space."""
    inside = raw != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(raw) and inside[-1]:
        edge = np.concatenate([edge, [len(raw)]])
    return edge[0::2], edge[1::2]


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial, from differences of one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PIECE = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order: runs of letters and digits of ASCII, A-Z lower-cased, and of all
    other bytes from 128 up. A text is worked off in pieces that end at a space, so memory stays bounded."""
    folded, out, at = text.translate(WORD_BYTES), [], 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= _PIECE else folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        raw = np.frombuffer(folded, np.uint8, end - at, at)
        out.append(hash_runs(raw, *word_starts(raw)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Features:
    """Buckets of hashed words and of byte n-grams (3 and 4 bytes), each kind in a range of its own. A word that is the same
    as the one before it counts as the one word REPEAT: repetition is then learned whatever the word.

    table is the byte translation that a text goes through first."""

    WORD_BITS, GRAM_BITS, REPEAT = 15, 16, 0

    def __init__(self, table: bytes) -> None:
        self.table = table
        self.size = (1 << self.WORD_BITS) + 2 * (1 << self.GRAM_BITS)

    def _of(self, raw: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, and the buckets of words, of 3-grams and of 4-grams by their start."""
        starts, ends = word_starts(raw)
        hashes = hash_runs(raw, starts, ends)
        words, same = (hashes >> np.uint64(64 - self.WORD_BITS)).astype(np.int64), np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        first = np.searchsorted(starts, [s for _, s, _ in spans])
        same[first[first < len(same)]] = False
        words[same] = self.REPEAT
        b = raw.astype(np.uint32)
        three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16) if len(b) > 2 else np.zeros(0, np.uint32)
        four = three[:-1] | b[3:] << np.uint32(24) if len(b) > 3 else np.zeros(0, np.uint32)
        with np.errstate(over="ignore"):
            odd, shift = np.uint32(0x9E3779B1), np.uint32(32 - self.GRAM_BITS)
            three = ((three * odd) >> shift) + np.uint32(1 << self.WORD_BITS)
            four = ((four * odd) >> shift) + np.uint32((1 << self.WORD_BITS) + (1 << self.GRAM_BITS))
        return starts, words, three, four

    def _groups(self, texts: list[bytes]):
        """(raw bytes, [(index of the text, start, end)]): small texts together, large ones in pieces ending at a space."""
        held, spans, size = [], [], 0
        for k, text in enumerate(texts):
            text, at = text.translate(self.table), 0
            while len(text) - at > _PIECE:
                end = text.find(b" ", at + _PIECE) + 1 or len(text)
                yield np.frombuffer(text, np.uint8, end - at, at), [(k, 0, end - at)]
                at = end
            piece = text[at:]
            if not piece:
                continue
            held.append(piece)
            spans.append((k, size, size + len(piece)))
            size += len(piece)
            if size > _PIECE:
                yield np.frombuffer(b" ".join(held), np.uint8), [(k, s + i, e + i) for i, (k, s, e) in enumerate(spans)]
                held, spans, size = [], [], 0
        if held:
            yield np.frombuffer(b" ".join(held), np.uint8), [(k, s + i, e + i) for i, (k, s, e) in enumerate(spans)]

    def sums(self, texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums of its features' weights (columns of `weights`) and the number of its features."""
        total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
        columns = [np.ascontiguousarray(weights[:, c]) for c in range(weights.shape[1])]
        for raw, spans in self._groups(texts):
            starts, words, three, four = self._of(raw, spans)
            k, s, e = (np.array(x) for x in zip(*spans, strict=True))
            for buckets, lo, hi in ((words, np.searchsorted(starts, s), np.searchsorted(starts, e)), (three, s, np.maximum(s, e - 2)), (four, s, np.maximum(s, e - 3))):
                np.add.at(count, k, hi - lo)
                cut = np.minimum(np.stack([lo, hi], 1).ravel(), len(buckets))
                for c, column in enumerate(columns):
                    part = np.add.reduceat(np.append(column[buckets], 0.0), cut)[0::2]
                    np.add.at(total[:, c], k, np.where(hi > lo, part, 0.0))
        return total, count

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of one text, and how often each occurs."""
        found: dict[int, int] = {}
        parts = []
        for raw, spans in self._groups([text]):
            _, words, three, four = self._of(raw, spans)
            parts.append(np.unique(np.concatenate([words, three, four]).astype(np.int64), return_counts=True))
        if len(parts) == 1:
            return parts[0][0].astype(np.uint32), parts[0][1].astype(np.float32)
        for ids, n in parts:
            for i, x in zip(ids.tolist(), n.tolist(), strict=True):
                found[i] = found.get(i, 0) + x
        return np.fromiter(found.keys(), np.uint32, len(found)), np.fromiter(found.values(), np.float32, len(found))
