"""Words of many texts at once, straight from their UTF-8 bytes.

Both word classes used here are decided by single ASCII bytes (every byte of a non-ASCII character belongs to a word), so
words are runs in a byte mask, and a word is known by a 64-bit hash of its bytes with A-Z lowered. No Python string is
made. Results that hang on equality of words are safe up to the collision rate of 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z: letters, digits, everything beyond ASCII.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ALNUM[ord("A") : ord("Z") + 1] = True
#: [^\x20\x09-\x0D]+: runs without ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = U64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << n.bit_length(), _BASE, np.uint64))
    return _POWERS


@dataclass
class Words:
    """Words of consecutive texts: ``hashes`` in order; text i has hashes[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _edges(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask of word bytes, and where each word starts and ends; a word never crosses texts."""
    inside = kind[raw]
    starts_here, ends_here = inside.copy(), inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    starts_here[at[:-1][filled]] |= inside[at[:-1][filled]]
    ends_here[at[1:][filled] - 1] |= inside[at[1:][filled] - 1]
    return inside, np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1


#: Bytes of text whose words are told at once, several texts or one longer one: the arrays at work are ten times as large.
CHUNK = 1 << 19


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    parts = [_words(texts.slice(a, b - a), kind) for a, b in cuts(texts, CHUNK)]
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0, *(len(p.hashes) for p in parts)])
    first = [p.first[:-1] + n for p, n in zip(parts, before, strict=False)]
    return Words(np.concatenate([np.zeros(0, np.uint64), *(p.hashes for p in parts)]), np.concatenate([*first, before[-1:]]).astype(np.int64))


def _words(texts: pa.Array, kind: np.ndarray) -> Words:
    raw, at = _buffers(texts)
    inside, starts, ends = _edges(raw, at, kind)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    terms = _BYTE[raw[inside]] * _powers(int(lengths.max()))[place]
    return Words(mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64)), first)


def count_words(texts: pa.Array, kind: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    if not len(texts):
        return np.zeros(0, np.int64)
    raw, at = _buffers(texts)
    _, starts, _ = _edges(raw, at, kind)
    return np.diff(np.searchsorted(starts, at)).astype(np.int64)


def cuts(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts stay under ``most_bytes``, or that are one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most_bytes, "right")))
        yield at, to
        at = to


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece stay under ``most_bytes``, or the piece is one row."""
    for batch in batches:
        for at, to in cuts(batch.column(batch.schema.get_field_index(column)), most_bytes):
            yield batch.slice(at, to - at)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on from task to task, and what one has used others may need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: ``width`` consecutive words, or the whole text if it has fewer."""
    h, n = words.hashes, len(words.hashes)
    grown = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        grown += mix(h[k : k + len(grown)] + U64(2 * k + 1)) * U64(2 * k + 3)
    grown = mix(grown)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grown[a : b - width + 1])
        elif b > a:
            total = np.array([b - a], np.uint64)
            for k in range(a, b):
                total = mix(total ^ h[k]) + U64(1)
            yield total
        else:
            yield np.zeros(0, np.uint64)
