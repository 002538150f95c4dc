"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment covers consecutive documents of one partition (about ``segment_bytes`` of text,
or one longer document) and holds, for each term, the ascending positions at which it stands, on one axis that runs through
all of the segment's documents: sorted terms, offsets, and delta-coded positions, Lucene-fashion. Segments are independent,
so a term in a third of all rows is spread over all of them and no posting is ever shuffled.

A phrase is looked up in a segment by intersecting its terms' position lists, each shifted back by the term's place, from
the rarest term on; a phrase with a term that the segment lacks ends at once. Proximity search widens the shifted lists.
The index holds every token's postings, whatever is looked up in it. Test phrases travel to the segments in blocks of at most
``block_windows``, and a block's matches are written before the next one is sent, so neither driver nor tasks hold more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import materialize
from .words import ALNUM, slices, words_of

SEGMENT = "segment string, doc_ids array<bigint>, first array<int>, terms binary, begin binary, positions binary"


def _pack(positions: np.ndarray) -> bytes:
    """Ascending positions as gaps, in 16 bits where that is enough; longer gaps as 65535 and a 32-bit value at the end."""
    gaps = np.diff(positions, prepend=0)
    wide = (gaps < 0) | (gaps >= 65535)
    small = np.where(wide, 65535, gaps).astype(np.uint16)
    return np.int32(len(small)).tobytes() + small.tobytes() + gaps[wide].astype(np.int32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    gaps = np.frombuffer(data, np.uint16, n, 4).astype(np.int64)
    gaps[gaps == 65535] = np.frombuffer(data, np.int32, -1, 4 + 2 * n)
    return np.cumsum(gaps)


def build_index(docs: DataFrame, *, segment_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of ``docs`` with the postings of all of their tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", segment_bytes):
            words = words_of(piece.column(1), ALNUM)
            order = np.argsort(words.hashes, kind="stable").astype(np.int32)
            sorted_ = words.hashes[order]
            begin = np.flatnonzero(np.concatenate([np.ones(min(len(sorted_), 1), bool), sorted_[1:] != sorted_[:-1]]))
            ends = np.append(begin, len(sorted_)).astype(np.int32)
            one = [[uuid.uuid4().hex], [piece.column(0).to_pylist()], [words.first.tolist()], [sorted_[begin].tobytes()], [ends.tobytes()], [_pack(order)]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], ["segment", "doc_ids", "first", "terms", "begin", "positions"])

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, SEGMENT)


class Segment:
    """One segment, opened for lookups."""

    def __init__(self, row: dict):
        self.name, self.doc_ids = row["segment"], row["doc_ids"]
        self.first = np.asarray(row["first"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.begin = np.frombuffer(row["begin"], np.int32)
        self.positions = _unpack(row["positions"])

    def list_of(self, slot: int) -> np.ndarray:
        return self.positions[self.begin[slot] : self.begin[slot + 1]]

    def phrase(self, slots: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start and end positions of the stretches in which the terms stand one after the other inside one document; with
        ``slack``, each term may stand up to that many places off, and a stretch runs from its first term to its last."""
        sizes = self.begin[slots + 1] - self.begin[slots]
        order = np.argsort(sizes, kind="stable")
        if slack:
            return self._loose(slots, order, slack)
        found = self.list_of(slots[order[0]]) - order[0]
        for k in order[1:]:
            there = self.list_of(slots[k]) - k
            near = np.searchsorted(there, found)
            near[near == len(there)] = 0
            found = found[there[near] == found]
            if not len(found):
                return found, found
        found = found[found >= 0]
        doc = np.searchsorted(self.first, found, "right") - 1
        found = found[found + len(slots) <= self.first[doc + 1]]
        return found, found + len(slots)

    def _loose(self, slots: np.ndarray, order: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Every start is tried that the rarest term allows, so which term is rarest does not matter; a start may lie before
        its document, matched positions may not."""
        rare = self.list_of(slots[order[0]])
        at = np.repeat(rare, 2 * slack + 1)
        start = at - order[0] + np.tile(np.arange(-slack, slack + 1), len(rare))
        doc = np.searchsorted(self.first, at, "right") - 1
        low, high = at, at
        for k in order[1:]:
            there = self.list_of(slots[k])
            near = np.searchsorted(there, np.maximum(start + k - slack, self.first[doc]))
            match = there[np.minimum(near, len(there) - 1)]
            good = (near < len(there)) & (match <= np.minimum(start + k + slack, self.first[doc + 1] - 1))
            start, doc, match = start[good], doc[good], match[good]
            low, high = np.minimum(low[good], match), np.maximum(high[good], match)
        spans = np.unique(np.stack([low, high + 1], axis=1), axis=0)
        return spans[:, 0], spans[:, 1]


@dataclass
class Patterns:
    """Distinct phrases by length. Phrase p of length n is held by the items owners[n][0][a:b], a and b being owners[n][1][p]
    and the next."""

    names: list[str]
    phrases: dict[int, np.ndarray]
    owners: dict[int, tuple[np.ndarray, np.ndarray]]

    def items(self, n: int, p: int) -> np.ndarray:
        who, begin = self.owners[n]
        return who[begin[p] : begin[p + 1]]


def patterns_of(items: list[tuple[str, np.ndarray]], window: int) -> Patterns:
    """Windows of ``window`` words of each item (name and word hashes); an item of fewer, but not none, is one window."""
    rows: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for i, (_, h) in enumerate(items):
        if n := min(window, len(h)):
            rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(h, n))
            owners.setdefault(n, []).append(np.full(len(h) - n + 1, i, np.int32))
    phrases, held = {}, {}
    for n, parts in rows.items():
        phrases[n], code = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([code.ravel().astype(np.int32), np.concatenate(owners[n])], 1), axis=0)
        held[n] = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(len(phrases[n]) + 1))
    return Patterns([name for name, _ in items], phrases, held)


def pattern_blocks(items: DataFrame, window: int, *, item_id: str, text: str, block_windows: int) -> Iterator[Patterns]:
    """Items, streamed to the driver, as blocks of patterns with ``block_windows`` windows at most. An item of more is cut into
    stretches that share all but one word of a window."""
    held, total = [], 0
    known = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for r in known.toLocalIterator():
        h = words_of(pa.array([r["t"]], pa.string()), ALNUM).hashes
        for at in range(0, max(1, len(h) - window + 1), block_windows):
            part = h[at : at + block_windows + window - 1]
            if held and total + len(part) > block_windows:
                yield patterns_of(held, window)
                held, total = [], 0
            held.append((r["i"], part))
            total += len(part)
    if held:
        yield patterns_of(held, window)


def search_segment(seg: Segment, patterns: Patterns, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start positions, end positions and item numbers of every phrase that occurs."""
    if not len(seg.terms):
        return
    for n, phrases in patterns.phrases.items():
        slots = np.searchsorted(seg.terms, phrases)
        slots[slots == len(seg.terms)] = 0
        for p in np.flatnonzero((seg.terms[slots] == phrases).all(axis=1)).tolist():
            found, ends = seg.phrase(slots[p], slack)
            if len(found):
                yield found, ends, patterns.items(n, p)


MATCHES = "segment string, row int, doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def matches(index: DataFrame, sent: Broadcast, *, slack: int = 0) -> DataFrame:
    """One row for each document of the index: segment and row (its place there), doc_id, n_words, spans (start and end word of
    each stretch that phrases cover), items (sorted names of the items found). ``sent``: Patterns, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _documents(Segment(row), sent.value, slack)

    return index.mapInArrow(run, MATCHES)


def _documents(seg: Segment, patterns: Patterns, slack: int) -> pa.RecordBatch:
    n_docs, total = len(seg.doc_ids), int(seg.first[-1])
    edge = np.zeros(total + 1, np.int32)
    items: list[set] = [set() for _ in range(n_docs)]
    for found, ends, who in search_segment(seg, patterns, slack):
        np.add.at(edge, found, 1)
        np.add.at(edge, ends, -1)
        for d in np.unique(np.searchsorted(seg.first, found, "right") - 1).tolist():
            items[d].update(who.tolist())
    hit = np.cumsum(edge)[:-1] > 0
    spans = []
    for d in range(n_docs):
        own = hit[seg.first[d] : seg.first[d + 1]]
        if own.any():
            change = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            spans.append([{"start": a, "end": b} for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)])
        else:
            spans.append([])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    named = pa.array([sorted({patterns.names[i] for i in x}) for x in items], pa.list_(pa.string()))
    place = [pa.array([seg.name] * n_docs, pa.string()), pa.array(range(n_docs), pa.int32()), pa.array(seg.doc_ids, pa.int64())]
    arrays = [*place, pa.array(np.diff(seg.first), pa.int64()), pa.array(spans, kind), named]
    return pa.record_batch(arrays, ["segment", "row", "doc_id", "n_words", "spans", "items"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, slack: int = 0, block_windows: int = 1 << 17, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, spans, n_items, items (ids as sorted strings), contaminated.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A word is hit if it lies in an occurrence of
    any window of ``window`` consecutive item words. Null or empty texts have no words and are clean; items without words
    or without id match nothing; repeated items count once by id; rows that repeat a doc_id stay separate, rows without one are
    judged as any other; an empty table gives no rows; other columns are ignored, whatever their names. A text longer than a
    segment is a segment of its own.
    """
    spark = docs.sparkSession
    segments = materialize(build_index(docs, doc_id=doc_id, text=text), "segments")
    blocks = pattern_blocks(benchmark, window, item_id=item_id, text=item_text, block_windows=block_windows)
    first, second = next(blocks, Patterns([], {}, {})), next(blocks, None)
    if second is None:
        return _counted(matches(segments, spark.sparkContext.broadcast(first), slack=slack))
    parts = []
    for block in chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(block)
        parts.append(materialize(matches(segments, sent, slack=slack), "matches"))
        sent.unpersist(blocking=True)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return _counted(merged.withColumn("spans", F.array_sort("spans")))


def _counted(found: DataFrame) -> DataFrame:
    """Covered words from spans that are sorted by start and may overlap."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    n_hit = F.aggregate("spans", zero, step, lambda acc: acc["n"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", F.size("items").cast("bigint").alias("n_items"), "items", (n_hit > 0).alias("contaminated"))
