"""Line deduplication by a log-template tree of fixed depth.

A line goes to the leaf of its token count and its first ``depth`` tokens; tokens with a digit are variable fields there and
everywhere. Inside a leaf a token is constant at its position if enough lines of documents have it there, else it is a variable
field; a line's template is the leaf with the line's constants, if they are ``similar`` of its tokens at least. A variable field
may have a value that is common in itself, so templates are made at ``LEVELS`` several bounds on how common a constant is.
Lines whose template, or which themselves, stand in ``min_docs`` documents or more recur, and all of them are dropped.

Constants are told by counts, so neither the order of lines nor how they are dealt to tasks has a part in the outcome, and no
task holds a leaf: counts are added up before each shuffle, and rows are keyed by token, line, template or document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import materialize
from .words import SPACED, _buffers, _edges, mix, slices, words_of

PIECE = 2 << 20
#: Bounds for constants, in multiples of ``min_docs``.
LEVELS = (1, 4, 16)


def parse_lines(texts: pa.Array, depth: int) -> tuple[np.ndarray, ...]:
    """For the lines of all texts: the text's number, place in it, leaf, first token offsets, hash of each token (0 for
    variable ones), and a hash of the whole line."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = split.flatten()
    counts = np.diff(split.offsets.to_numpy())
    words = words_of(flat, SPACED)
    first = words.first
    line = line_hashes(first, words.hashes)
    tokens = words.hashes.copy()
    if len(tokens):
        raw, at = _buffers(flat)
        _, starts, ends = _edges(raw, at, SPACED)
        digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        tokens[digits[ends] > digits[starts]] = 0
    sizes = np.diff(first)
    leaf = mix(sizes.astype(np.uint64) + np.uint64(depth))
    for k in range(depth):
        has = sizes > k
        leaf[has] = mix(leaf[has] * np.uint64(3) + tokens[first[:-1][has] + k])
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, place, leaf.view(np.int64), first, tokens, line


def line_hashes(first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One hash for each line's tokens in order."""
    sizes = np.diff(first)
    n = np.repeat(sizes, sizes)
    terms = mix(tokens + (_places(first).astype(np.uint64) << np.uint64(32)) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _places(first: np.ndarray) -> np.ndarray:
    """Place of each token in its line."""
    sizes = np.diff(first)
    return np.arange(int(sizes.sum())) - np.repeat(first[:-1] - first[0], sizes)


def field_keys(leaf: np.ndarray, place: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One number for a token at a place of a leaf."""
    return mix(mix(leaf.view(np.uint64) + place.astype(np.uint64)) * np.uint64(3) + tokens).view(np.int64)


BITMAP_BITS = 25


def bitmap(leaves: DataFrame) -> np.ndarray:
    """A fixed 4 MB bit for bit: set where a leaf's hash falls. Eight parts are made on executors and joined here. It only
    spares work: a leaf it lists by chance is taken out by the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            bits[slot(batch.column(0).to_numpy())] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in leaves.select("leaf").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def slot(leaf: np.ndarray) -> np.ndarray:
    return (leaf.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def listed(bits: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    at = slot(leaf)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def occurrences(docs: DataFrame, depth: int) -> DataFrame:
    """doc, place, leaf and line of every line that is not blank; ``docs`` has doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            owner, place, leaf, first, _, line = parse_lines(piece.column(1), depth)
            some = np.diff(first) > 0
            doc = piece.column(0).to_numpy()[owner[some]]
            yield pa.record_batch([pa.array(x) for x in (doc, place[some].astype(np.int32), leaf[some], line[some])], ["doc", "place", "leaf", "line"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, place int, leaf bigint, line bigint")


def fields(docs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, line, n (tokens), keys (of its constant candidates) for the lines of ``leaves``, from the texts; lines repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            _, _, leaf, first, tokens, line = parse_lines(piece.column(0), depth)
            may = np.flatnonzero((np.diff(first) > 0) & listed(sent.value, leaf))
            _, at = np.unique(line[may], return_index=True)
            at = may[at]
            sizes = np.diff(first)
            keys = field_keys(np.repeat(leaf, sizes), _places(first), tokens)
            own = [slice(first[i], first[i + 1]) for i in at.tolist()]
            kept = [keys[s][tokens[s] != 0] for s in own]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *kept])
            yield pa.record_batch([pa.array(leaf[at]), pa.array(line[at]), pa.array(sizes[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["leaf", "line", "n", "keys"])

    made = docs.select("text").mapInArrow(run, "leaf bigint, line bigint, n int, keys array<bigint>")
    return made.join(leaves.hint("merge"), "leaf", "left_semi")


def recurring(found: DataFrame, docs: DataFrame, *, depth: int, similar: float, min_docs: int) -> DataFrame:
    """The lines that recur, from the occurrences ``found`` and their texts."""
    shared = materialize(found.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "shared")
    # grouped by line and document, not by leaf, so that the join before can split a leaf
    pairs = found.join(shared.hint("merge"), "leaf", "left_semi").groupBy("line", "doc").agg(F.first("leaf").alias("leaf"))
    pairs = materialize(pairs, "pairs")
    lines = materialize(pairs.groupBy("leaf", "line").agg(F.count("*").alias("docs")), "lines")
    busy = materialize(lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).where("lines > 1").select("leaf"), "busy")
    parsed = fields(docs, busy, depth).groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    parsed = materialize(parsed.join(lines.select("line", "docs"), "line"), "fields")
    each = parsed.select("line", "leaf", "n", "docs", F.explode("keys").alias("key"))
    support = materialize(each.groupBy("key").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs), "support")
    common = each.select("line", "leaf", "n", "key").join(support.hint("merge"), "key")
    constant = [F.col("support") >= min_docs * m for m in LEVELS]
    told = common.groupBy("line", "leaf", "n").agg(*[f.alias(f"{name}{i}") for i, yes in enumerate(constant) for name, f in (("x", F.expr(f"bit_xor(IF(support >= {min_docs * LEVELS[i]}, key, 0))")), ("c", F.count(F.when(yes, 1))))])
    # constants differ from level to level or the template is the same, so a template's hash need not name its level
    made = [F.when(F.col(f"c{i}") >= F.ceil(F.lit(similar) * F.col("n") - 1e-9), F.xxhash64("leaf", f"x{i}", f"c{i}")) for i in range(len(LEVELS))]
    templates = materialize(told.select("line", F.array_distinct(F.array_compact(F.array(*made))).alias("templates")).where(F.size("templates") > 0), "templates")
    named = pairs.select("line", "doc").join(templates.hint("merge"), "line").select("doc", F.explode("templates").alias("template"))
    wide = materialize(named.distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template"), "recurring")
    by_template = templates.select("line", F.explode("templates").alias("template")).join(wide.hint("merge"), "template", "left_semi").select("line")
    return lines.where(F.col("docs") >= min_docs).select("line").unionByName(by_template).distinct()


def drop_recurring(docs: DataFrame, *, depth: int = 3, similar: float = 0.7, min_docs: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text without recurring lines: one row for each row of ``docs``.

    Lines end at \\n; blank lines always stay. A line is its words, A-Z lowered. Null texts stay null and have no lines; empty
    ones have one blank line. Rows that repeat both id and text count as one document, and each is returned. Documents are told
    apart by a hash of id and text; other columns are ignored, whatever their names. An empty table gives no rows. A text is
    worked on as a whole, in time that is linear in its length.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keyed = narrow.withColumn("doc", F.xxhash64("doc_id", "text"))
    found = materialize(occurrences(keyed, depth), "occurrences")
    lines = materialize(recurring(found, keyed, depth=depth, similar=similar, min_docs=min_docs), "lines")
    places = found.select("doc", "place", "line").join(lines.hint("merge"), "line", "left_semi")
    gone = materialize(places.groupBy("doc").agg(F.collect_set("place").alias("gone")), "gone")
    rows = keyed.join(gone.hint("merge"), "doc", "left").select("doc_id", "gone", "text")  # grows with the corpus: never broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            texts, gone_ = piece.column(2), piece.column(1)
            n_lines = pc.if_else(pc.is_null(texts), 0, pc.add(pc.fill_null(pc.count_substring(texts, "\n"), 0), 1)).cast(pa.int64())
            n_gone = pc.fill_null(pc.list_value_length(gone_), 0).cast(pa.int64())
            some = np.flatnonzero(n_gone.to_numpy() > 0)
            if len(some):
                whole = texts.to_pylist()
                for i, drop in zip(some.tolist(), gone_.take(pa.array(some)).to_pylist(), strict=True):
                    out = set(drop)
                    whole[i] = "\n".join(x for k, x in enumerate(whole[i].split("\n")) if k not in out)
                texts = pa.array(whole, pa.string())
            yield pa.record_batch([piece.column(0), n_lines, n_gone, texts], ["doc_id", "n_lines", "n_dropped", "text"])

    return rows.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
