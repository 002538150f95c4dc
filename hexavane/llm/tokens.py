"""Token ids of whole documents, written as bit-packed blocks in ascending doc_id order and read back.

A file is a Parquet file whose rows are blocks: the packed bytes, the documents they hold and where each starts. Blocks
hold whole documents. Files are written by Spark's own committer, so any store will do and a lost task leaves nothing.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .packing import bits_for, pack, unpack
from .words import slices

BLOCK = "shard string, block int, shard_start bigint, n_tokens bigint, first_doc bigint, last_doc bigint, first_tie bigint, doc_ids array<bigint>, starts array<int>, data binary"
PIECE = 2 << 20
#: So many documents are looked up by a condition for each.
FEW = 64


#: Letters that are one pre-token together, and ASCII marks that are one after them; the apostrophe, which has rules of its own, is neither.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_WORD_END = "</w>"


# The parts of a tokenizer file for which chunks between ASCII white space can be encoded apart, as they stand there.
_CHUNK_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def chunks_are_exact(definition: dict) -> bool:
    """Whether no rule of a tokenizer looks across ASCII white space: normalizer and pre-tokenizer must be known ones, and added
    tokens must hold no white space and take none with them. Any other tokenizer gets whole texts."""
    normal, split = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [{}]
    first = steps[0]
    added = definition.get("added_tokens", [])
    return (
        normal.get("type") == "Sequence"
        and normal.get("normalizers") == _CHUNK_NORMALIZER
        and split.get("type") == "Sequence"
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (first.get("behavior"), first.get("invert"), (first.get("pattern") or {}).get("Regex")) == ("Removed", True, _CHUNK_PATTERN)
        and not steps[1].get("add_prefix_space")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)
    )


class ChunkEncoder:
    """Encodes texts; for a tokenizer that allows it, chunk by chunk between ASCII white space, each distinct chunk once.

    Exact for a tokenizer that drops white space before it splits words: no rule of it then looks across a chunk's edge.
    ``chunks_are_exact`` tells; whole texts are encoded otherwise. The tokenizer known there lowers case, splits letters from
    marks and closes words by a suffix, so a chunk of letters and marks is its word and its marks, and new words are encoded
    many at a time, told apart by that suffix. ``most`` bounds what is remembered between calls.
    """

    def __init__(self, definition: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        d = json.loads(definition)
        self.chunks = chunks_are_exact(d)
        self.joins = self.chunks and d["model"].get("end_of_word_suffix") == _WORD_END
        self.ends = np.zeros(largest_id(definition) + 1, bool)
        self.ends[[i for w, i in d["model"]["vocab"].items() if w.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.size)
        self.known.update(zip(names, range(at, at + len(names)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, parts: list[str]) -> None:
        each = self._one_by_one(parts)
        self._keep(parts, np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each)))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters only: joined by spaces, and cut behind each id that closes a word."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            if len(size) != len(some):
                each = self._one_by_one(some)
                got, size = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            ids.append(got)
            sizes.append(size)
        self._keep(words, np.concatenate(ids), np.concatenate(sizes))

    def _codes(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the parts, learnt where they are new."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [n for n in names if n not in self.known]
        if self.joins and fresh:
            letters = pc.match_substring_regex(pa.array(fresh), f"^{_LETTERS}$").to_pylist()
            self._learn_words([n for n, yes in zip(fresh, letters, strict=True) if yes])
            fresh = [n for n, yes in zip(fresh, letters, strict=True) if not yes]
        if fresh:
            self._learn(fresh)
        own = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)

    def _pool(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has."""
        if len(self.known) > self.most:
            self._forget()
        if self.joins and len(chunks):
            plain = pc.and_not(pc.match_substring_regex(chunks, f"^{_LETTERS}{_MARKS}$"), pc.match_substring(chunks, "<|"))
            word = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(chunks), f"{_MARKS}$", ""), chunks)
            mark = pc.if_else(plain, pc.replace_substring_regex(chunks, f"^{_LETTERS}", ""), "")
            parts = np.stack([self._codes(word), self._codes(mark)], 1)
        else:
            parts = self._codes(chunks)[:, None]
        size = self.size[parts]
        return self._gather(parts.ravel(), size.ravel()), size.sum(1)

    def _gather(self, parts: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.begin[parts], size)]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with ``end`` after each text, and the n + 1 offsets of the texts."""
        if not self.chunks:
            each = [np.append(x, np.uint32(end)) for x in self._one_by_one(pc.fill_null(texts, "").to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int64)
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = chunks.flatten().dictionary_encode()
        pool, size = self._pool(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        lengths = size[code]
        edges = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        place = np.concatenate([[0], np.cumsum(lengths)])[edges]
        ids = pool[spread((np.cumsum(size) - size)[code], lengths)]
        return np.insert(ids, place[1:], end), place + np.arange(len(place))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then the same for the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(definition: str) -> ChunkEncoder:
    """The worker's encoder, kept from task to task."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = ChunkEncoder(definition)
    return _ENCODERS[definition]


def largest_id(definition: str) -> int:
    """Largest id of a tokenizer file, its added tokens included."""
    d = json.loads(definition)
    return max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", []))])


def write_tokens(docs: DataFrame, path: str, definition: str, *, end: int = 2, block_tokens: int = 1 << 18, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize and write. ``definition`` is the tokenizer's JSON text, of fixed size, sent to every executor once.

    Null texts are empty and give the end id alone. Documents without doc_id come first. Repeated doc_ids stay separate
    rows, ordered by a hash of their text. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(definition)
    bits = bits_for(max(largest_id(definition), end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        shard, block, done = uuid.uuid4().hex, 0, 0
        docs_held, ids_held, ends_held, ties, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, done, held
            ids = np.concatenate(ids_held)
            starts = np.concatenate([[0], np.concatenate(ends_held)])
            row = [shard, block, done, len(ids), docs_held[0], docs_held[-1], ties[0], list(docs_held), starts.tolist(), pack(ids, bits)]
            block, done, held = block + 1, done + len(ids), 0
            for x in (docs_held, ids_held, ends_held, ties):
                x.clear()
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _kinds(), strict=True)], _names())

        for piece in slices(batches, "text", PIECE):
            ids, at = encoder.encode(piece.column(1), end)
            names, tie = piece.column(0).to_pylist(), piece.column(2).to_pylist()
            a = 0
            while a < len(names):
                b = max(a + 1, int(np.searchsorted(at, at[a] + block_tokens - held, "right")) - 1)
                docs_held += names[a:b]
                ties += tie[a:b]
                ids_held.append(ids[at[a] : at[b]])
                ends_held.append(at[a + 1 : b + 1] - at[a] + held)
                held += int(at[b] - at[a])
                a = b
                if held >= block_tokens or a < len(names):
                    yield flush()
        if docs_held:
            yield flush()

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = narrow.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(run, BLOCK).write.parquet(path)


def _kinds() -> list[pa.DataType]:
    return [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def _names() -> list[str]:
    return [x.split()[0] for x in BLOCK.split(", ")]


def open_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file set with ``base``, the number of ids before each one's shard.

    One shard is one writing task, so their totals are as few as its tasks; only these pass through the driver.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    key = F.struct(F.col("first_doc").isNotNull().alias("known"), "first_doc", "first_tie")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min(key).alias("key")).orderBy("key").select("shard", "n").collect()
    base, rows = 0, []
    for r in totals:
        rows.append((r["shard"], base))
        base += r["n"]
    return blocks.join(F.broadcast(spark.createDataFrame(rows, "shard string, base bigint")), "shard")


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None, *, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, from the files; without ``ids`` they are
    unpacked and summed up but not returned.

    With ``doc_ids``, only blocks whose document range can hold one of them are unpacked, and of these only those documents'
    bytes; the files' statistics leave out what lies beyond the smallest and largest one, and for a few (``FEW``) all others.
    """
    ship(spark)
    blocks = open_blocks(spark, path)
    wanted = None if doc_ids is None else np.unique(np.array(list(doc_ids), np.int64))
    if wanted is not None:
        if not len(wanted):
            blocks = blocks.limit(0)
        elif len(wanted) <= FEW:
            reach = F.lit(False)
            for d in wanted.tolist():
                reach = reach | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
            blocks = blocks.where(reach)
        else:
            blocks = blocks.where((F.col("last_doc") >= int(wanted[0])) & (F.col("first_doc") <= int(wanted[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, starts = batch.column(0)[i].values, np.asarray(batch.column(1)[i].values.to_numpy(), np.int64)
                data = batch.column(4)[i].as_buffer()
                first = batch.column(2)[i].as_py() + batch.column(3)[i].as_py()
                if wanted is None:
                    picked, all_ids = np.arange(len(names)), unpack(data)
                    each = [all_ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                else:
                    picked = np.flatnonzero(pc.is_in(names, pa.array(wanted)).to_numpy(zero_copy_only=False))
                    each = [unpack(data, int(starts[k]), int(starts[k + 1])) for k in picked]
                arrays = [names.take(pa.array(picked)), pa.array(first + starts[picked]), pa.array([len(x) for x in each], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                yield pa.record_batch(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    need = blocks.select("doc_ids", "starts", "shard_start", "base", "data")
    return need.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)
