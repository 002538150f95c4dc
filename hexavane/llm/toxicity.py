"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all hashed into one table; a
text's vector is the mean over its words, times a fixed scale. A softmax layer over two classes sits on it. Table and layer are trained together
by Adam on log loss. A misspelling that training never saw shares most of its n-grams, so it lands near its source.

After training, the model is linear in the mean, so scoring needs one number for each distinct word of a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .tokens import spread
from .words import cuts, give_back

#: Trimmed from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„’‘«»¿¡–—"
PIECE = 2 << 20


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that train, and ``sample_bytes`` the bytes of their texts; half of either at most is
    from one class."""

    sample: int = 4800
    sample_bytes: int = 48 << 20
    buckets: int = 1 << 17
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    scale: float = 60.0
    epochs: int = 16
    batch: int = 128
    rate: float = 0.03
    decay: float = 1e-3
    damping: float = 1e-3
    clean_weight: float = 2.0
    rare: int = 3
    seed: int = 5


def subwords(word: str, s: Settings) -> list[int]:
    """Buckets of the n-grams of ``<word>`` and of the whole."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(w) - n + 1)}
    return sorted(zlib.crc32(g.encode("utf-8", "surrogatepass")) % s.buckets for g in grams)


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch of texts, the code of every word in order, and the n + 1 offsets of the texts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = pc.utf8_trim(lists.flatten(), characters=EDGES).dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    codes, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    some = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
    keep = some[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return distinct, codes[keep], before[offsets - offsets[0]]


@dataclass
class Bags:
    """Sparse rows, in few large arrays, one of each kind a batch: for each text its buckets and their weights, which sum to 1."""

    bucket: list = field(default_factory=list)
    weight: list = field(default_factory=list)
    size: list = field(default_factory=list)

    def add(self, texts: pa.Array, s: Settings) -> None:
        distinct, codes, at = text_words(texts)
        grams = [np.array(subwords(w, s), np.int32) for w in distinct.to_pylist()]
        buckets, weights, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own, counts = np.unique(codes[a:b], return_counts=True)
            if not len(own):
                sizes.append(0)
                continue
            ids = np.concatenate([grams[i] for i in own])
            w = np.concatenate([np.full(len(grams[i]), c / len(grams[i])) for i, c in zip(own, counts, strict=True)])
            ids, where = np.unique(ids, return_inverse=True)
            buckets.append(ids)
            weights.append((np.bincount(where, w) / (b - a)).astype(np.float32))
            sizes.append(len(ids))
        self.size.append(np.array(sizes, np.int64))
        self.bucket.append(np.concatenate(buckets))
        self.weight.append(np.concatenate(weights))

    def take(self, buckets: int, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mask of the buckets that ``rare`` texts or more have, and bucket, weight and size of those alone. Nothing is kept
        here, and there is never a second copy of the whole."""
        seen = np.zeros(buckets, np.int64)
        for ids in self.bucket:
            seen += np.bincount(ids, minlength=buckets)
        usual = seen >= rare
        for i, ids in enumerate(self.bucket):
            kept, ends = usual[ids], np.cumsum(self.size[i])
            before = np.concatenate([[0], np.cumsum(kept)])
            self.size[i] = before[ends] - before[ends - self.size[i]]
            self.bucket[i], self.weight[i] = ids[kept], self.weight[i][kept]
        out = []
        for chunks, kind in ((self.bucket, np.int32), (self.weight, np.float32), (self.size, np.int64)):
            out.append(np.concatenate([np.zeros(0, kind), *chunks]))
            chunks.clear()
        return usual, *out


@dataclass
class Model:
    settings: Settings
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What a unit of each bucket adds to the log odds of class 1."""
        return (self.settings.scale * self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(bags: Bags, labels: np.ndarray, s: Settings) -> Model:
    """Fit table and layer. In total class 0 weighs ``clean_weight`` times class 1; buckets in fewer than ``rare`` rows are
    left out, as what only a row or two has says nothing of others. No rows, or one class only, give the prior alone."""
    rng = np.random.Generator(np.random.PCG64(s.seed))
    table = rng.normal(0, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32) * 0.1
    layer, bias = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    n, ones = len(labels), int(labels.sum())
    if not n or ones in (0, n):
        side = 0.0 if not n else (4.0 if ones else -4.0)
        return Model(s, table * 0, layer, np.array([0, side if n else -4.0], np.float32))
    weight = np.where(labels == 1, n / ones, s.clean_weight * n / (n - ones)) / (1 + s.clean_weight)
    weight = weight.astype(np.float32)
    usual, bucket, share, size = bags.take(s.buckets, s.rare)
    table[~usual] = 0
    begin = np.cumsum(size) - size
    params = [table, layer, bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(n)
        rate = s.rate * (1 - epoch / s.epochs)
        for at in range(0, n, s.batch):
            rows = order[at : at + s.batch]
            at_ = spread(begin[rows], size[rows])
            ids, val = bucket[at_], share[at_] * np.float32(s.scale)
            who = np.repeat(np.arange(len(rows)), size[rows])
            hidden = np.stack([np.bincount(who, val * table[ids, k], len(rows)) for k in range(s.dim)], 1).astype(np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= (weight[rows] / len(rows))[:, None]
            back = p @ layer.T
            grads = [np.stack([np.bincount(ids, val * back[who, k], s.buckets) for k in range(s.dim)], 1).astype(np.float32), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + s.damping) + s.decay * q)
    return Model(s, table, layer, bias)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 is held out. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, s: Settings, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a sample of labelled rows outside the held-out fold: the first of each class by a hash of the id, as many as
    ``settings.sample`` rows and ``settings.sample_bytes`` bytes of text allow, and no other, so what comes to the driver is
    bounded in both.

    Of repeated labels of a document the larger counts; null labels are left out. Of texts that repeat an id the smallest
    counts; null texts train as empty ones.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    place = [F.xxhash64("__id"), F.col("__id")]
    each = [known.where(F.col("__label") == y).orderBy(*place).limit(s.sample // 2) for y in (0, 1)]
    picked = each[0].unionByName(each[1])
    texts = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = texts.join(F.broadcast(picked), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    so_far = F.sum(F.octet_length("__text")).over(Window.partitionBy("__label").orderBy(*place))  # over the sample alone
    rows = rows.withColumn("__bytes", so_far).where(F.col("__bytes") <= s.sample_bytes // 2)
    bags, ys = Bags(), []
    got = rows.select("__id", "__label", "__text").toArrow().sort_by("__id")
    for batch in got.to_batches(max_chunksize=200):
        bags.add(batch.column(2), s)
        ys += batch.column(1).to_pylist()
    got = batch = None
    model = train(bags, np.array(ys, np.int64), s)
    give_back()
    return model


def probability(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: the probability of class 1. A null text or one without words gets that of the bias.

    Only the texts go to Python and only numbers come back; the rows stay where they are.
    """
    ship(spark)
    s = model.settings
    sent = spark.sparkContext.broadcast((model.bucket_scores(), model.offset()))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, offset = sent.value
        known: dict[str, float] = {}

        def odds(texts: pa.Array) -> np.ndarray:
            distinct, codes, at = text_words(texts)
            if len(known) > 300_000:
                known.clear()
            value = np.empty(len(distinct))
            for i, w in enumerate(distinct.to_pylist()):
                v = known.get(w)
                if v is None:
                    v = known[w] = float(buckets[subwords(w, s)].mean())
                value[i] = v
            total = np.concatenate([[0.0], np.cumsum(value[codes])]) if len(codes) else np.zeros(1)
            return offset + np.diff(total[at]) / np.maximum(np.diff(at), 1)

        for texts in columns:
            log_odds = np.concatenate([np.zeros(0), *(odds(texts.slice(a, b - a)) for a, b in cuts(texts, PIECE))])
            yield pa.array(1 / (1 + np.exp(-np.clip(log_odds, -500, 500))), pa.float64())
        known.clear()
        give_back()

    return F.arrow_udf(run, "double")


def toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Labels, language, source and ids are no inputs of a score. Null, empty and wordless texts get the score of the bias; rows
    without doc_id are held out; repeated rows stay, equal texts score the same; long texts are scored whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, settings or Settings(), doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), probability(docs.sparkSession, model)(F.col(text)).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
