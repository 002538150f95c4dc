"""Mixing sources to target weights by pivotal dependent rounding.

Each document has an expected number of copies, target / source_size; its whole part is certain, its fraction is rounded by
the pivotal method: of two fractional units, words move at random from one to the other until one is integral. What one gains
in words the other loses, so the words that a source gives never change, and either fraction stays as it is on average.

The documents of a source are dealt to buckets. In a bucket they come by falling size, and each is paired with the pool of all
that are smaller, which share one fraction: the document becomes integral, and the pool takes the difference. So a long
document is settled while there are many to make up for it, and the one that is left fractional is the smallest, unless a
single one outweighs its pool. What buckets leave, one document each, meets ``fan_in`` at a time in a tree, in pairs, up to
one for each source, whose rounding is all by which a source misses its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import materialize
from .words import SPACED, count_words, slices

MOST_COPIES = 3
PIECE = 2 << 20


def sizes(docs: DataFrame, *, carry: bool = False, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source and size, the number of words (runs without ASCII white space; 0 for null); with ``carry`` also row,
    a struct of all columns, which no name can clash with."""
    ship(docs.sparkSession)
    names = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source")]
    picked = docs.select(*names, *([F.struct(*docs.columns).alias("row")] if carry else []), F.col(text).alias("text"))
    schema = picked.drop("text").withColumn("size", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            n = pa.array(count_words(piece.column(piece.num_columns - 1), SPACED), pa.int64())
            yield piece.select(range(piece.num_columns - 1)).append_column("size", n)

    return picked.mapInArrow(run, schema)


def targets(sized: DataFrame, *, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, docs, weight, target for each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share all words by weight and stop at ``most`` times
    a source's size, the excess going to the others by weight: the level at which that settles is found by ordering sources
    by most * size / weight, since the stopped ones are always the first of that order. One row for each source is handled.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left / share)
    stopped = F.col("cap") <= F.col("level") * F.col("weight")
    settled = level.withColumn("stopped", stopped).withColumn("common", F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")))
    return settled.select("source", "source_size", "docs", "weight", target.alias("target"))


def pivot(one: float, two: float, size_one: float, size_two: float, draw: float) -> tuple[float, float]:
    """Move words between two fractions so that one becomes 0 or 1; the sum of words stays, and so do expectations."""
    up, down = min(1 - one, two * size_two / size_one), min(one, (1 - two) * size_two / size_one)
    if draw * (up + down) < down:
        return (1.0, max(0.0, two - up * size_one / size_two)) if up == 1 - one else (one + up, 0.0)
    return (0.0, min(1.0, two + down * size_one / size_two)) if down == one else (one - down, 1.0)


def settle(words: int, fraction: float, rest: int, draw: float) -> tuple[float, float]:
    """A document of so many words and the pool of ``rest`` words, both of this fraction: fractions of the document and of the
    pool after words have moved until one of them is integral."""
    up, down = min(1 - fraction, fraction * rest / words), min(fraction, (1 - fraction) * rest / words)
    if draw * (up + down) < down:
        return (1.0, max(0.0, fraction - up * words / rest)) if up == 1 - fraction else (fraction + up, 0.0)
    return (0.0, min(1.0, fraction + down * words / rest)) if down == fraction else (fraction - down, 1.0)


def _buckets(fractions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first level: every bucket in a stream, largest document first. All rows of a bucket have one fraction. Nothing is
    held but the pool's words and fraction; at most one row a bucket keeps a fraction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, pool = None, 0, 0.0
        for batch in batches:
            value = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*keys, "size", "words", "fraction", "draw"]}
            done = []
            for i, size in enumerate(value["size"]):
                key = tuple(value[k][i] for k in keys)
                if key != now:
                    now, rest, pool = key, value["words"][i], value["fraction"][i]
                rest -= max(size, 1)
                mine = pool
                if 0 < pool < 1 and rest > 0:
                    mine, pool = settle(max(size, 1), pool, rest, value["draw"][i])
                done.append(mine)
            out = _set(batch, done)
            yield out.select([c for c in out.schema.names if c != "words"])

    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = fractions.withColumn("words", F.sum(F.greatest("size", F.lit(1))).over(rows)).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, fractions.schema)


def _level(fractions: DataFrame, keys: list[str], order: list, last: bool) -> DataFrame:
    """One level of the tree, in pairs: fractions within a group are rounded in a stream; at most one row a group keeps a fraction,
    and at the last level that one is rounded too. Only that row is held from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        mass, now, words = 0.0, None, 1  # words: size of the open row

        def close() -> pa.RecordBatch:
            draw = held.column(held.schema.get_field_index("draw"))[0].as_py()
            out = (1.0 if draw < mass else 0.0) if last else mass
            return _set(held, [out])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            got = batch.column(batch.schema.get_field_index("fraction")).to_pylist()
            draws = batch.column(batch.schema.get_field_index("draw")).to_pylist()
            size = [max(x, 1) for x in batch.column(batch.schema.get_field_index("size")).to_pylist()]
            place, done = None, list(got)  # place: row of this batch that holds the open mass
            for i, (f, draw) in enumerate(zip(got, draws, strict=True)):
                key = tuple(n[i] for n in names)
                if key != now:
                    if held is not None:
                        yield close()
                        held = None
                    elif place is not None:
                        done[place] = (1.0 if draws[place] < mass else 0.0) if last else mass
                    place, now, mass = None, key, 0.0
                if not 0 < f < 1:
                    continue
                if held is None and place is None:
                    place, mass, words = i, f, size[i]
                    continue
                old, new = pivot(mass, f, words, size[i], draw)
                if 0 < old < 1:  # the older row stays open
                    mass, done[i] = old, new
                    continue
                if held is not None:
                    yield _set(held, [old])
                    held = None
                else:
                    done[place] = old
                place, mass, words = (i, new, size[i]) if 0 < new < 1 else (None, 0.0, 1)
                done[i] = new
            if place is not None:
                yield _set(batch.slice(0, place), done[:place])
                held = batch.slice(place, 1)
                yield _set(batch.slice(place + 1), done[place + 1 :])
            else:
                yield _set(batch, done)
        if held is not None:
            yield close()

    dealt = fractions.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, fractions.schema)


def _set(batch: pa.RecordBatch, fraction: list[float]) -> pa.RecordBatch:
    at = batch.schema.get_field_index("fraction")
    return batch.set_column(at, "fraction", pa.array(fraction, pa.float64()))


def mix(
    sized: DataFrame, *, most: int = MOST_COPIES, bucket_rows: int = 4096, fan_in: int = 16, seed: int = 17, per_source: DataFrame | None = None
) -> DataFrame:
    """All columns of ``sized`` (the result of ``sizes``) with source_size, target, copies and taken, one row each.

    copies is 0 to ``most``; taken = copies * size. Draws come from a hash of doc_id, row and seed, and buckets from counts and
    hashes, so the result hangs neither on partitions nor on the run; rows of equal size and id are told apart by their hash,
    if they are carried along, and else are all the same. Null sources are one source, last in order. Documents without words
    are rounded as if they had one and take 0 words; a source of no words takes none. Repeated rows are rounded one by one;
    rows without doc_id count as any other. An empty table gives no rows.
    """
    ship(sized.sparkSession)
    per = materialize(per_source or targets(sized, most=most), "targets").withColumn("buckets", F.ceil(F.col("docs") / bucket_rows).cast("int"))
    wide = per.select(F.col("source").alias("__source"), "source_size", "target", "buckets")
    joined = sized.join(wide, sized["source"].eqNullSafe(wide["__source"])).drop("__source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    tie = F.xxhash64("row") if "row" in sized.columns else F.lit(0).cast("bigint")
    h = F.xxhash64("doc_id", F.col("tie"), F.lit(seed))
    start = (
        joined.withColumn("expected", F.least(expected, F.lit(float(most))))
        .withColumn("tie", tie)
        .withColumn("fraction", F.col("expected") - F.floor("expected"))
        .withColumn("draw", F.shiftrightunsigned(h, 11) / F.lit(float(2**53)))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.col("tie"), F.lit(seed + 1)), F.col("buckets")).cast("int"))
    )
    order = [F.desc("size"), "doc_id", "tie"]
    now = materialize(_buckets(start, ["source", "bucket"], order), "rounded")
    settled, open_ = [now.where("fraction IN (0.0, 1.0)")], now.where("fraction NOT IN (0.0, 1.0)")
    largest = per.agg(F.max("buckets")).first()[0] or 1
    while largest > 1:
        up = open_.withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("int"))
        now = materialize(_level(up, ["source", "bucket"], order, last=False), "rounded")
        settled.append(now.where("fraction IN (0.0, 1.0)"))
        open_, largest = now.where("fraction NOT IN (0.0, 1.0)"), -(-largest // fan_in)
    settled.append(_level(open_, ["source", "bucket"], order, last=True))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.floor("expected") + F.col("fraction")).cast("bigint")
    own = sized.columns
    return out.withColumn("copies", copies).select(*own, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
