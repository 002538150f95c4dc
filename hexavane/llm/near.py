"""Near-duplicate documents: MinHash with tensored banding, exact confirmation, connected components.

Two small collections of band keys are computed, ``tables`` keys of ``rows`` minhashes each on the left and on the right.
A table key is a pair of one left and one right key, so 2 * tables * rows minhashes stand for tables ** 2 tables of
2 * rows minhashes. Two sets of similarity s share a table key with probability (1 - (1 - s ** rows) ** tables) ** 2:
99.995 % at s = 0.8 with 20 keys of 4, and 53 %, 16 % and 2 % at 0.5, 0.4 and 0.3.

Texts with equal sets are collapsed first. Nothing is joined on a table key: of each key the smallest member is its hub, and
keys of one hub count as one, with the members of all of them, as near copies share a hundred keys and few hubs. Each text is
compared with one hub, the smallest it has, on the full sets; what is confirmed is closed to classes. Of the hubs, only those
whose members lie in more than one class are gone through once more: members of different classes are compared, by a prefix
filter and on the full sets. Classes that such hubs connect form a group, in which each text is once; a group beyond ``GROUP``
blocks is taken apart again into one for each set of classes that hubs have, as such groups may span the corpus. Work that exceeds ``block_shingles`` is cut into blocks, and pairs of blocks into units, so no
task holds an unbounded group and no link is lost. Tables that are joined by a key that many rows may have are written before,
so that Spark can split that key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .components import components, roots
from .runs import sorted_runs
from .scratch import materialize
from .words import SPACED, mix, shingle_sets, slices, words_of

_SEED = 7_919
PIECE = 1 << 20
#: Blocks up to which connected classes are one group.
GROUP = 8


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(_SEED))
    return rng.integers(0, 2**63, count, dtype=np.uint64), rng.integers(0, 2**63, count, dtype=np.uint64) | np.uint64(1)


def fingerprint(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    total = mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(total.view(np.int64)[0])


def band_keys(shingles: np.ndarray, tables: int, rows: int, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    """2 * tables keys, left ones first."""
    low = np.full(len(xor), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        low = np.minimum(low, ((shingles[at : at + 512, None] ^ xor) * times).min(axis=0))
    keys = low.reshape(2 * tables, rows)
    out = np.arange(2 * tables, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, r])
    return out.view(np.int64)


def sketches(docs: DataFrame, *, width: int = 5, tables: int = 20, rows: int = 4, doc_id: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """doc_id, place (the value of ``order``), n_shingles, fp (fingerprint of the set), keys. Sets of no shingle have neither fp
    nor keys."""
    xor, times = _functions(2 * tables * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            sizes, prints, keys = [], [], []
            for s in shingle_sets(words_of(piece.column(2), SPACED), width):
                sizes.append(len(s))
                prints.append(fingerprint(s) if len(s) else None)
                keys.append(band_keys(s, tables, rows, xor, times) if len(s) else None)
            arrays = [piece.column(0), piece.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(arrays, ["doc_id", "place", "n_shingles", "fp", "keys"])

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(order or doc_id).cast("bigint").alias("place"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, place bigint, n_shingles bigint, fp bigint, keys array<bigint>")


def hub_members(nodes: DataFrame, tables: int) -> DataFrame:
    """hub, fp, n, hub_n, size: each node with the smallest members, itself included, of the table keys that it shares, and how
    many nodes the largest of these keys has. Two nodes that share a key have its hub in common.

    A pair shares a table key exactly if it shares a left and a right key, so keys that only one node has are dropped
    before pairs are formed: almost all nodes end here. The rest is dealt out by table key once; a key's rows meet in one
    task, three numbers each, which spills.
    """
    keys = nodes.select("fp", "n_shingles", F.posexplode("keys").alias("side", "key"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    kept = keys.join(shared.hint("merge"), "key", "left_semi").groupBy("fp").agg(
        F.first("n_shingles").alias("n"),
        F.collect_list(F.when(F.col("side") < tables, F.col("key"))).alias("left"),
        F.collect_list(F.when(F.col("side") >= tables, F.col("key"))).alias("right"),
    )
    kept = materialize(kept.where((F.size("left") > 0) & (F.size("right") > 0)), "kept")
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))
    table_keys = kept.select("fp", "n", F.explode(pairs).alias("key"))
    every = Window.partitionBy("key")
    known = table_keys.select("fp", "n", F.min(F.struct("fp", "n")).over(every).alias("first"), F.count("*").over(every).alias("size")).where("size > 1")
    return known.groupBy(F.col("first.fp").alias("hub"), "fp").agg(F.first("n").alias("n"), F.first("first.n").alias("hub_n"), F.max("size").alias("size"))


def set_table(docs: DataFrame, wanted: DataFrame, *, width: int, doc_id: str, text: str) -> DataFrame:
    """fp, n, shingles for the nodes ``wanted`` (fp, rep), from their texts."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).alias("text")).join(wanted.hint("merge"), "rep").select("fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            got = list(shingle_sets(words_of(piece.column(1), SPACED), width))
            same = pa.array([len(s) > 0 and fingerprint(s) == want for s, want in zip(got, piece.column(0).to_pylist(), strict=True)])
            yield pa.record_batch([piece.column(0), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["fp", "n", "shingles"]).filter(same)

    return texts.mapInArrow(sets, "fp bigint, n bigint, shingles binary").dropDuplicates(["fp"])


def alike(both: int, one: int, two: int, percent: int) -> bool:
    return 100 * both >= percent * (one + two - both)


def own_hubs(members: DataFrame) -> DataFrame:
    """fp, n, hub, hub_n: each node that is not the smallest under all of its keys, with the smallest of its hubs."""
    one = members.where("fp != hub").groupBy("fp").agg(F.first("n").alias("n"), F.min(F.struct("hub", "hub_n")).alias("h"))
    return one.select("fp", "n", F.col("h.hub").alias("hub"), F.col("h.hub_n").alias("hub_n"))


def hub_links(own: DataFrame, sets: DataFrame, *, percent: int, block_shingles: int) -> DataFrame:
    """(u, v): each node with its one hub, a smaller node, if the full sets are alike. A hub's set goes to as many units as its members fill,
    and stays while they stream past."""
    one = own.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    hubs = materialize(one.groupBy("hub").agg(F.ceil(4 * F.sum("n") / F.lit(block_shingles)).cast("int").alias("units")), "hubs")
    rows = one.join(hubs.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("fp", F.lit(11)), "units").cast("int").alias("unit"), F.lit(1).alias("role"), "fp")
    rows = rows.unionByName(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.lit(0).alias("role"), F.col("hub").alias("fp")))
    work = rows.join(sets.select("fp", "shingles").hint("merge"), "fp").select("hub", "unit", "role", "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            u, v = [], []
            for hub, role, fp, data in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if role == 0:
                    now, own = hub, s
                    continue
                if hub != now:
                    raise ValueError("a member came without its hub")
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                if alike(int((own[at] == s).sum()), len(own), len(s), percent):
                    u.append(fp)
                    v.append(hub)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return work.repartition("hub", "unit").sortWithinPartitions("hub", "unit", "role").mapInArrow(run, "u bigint, v bigint")


class Forest:
    """Disjoint sets with all labels at hand as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        return True


def exact_links(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all pairs with 100 * intersection >= percent * union; ``known`` gives the same number to sets that
    are in one tree already.

    Prefix filter: with tokens in one order, rarest first, two sets of similarity t share a token among the first
    n - ceil(t * n) + 1 of each. Candidates in one tree already are passed over; the rest is counted on the whole sets.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    token, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count))
    rank = np.empty(len(token), np.int64)
    rank[order] = np.arange(len(token))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = rank[code]
    rare = count[order]
    need = -(-percent * sizes // 100)
    owner, item = [], []
    prefixes = []
    for i in range(n):
        own = np.sort(codes[begin[i] : begin[i + 1]])
        codes[begin[i] : begin[i + 1]] = own
        prefix = own[: sizes[i] - need[i] + 1]
        prefix = prefix[rare[prefix] > 1]
        prefixes.append(prefix)
        owner.append(np.full(len(prefix), i))
        item.append(prefix)
    item_all, owner_all = np.concatenate(item), np.concatenate(owner)
    order = np.argsort(item_all, kind="stable")
    item_all, owner_all = item_all[order], owner_all[order]
    mark, forest, links = np.zeros(len(token), bool), Forest(n), []
    at: dict[int, int] = {}
    for i, k in enumerate(known or ()):
        forest.join(at.setdefault(k, i), i)
    for i in range(n):
        p = prefixes[i]
        if not len(p):
            continue
        spans = [owner_all[a:b] for a, b in zip(np.searchsorted(item_all, p, "left"), np.searchsorted(item_all, p, "right"), strict=True)]
        near = np.unique(np.concatenate(spans))
        near = near[(near < i) & (forest.label[near] != forest.label[i])]
        near = near[(100 * sizes[near] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[near])]
        if not len(near):
            continue
        mark[codes[begin[i] : begin[i + 1]]] = True
        for a in range(0, len(near), 256):
            part = near[a : a + 256]
            part = part[forest.label[part] != forest.label[i]]
            if not len(part):
                continue
            flat = mark[np.concatenate([codes[begin[j] : begin[j + 1]] for j in part])]
            both = np.add.reduceat(flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            for j in part[100 * both >= percent * (sizes[part] + sizes[i] - both)].tolist():
                if forest.join(i, j):
                    links.append((i, j))
        mark[codes[begin[i] : begin[i + 1]]] = False
    return links


def open_groups(members: DataFrame, own: DataFrame, classes: DataFrame, block_shingles: int) -> DataFrame | None:
    """(grp, fp, label, n): members of the hubs that hold more than one class; None if there are none. A member that was compared
    with its hub already, and is under no key of theirs with a third, is left out there."""
    named = members.join(classes.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    met = own.select("fp", F.col("hub").alias("met"))
    named = named.join(met.hint("merge"), "fp", "left").where("fp = hub OR met != hub OR size > 2")
    named = materialize(named.select("hub", "fp", "n", F.coalesce("label", "fp").alias("label")), "named")
    open_ = named.groupBy("hub").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    open_ = materialize(open_.where("a != b").select("hub", "a"), "open")
    if open_.isEmpty():
        return None
    named = materialize(named.join(open_.hint("merge"), "hub").select("hub", "fp", "n", "label", "a"), "unsettled")
    tied = components(named.select(F.col("label").alias("u"), F.col("a").alias("v")))
    tied = materialize(tied.select(F.col("node").alias("label"), F.col("label").alias("grp")), "tied")
    texts = named.groupBy("fp").agg(F.first("label").alias("label"), F.first("n").alias("n")).join(tied.hint("merge"), "label")
    texts = materialize(texts.select("grp", "fp", "label", "n"), "texts")
    large = materialize(texts.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP * block_shingles).select("grp"), "large")
    if large.isEmpty():
        return texts
    small = texts.join(large.hint("merge"), "grp", "left_anti").select("grp", "fp", "label", "n")
    wide = tied.join(large.hint("merge"), "grp", "left_semi").select("label")
    apart = materialize(named.join(materialize(wide, "wide").hint("merge"), "label", "left_semi").select("hub", "fp", "n", "label"), "apart")
    kinds = apart.groupBy("hub", "label").agg(F.lit(1).alias("one")).groupBy("hub").agg(F.count("*").alias("c"), F.min("label").alias("a"), F.bit_xor(F.xxhash64("label")).alias("x"))
    kinds = materialize(kinds.select("hub", F.xxhash64("c", "a", "x").alias("grp")), "kinds")
    rest = apart.join(kinds.hint("merge"), "hub").groupBy("grp", "fp").agg(F.first("label").alias("label"), F.first("n").alias("n"))
    return materialize(small.unionByName(rest.select("grp", "fp", "label", "n")), "groups")


def class_links(groups: DataFrame, sets: DataFrame, *, percent: int, block_shingles: int) -> DataFrame:
    """(u, v): classes (labels) that have a pair of alike members in a group. A class that fills half a block has blocks of
    its own; smaller ones share blocks. All pairs of blocks of a group are units, but those of one class."""
    half = max(1, block_shingles // 2)
    by_class = groups.groupBy("grp", "label").agg(F.ceil(F.sum("n") / F.lit(half)).cast("int").alias("parts"), F.sum("n").alias("total"))
    alone = F.col("parts") > 1
    rest = by_class.groupBy("grp").agg(F.greatest(F.ceil(F.sum(F.when(~alone, F.col("total")).otherwise(0)) / F.lit(half)), F.lit(1)).cast("int").alias("shared"))
    plan = materialize(by_class.join(rest, "grp").select("grp", "label", "parts", "shared"), "classes")
    place = F.when(alone, F.xxhash64("label", F.pmod(F.xxhash64("fp", F.lit(13)), "parts"))).otherwise(F.pmod(F.xxhash64("label", F.lit(17)), "shared"))
    dealt = groups.join(plan.hint("merge"), ["grp", "label"]).select("grp", "fp", "label", place.alias("block"), F.when(alone, F.col("label")).alias("own"))
    dealt = materialize(dealt, "dealt")
    blocks = materialize(dealt.groupBy("grp", "block").agg(F.first("own").alias("own")), "blocks")
    other = blocks.select("grp", F.col("block").alias("two"), F.col("own").alias("own2"))
    units = blocks.withColumnRenamed("block", "one").join(other, "grp").where("one <= two AND (own IS NULL OR own2 IS NULL OR own != own2)").select("grp", "one", "two")
    ends = units.select("grp", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"), "one", "two")
    ends = materialize(ends, "units")
    work = dealt.join(ends.hint("merge"), ["grp", "block"]).select("grp", "one", "two", "label", "fp")
    work = work.join(sets.select("fp", "shingles").hint("merge"), "fp").select("grp", "one", "two", "label", "fp", "shingles")

    def link(_: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        prints, labels, data = (table[c].to_pylist() for c in ("fp", "label", "shingles"))
        order = sorted(range(len(prints)), key=prints.__getitem__)
        labels = [labels[i] for i in order]
        links = exact_links([np.frombuffer(data[i], np.uint64) for i in order], percent, labels)
        if links:
            yield pa.record_batch([pa.array([labels[i] for i, _ in links], pa.int64()), pa.array([labels[j] for _, j in links], pa.int64())], ["u", "v"])

    return sorted_runs(work, ["grp", "one", "two"], link, "u bigint, v bigint")


def classes_of(docs: DataFrame, sk: DataFrame, *, width: int, percent: int, tables: int, block_shingles: int, doc_id: str, text: str) -> DataFrame:
    """(fp, label): the class of each set that is linked with another one."""
    nodes = materialize(sk.where("doc_id IS NOT NULL AND fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "nodes")
    members = materialize(hub_members(nodes, tables), "members")
    wanted = materialize(nodes.select("fp", "rep").join(members.select("fp").distinct(), "fp", "left_semi"), "wanted")
    sets = materialize(set_table(docs, wanted, width=width, doc_id=doc_id, text=text), "sets")
    own = materialize(own_hubs(members), "own")
    first = materialize(roots(hub_links(own, sets, percent=percent, block_shingles=block_shingles)), "classes")
    groups = open_groups(members, own, first, block_shingles)
    if groups is None:
        return first.select(F.col("node").alias("fp"), "label")
    second = materialize(components(class_links(groups, sets, percent=percent, block_shingles=block_shingles)), "classes")
    second = second.select(F.col("node").alias("label"), F.col("label").alias("whole"))
    # a class of one text has no row in the first table
    single = second.join(first.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("fp"), F.col("whole").alias("label"))
    joined = first.join(second.hint("merge"), "label", "left").select(F.col("node").alias("fp"), F.coalesce("whole", "label").alias("label"))
    return joined.unionByName(single)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, tables: int = 20, rows: int = 4, block_shingles: int = 400_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    A document's set: its distinct shingles of ``width`` words (runs without ASCII white space, A-Z lowered), or its whole
    word sequence if shorter. Two documents link if 100 * intersection >= percent * union. component_id is the smallest
    doc_id that links reach. Null and wordless texts link with nothing: their own component, kept. Rows without a doc_id
    take no part: component null, kept. Rows that repeat a doc_id share its component. An empty table gives no rows; other
    columns are ignored, whatever their names. A long text's set is one row of 8 bytes a shingle.
    """
    ship(docs.sparkSession)
    sk = materialize(sketches(docs, width=width, tables=tables, rows=rows, doc_id=doc_id, text=text), "sketches")
    named = _named(docs, sk, width=width, percent=percent, tables=tables, block_shingles=block_shingles, doc_id=doc_id, text=text)
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("first.doc_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _named(docs: DataFrame, sk: DataFrame, **how) -> DataFrame:
    """Rows of ``sk`` with ``first``, the first of their class by place, then by doc_id."""
    order = F.min(F.struct(F.col("place").isNull().alias("none"), "place", "doc_id"))
    firsts = materialize(sk.where("doc_id IS NOT NULL AND fp IS NOT NULL").groupBy("fp").agg(order.alias("first")), "firsts")
    classes = materialize(classes_of(docs, sk, **how), "classes")
    by_class = materialize(classes.join(firsts.hint("merge"), "fp").groupBy("label").agg(F.min("first").alias("whole")), "wholes")
    linked = classes.join(by_class.hint("merge"), "label").select("fp", "whole")
    firsts = materialize(firsts.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("whole", "first").alias("first")), "firsts")
    return sk.select("doc_id", "n_shingles", "fp").join(firsts.hint("merge"), "fp", "left")


def one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80, tables: int = 20, rows: int = 4, block_shingles: int = 400_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each class of linked texts the row of the smallest doc_id
    stays, nulls last, of equal ids the one of the smallest hash of the row.

    Rows count by what they hold, not by id: different texts under one id are told apart, and rows without an id take part.
    Rows that are equal in all columns are one. Other rows without words all stay. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    key = "_" + max(docs.columns, key=len) + "_row"  # longer than any name there is
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    sk = materialize(sketches(keyed, width=width, tables=tables, rows=rows, doc_id=key, text=text, order=doc_id), "sketches")
    named = _named(keyed, sk, width=width, percent=percent, tables=tables, block_shingles=block_shingles, doc_id=key, text=text)
    stay = materialize(named.where("fp IS NULL OR first.doc_id = doc_id").select(F.col("doc_id").alias(key)).distinct(), "stay")
    return keyed.join(stay.hint("merge"), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
