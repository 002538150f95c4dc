"""How many planted pairs near the threshold the tensored bands find, and how few pairs far below it they tie."""

import random

import numpy as np
import pytest
from test_llm import plain_near

from hexavane.llm import near


def shared(similarity, pairs, tables=20, rows=4, size=90):
    """Share of pairs of sets of this similarity with a left and a right key in common."""
    rng = np.random.default_rng(int(1000 * similarity))
    xor, times = near._functions(2 * tables * rows)
    both = round(similarity * size)
    found = 0
    for _ in range(pairs):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        cut = both + (size - both) // 2
        a, b = x[:cut], np.concatenate([x[:both], x[cut:]])
        same = near.band_keys(a, tables, rows, xor, times) == near.band_keys(b, tables, rows, xor, times)
        found += same[:tables].any() and same[tables:].any()
    return found / pairs


def test_bands():
    assert shared(0.8, 3000) >= 0.999 and shared(0.85, 3000) >= 0.9995
    assert shared(0.5, 1000) < 0.6 and shared(0.3, 1000) < 0.05


def text_of(rng, n=60):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_planted_pairs_are_linked(spark):
    """Pairs of texts at 0.80 to 0.85, each with words of its own at the end."""
    rng, rows = random.Random(3), []
    for i in range(250):
        base = text_of(rng, 103)
        other = base[: rng.randint(91, 96)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other + text_of(rng, 103 - len(other))))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, width=4).collect()}
    want = {i: c for i, (_, c, _) in plain_near_pairs(rows).items()}
    linked = [i for i, c in want.items() if c != i]
    assert 50 < len(linked) < 250 and got == want


def plain_near_pairs(rows):
    """``plain_near`` for rows that only link in pairs 2k, 2k + 1."""
    out = {}
    for k in range(0, len(rows), 2):
        out |= plain_near(rows[k : k + 2], 4, 80)
    return out


@pytest.mark.parametrize("block", [400_000, 300])
def test_no_component_of_unlike_texts(spark, block):
    """150 texts that share half of their words with each other: none links, though many share keys."""
    rng = random.Random(5)
    common = text_of(rng, 60)
    rows = [(i, " ".join(common + text_of(rng, 25))) for i in range(150)] + [(500 + i, " ".join(common + ["tail", str(i)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, width=4, block_shingles=block).collect()}
    assert got == {i: i for i in range(150)} | {500 + i: 500 for i in range(60)}


def test_chain_of_copies(spark):
    """Each text is like the next only, so links are found beyond any hub."""
    rng = random.Random(6)
    words = text_of(rng, 400)
    rows = [(i, " ".join(words[9 * i : 9 * i + 110])) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, width=4, tables=40).collect()}
    assert got == {i: 0 for i in range(30)}


def test_rows_of_a_large_group(spark, monkeypatch):
    """Near copies of one text, each with three words of its own: no table on the way has a row for each key that they share."""
    rng = random.Random(7)
    base, n = text_of(rng, 120), 300
    rows = [(i, " ".join(f"own{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(base))) for i in range(n) for at in [set(rng.sample(range(120), 3))]]
    df, tables = spark.createDataFrame(rows, "doc_id bigint, text string"), {}

    def counted(out, name, write=near.materialize):
        out = write(out, name)
        tables[name] = max(out.count(), tables.get(name, 0))
        return out

    monkeypatch.setattr(near, "materialize", counted)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(df, width=4).collect()}
    assert got == {i: c for i, (_, c, _) in plain_near(rows, 4, 80).items()}
    assert max(tables.values()) <= 30 * n, tables


def test_keys_lead_to_a_hub_in_common(spark):
    """Of every two nodes that share a left and a right key, both are members of one hub at least."""
    rng = random.Random(8)
    base = text_of(rng, 80)
    rows = [(i, " ".join(f"own{rng.randrange(10**9)}" if rng.random() < 0.05 else w for w in base)) for i in range(80)]
    sk = near.sketches(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()
    keys = {r["fp"]: (set(r["keys"][:20]), set(r["keys"][20:])) for r in sk}
    nodes = spark.createDataFrame([(r["fp"], r["n_shingles"], r["keys"]) for r in sk], "fp bigint, n_shingles bigint, keys array<bigint>")
    members = near.hub_members(nodes, 20).collect()
    hubs = {f: {r["hub"] for r in members if r["fp"] == f} for f in keys}
    pairs = [(f, g) for f in keys for g in keys if f < g and keys[f][0] & keys[g][0] and keys[f][1] & keys[g][1]]
    assert len(pairs) > 500 and all(hubs[f] & hubs[g] for f, g in pairs)
    assert all(r["hub"] <= r["fp"] and r["size"] > 1 for r in members)
