"""Each operator against a plain version, on small tables with every odd row there is."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexavane.llm import contamination, counts, extract, licences, mixing, near, packing, queries, tokens, toxicity, words
from hexavane.llm.components import components, roots

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, source string, row string, score string, size string, bucket string"


def odd_texts(rng):
    vocab = ["the", "Of", "a1", "é", "日本", "x-y", "Zz", "q.", "it's", "B2b", "end"]
    base = [" ".join(rng.choice(vocab) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    near_ = [b.replace(" ", "  ", 1) if rng.random() < 0.5 else b + " tail" for b in base[:25]]
    return [*base, *near_, *base[:5], "", " \n\t ", None, None, "one", "one two", "One TWO", "a\x0bb\x0cc\x1cd", "w " * 5000, " ".join(str(i) for i in range(4000))]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated and null ids and texts, and columns named like the operators' own."""
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["b", "a", "z", None, "ß"]), "r", "s", "9", "b") for i, t in enumerate(odd_texts(rng))]
    rows += [rows[3], rows[3], (None, rows[4][1], "a", "r", "s", "9", "b"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def plain_words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def test_words(docs):
    texts = [r["text"] for r in docs.collect()]
    for kind, pattern in ((words.ALNUM, ALNUM), (words.SPACED, SPACED)):
        got, seen = words.words_of(pa.array(texts, pa.string()), kind), {}
        assert words.count_words(pa.array(texts, pa.string()), kind).tolist() == [len(plain_words(pattern, t)) for t in texts]
        for i, t in enumerate(texts):
            for w, h in zip(plain_words(pattern, t), got.hashes[got.first[i] : got.first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("chunk", [1, 64, 1000])
def test_words_in_pieces(monkeypatch, chunk):
    rng = random.Random(1)
    texts = pa.array([None if rng.random() < 0.1 else "".join(rng.choice("ab C1é日 \n\t.,") for _ in range(rng.randint(0, 200))) for _ in range(300)], pa.string())
    for kind in (words.ALNUM, words.SPACED):
        whole = words.words_of(texts, kind)
        with monkeypatch.context() as m:
            m.setattr(words, "CHUNK", chunk)
            parts, none, some = words.words_of(texts, kind), words.words_of(texts.slice(0, 0), kind), words.words_of(texts.slice(100, 50), kind)
        assert (whole.hashes == parts.hashes).all() and (whole.first == parts.first).all()
        assert len(none) == 0 and none.first.tolist() == [0] and (some.hashes == whole.hashes[whole.first[100] : whole.first[150]]).all()


# -- 1
def plain_contaminated(doc, items, window):
    w, hit, found = plain_words(ALNUM, doc), set(), set()
    for item, text in items:
        v = plain_words(ALNUM, text)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_decontamination(spark, docs, block):
    texts = [r["text"] for r in docs.collect()]
    items = [(i, t) for i, t in enumerate([texts[5], texts[9], texts[9], "", None, "one", "ONE two", "1 2 3", " ".join(str(i) for i in range(50, 65)), "none of it here"])] + [(10, texts[12]), (10, texts[12])]
    bench = spark.createDataFrame([*items, (None, texts[20])], "item_id bigint, text string")
    got = contamination.contaminated(docs, bench, window=10, block_windows=block).collect()
    want = [(r["doc_id"], *plain_contaminated(r["text"], items, 10)) for r in docs.collect()]
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    assert contamination.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def sent(spark, phrase):
    return spark.sparkContext.broadcast(contamination.patterns_of([("7", words.words_of(pa.array([phrase]), words.ALNUM).hashes)], 10))


def plain_loose(texts, phrase, slack):
    """Spans of each text: a start s is good if every term stands somewhere in the text at its place from s on, give or take slack; of
    several places the first from the left is taken."""
    out = []
    for t in texts:
        w, p, spans = t.split(), phrase.split(), set()
        rare = min(range(len(p)), key=lambda k: (sum(x.split().count(p[k]) for x in texts), k))
        for at in [i for i, x in enumerate(w) if x == p[rare]]:
            for start in range(at - rare - slack, at - rare + slack + 1):
                places = [at if k == rare else next((i for i in range(max(0, start + k - slack), min(len(w), start + k + slack + 1)) if w[i] == term), None) for k, term in enumerate(p)]
                if None not in places:
                    spans.add((min(places), max(places) + 1))
        out.append(spans)
    return out


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity_against_plain(spark, slack):
    """All documents in one segment; what is covered is compared."""
    rng = random.Random(slack)
    texts = [" ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for phrase in ("a b c", "d a", "a a b x"):
        got = {r["doc_id"]: {i for s in r["spans"] for i in range(s[0], s[1])} for r in contamination.matches(contamination.build_index(d), sent(spark, phrase), slack=slack).collect()}
        want = {k: {i for a, b in spans for i in range(a, b)} for k, spans in enumerate(plain_loose(texts, phrase, slack))}
        assert got == want


def test_full_index_and_proximity(spark, nothing):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "a x b c"), (3, "c b a")], "doc_id bigint, text string")
    p = sent(spark, "a b c")
    index = contamination.build_index(d)
    exact = {r["doc_id"]: r["items"] for r in contamination.matches(index, p).collect()}
    loose = {r["doc_id"]: r["items"] for r in contamination.matches(index, p, slack=1).collect()}
    assert exact == {1: ["7"], 2: [], 3: []} and loose[2] == ["7"] and loose[3] == []
    assert contamination.contaminated(nothing, d.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_proximity_at_document_edges(spark):
    d = spark.createDataFrame([(1, "b a c a a a"), (2, "a x b"), (3, "c c c"), (4, "x a b"), (5, "a c b")], "doc_id bigint, text string").coalesce(1)
    index, p = contamination.build_index(d), sent(spark, "a b c")
    found = {n: {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in contamination.matches(index, p, slack=n).collect() if r["items"]} for n in (0, 1, 2)}
    assert found == {0: {}, 1: {1: [(0, 3)], 5: [(0, 3)]}, 2: {1: [(0, 3)], 5: [(0, 3)]}}


# -- 2
def test_packing():
    rng = np.random.default_rng(1)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 2**bits, n)
            block = packing.pack(ids, bits)
            assert len(block) == 24 + -(-n * bits // 8)
            assert packing.unpack(block).tolist() == ids.tolist() and packing.unpack(block, 3, 9).tolist() == ids[3:9].tolist()
    with pytest.raises(ValueError):
        packing.pack(np.array([4]), 2)


def test_token_files(spark, docs, nothing, tmp_path):
    definition = queries.tokenizer_definition()
    rng = random.Random(5)
    odd = ["".join(rng.choice("abcXYZéÉß'.,<|>! \n\t0१́日😀_-İ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|> a<|EndOfText|>."]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(every, path, definition, block_tokens=500)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    plain = tokens.ChunkEncoder(definition).tokenizer
    want = collections.Counter((r["doc_id"], tuple([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in every.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))
    assert sorted(r["doc_id"] for r in tokens.read_tokens(spark, path, [3, 1005]).collect()) == [3, 3, 3, 1005]
    tokens.write_tokens(nothing, str(tmp_path / "none"), definition)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


# -- 3
def plain_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = plain_words(SPACED, t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("block", [400_000, 60])
def test_near_duplicates(docs, nothing, block):
    want = plain_near([(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()], 4, 80)
    got = near.near_duplicates(docs, width=4, block_shingles=block).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near.near_duplicates(nothing).count() == 0


def test_exact_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(120)]
    links = near.exact_links(sets, 60)
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    ours = near.Forest(120)
    for i, j in links:
        assert ours.join(i, j)
    assert len(set(label)) == len(set(ours.label.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (50, 20)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in [*range(31), 50]}, 100: 100, 101: 100}


def test_roots(spark):
    parents = [(i, i - 1) for i in range(1, 40)] + [(100, 50), (101, 50), (50, 49)]
    got = {r["node"]: r["label"] for r in roots(spark.createDataFrame(parents, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 49, 101: 49, 50: 49, 49: 49}
    assert roots(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# -- 4
def plain_count(word, pieces, fallback):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * fallback, best[end - 1][1] + size)]
        options += [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(docs, nothing):
    pieces = counts.vocabulary()
    fallback = min(pieces.values()) - 10
    some = docs.where("length(text) < 2000 OR text IS NULL")
    want = [(r["doc_id"], len(w := [x for x in re.split(r"[ \t\n\v\f\r]+", r["text"] or "") if x]), sum(plain_count(counts.MARK + x, pieces, fallback) for x in w)) for r in some.collect()]
    got = [tuple(r) for r in counts.token_counts(some, pieces).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert counts.token_counts(nothing, pieces).count() == 0
    trie = counts.Trie({"a": -1.0})
    trie.count(["abc", "abd", "ab"])
    assert trie.nodes == 4


# -- 5
def test_toxicity(spark, docs, nothing):
    rng = random.Random(9)
    words_ = ["".join(rng.choice("aeioubcd") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        text = [rng.choice(words_) for _ in range(30)]
        for _ in range(2 * bad):
            text.insert(rng.randint(0, 30), rng.choice(["worthless", "moron"]) + rng.choice(["", "x", "!", "ly"]))
        rows.append((i, " ".join(text), int(bad)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic(d, d.select("doc_id", "toxic")).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(out) == sorted(i for i, r in got.items() if r["held_out"])
    assert sum(got[i]["predicted"] == rows[i][2] for i in out) / len(out) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    odd = toxicity.toxic(docs, d.select("doc_id", "toxic"))
    assert odd.count() == docs.count() and odd.where("score IS NULL OR isnan(score)").count() == 0
    assert toxicity.toxic(docs, d.select("doc_id", "toxic").limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxic(nothing, d.select("doc_id", "toxic")).count() == 0


# -- 6
def test_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p><b>First  paragraph<br>of text</b> that is long enough.<p>Second &eacute;&#x41; one.</p>
    <aside>Side</aside><form><p>Name</p></form><div id="comments"><p>I disagree with all of it at length.</p></div><p></p></article><div class="sidebar">x</div><footer>&copy; me</footer></body></html>"""
    assert extract.main_text(page) == "Head & line\n\nFirst paragraph of text that is long enough.\n\nSecond éA one."
    plain = "<body><ul><li>a<li>b</ul><h2>Title</h2><div>" + "A long paragraph of words. " * 9 + "</div><div>" + "More words here in this one. " * 9 + "</div><footer>f</footer>"
    assert extract.main_text(plain).startswith("Title\n\nA long paragraph") and "f" not in extract.main_text(plain).split("\n\n")
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<p>just " + "text " * 100), (4, "u", "<<<>&#;<p")], "page_id bigint, url string, html string")
    got = extract.extract(pages).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got) and {r["page_id"] for r in got if not r["text"]} >= {None, 2}
    assert extract.extract(pages.limit(0)).count() == 0


def test_extraction_drops_nothing_else():
    one, two, three = ("A first paragraph of the article. " * 6).strip(), ("A second one, no shorter. " * 6).strip(), ("And a third of them. " * 6).strip()
    page = f"""<body><nav>Menu</nav><div class="page has-sidebar"><div class="content-sidebar-wrap"><article><h1 id="social">Title</h1><p>{one}</p>
    <h2 id="related-work">Related work</h2><p>{two}</p><section id="legal-history"><h2>Law</h2><p>{three}</p></section><section id="legal" aria-label="Legal"><p>Legal words.</p></section>
    <div id="social-impact"><p>Impact.</p></div><div class="legal-history"><p>History.</p></div><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x^2</annotation></math> holds.</p>
    <div class="inline-ad-slot">Buy.</div><div class="post-comments">No!</div><section id="comments">I disagree.</section><div class="social-share">Share</div></article></div><div class="sidebar-left">Left</div></div></body>"""
    assert extract.main_text(page).split("\n\n") == ["Title", one, "Related work", two, "Law", three, "Legal words.", "Impact.", "History.", "So x=1 holds."]
    assert extract.main_text(f'<body><nav>Menu</nav><div class="sidebar"><h1>Title</h1><p>{one}</p><p>{two}</p></div><footer>f</footer></body>').split("\n\n") == ["Title", one, two]
    assert extract.main_text(f'<body><p>Elsewhere.</p><div class="sidebar"><main><h1>Title</h1><p>{one}</p></main></div></body>').split("\n\n") == ["Title", one]
    assert extract.main_text("<body><nav>Menu</nav><footer>f</footer></body>") == ""


# -- 7
def test_licences(spark):
    rows = [("p/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."), ("p/a.py", "code"), ("p/q/b.py", "# Licensed under the Apache License, Version 2.0.\ncode by me"), ("p/q/r/c.py", None), ("z/d.py", "licensed premises under version"), ("p/v/COPYING", "x\nThis work is licensed under the GNU General Public License, version 3."), ("p/v/w/e.py", ""), ("p/a.py", "code"), (None, "All rights reserved."), ("top.txt", "All rights reserved.")]
    got = {r["path"]: (r["licence"], r["scope"]) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"p/LICENSE": ("MIT", "file"), "p/a.py": ("MIT", "inherited"), "p/q/b.py": ("Apache-2.0", "header"), "p/q/r/c.py": ("MIT", "inherited"), "z/d.py": (None, "none"), "p/v/COPYING": ("GPL-3.0", "file"), "p/v/w/e.py": ("GPL-3.0", "inherited"), "top.txt": ("proprietary", "header")}
    m = licences.Matcher(licences.TEMPLATES, 0.8)
    bare = " ".join(w for _, t in licences.TEMPLATES for w in licences.tokens(t) if w not in m.anchors)
    assert m.best(bare) is None and all(m.best(t)[0] == n for n, t in licences.TEMPLATES)


def test_licence_texts_and_tags(spark):
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    notices = {"tag": ("// SPDX-License-Identifier: MIT\ncode", "MIT"), "either": ("# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", "(MIT OR GPL-2.0)"), "two": (header.format(2), "GPL-2.0"), "three": (header.format(3), "GPL-3.0"), "rights": ("Copyright 2020 Acme Inc. All rights reserved.", "proprietary"), "other": ("Licensed under the EUPL, Version 1.2.", None), "prose": ("they wrote of a tool released under the MIT License in those years", None)}
    full = {n: "Copyright (c) 2020 Acme. All rights reserved.\n\n" + t for n, t in licences.full_texts()}
    commented = {n: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\n" + "call(alpha, beta);\n" * 300 for n, t in full.items() if len(t) < 3000}
    assert len(full) > 15 and len(commented) > 6
    rows = [(f"{k}/x.c", t) for k, (t, _) in notices.items()] + [(f"full/{n}/LICENSE", t) for n, t in full.items()] + [(f"code/{n}/x.c", t) for n, t in commented.items()] + [(f"whole/{n}/x", t) for n, t in full.items()]
    got = {r["path"]: (r["licence"], r["scope"]) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[f"{k}/x.c"][0] for k in notices} == {k: n for k, (_, n) in notices.items()}
    assert {n: got[f"full/{n}/LICENSE"] for n in full} == {n: (n, "file") for n in full}
    assert {n: got[f"code/{n}/x.c"] for n in commented} == {n: (n, "header") for n in commented}
    assert {n: got[f"whole/{n}/x"] for n in full} == {n: (n, "file") for n in full}


# -- 9
def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing(spark, docs, nothing):
    rng = random.Random(2)
    rows = [(i, "w " * min(int(rng.expovariate(0.02)) + 1, 300), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)] + [(9000, "only", "tiny"), (9001, None, "void"), (9002, "", "b"), (None, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    results = []
    for parts in (3, 7):
        got = mixing.mix(mixing.sizes(df.repartition(parts)), bucket_rows=64).collect()
        assert len(got) == len(rows)
        taken = collections.Counter()
        for r in got:
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["taken"]
        for s in ("a", "b", "c", "d", None):
            assert taken[s] == pytest.approx(want[s], abs=150)  # less than one document of up to 300 words
        assert taken["tiny"] == 3
        results.append(sorted((repr(r["doc_id"]), r["taken"]) for r in got))
    assert results[0] == results[1]
    odd = mixing.mix(mixing.sizes(docs, carry=True)).collect()
    assert len(odd) == docs.count() and {r["row"]["size"] for r in odd} <= {"9", None}
    assert mixing.mix(mixing.sizes(nothing)).count() == 0


def test_settle():
    """Words stay, one side becomes integral, and on average neither fraction changes."""
    rng = random.Random(2)
    for _ in range(300):
        f, words_, rest = rng.random(), rng.choice([1, 30, 9000]), rng.choice([1, 200, 40_000])
        draws = [mixing.settle(words_, f, rest, (i + 0.5) / 2000) for i in range(2000)]
        for x, y in (draws[0], draws[-1]):
            assert x * words_ + y * rest == pytest.approx(f * (words_ + rest)) and 0 <= x <= 1 and 0 <= y <= 1 and (x in (0.0, 1.0) or y in (0.0, 1.0))
        assert sum(x for x, _ in draws) / 2000 == pytest.approx(f, abs=0.002) and sum(y for _, y in draws) / 2000 == pytest.approx(f, abs=0.002)


def test_long_documents_are_made_up_for(spark):
    """Two documents hold half of a source; the others take what they leave."""
    for seed in range(3):
        rows = [(i, "w " * (6000 if i < 2 else 20 + i % 17), "a") for i in range(500)] + [(900 + i, "w " * 40, "b") for i in range(400)]
        got = mixing.mix(mixing.sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string")), seed=seed).collect()
        for source in "ab":
            assert abs(sum(r["taken"] for r in got if r["source"] == source) - next(r["target"] for r in got if r["source"] == source)) <= 60


def test_pivot():
    """Words stay, one of the two becomes integral, and on average neither fraction changes."""
    rng = random.Random(1)
    for _ in range(300):
        a, b, m, n = rng.random(), rng.random(), rng.choice([1, 3, 900]), rng.choice([1, 2, 50])
        draws = [mixing.pivot(a, b, m, n, (i + 0.5) / 2000) for i in range(2000)]
        for x, y in (draws[0], draws[-1]):
            assert x * m + y * n == pytest.approx(a * m + b * n) and 0 <= x <= 1 and 0 <= y <= 1 and (x in (0.0, 1.0) or y in (0.0, 1.0))
        assert sum(x for x, _ in draws) / 2000 == pytest.approx(a, abs=0.002) and sum(y for _, y in draws) / 2000 == pytest.approx(b, abs=0.002)


# -- queries and pipeline
def test_digest(spark):
    got = {r["doc_id"]: r["items_sha256"] for r in queries.op1_decontamination(spark, SF).where("n_items = 0").limit(1).collect()}
    assert set(got.values()) == {hashlib.sha256(b"").hexdigest()}
