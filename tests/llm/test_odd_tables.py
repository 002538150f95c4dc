"""What was open: licences by name and on odd tables, long and odd texts for token counts, repeated ids in training."""

import pytest
from pyspark.sql import functions as F
from test_llm import plain_count

from hexavane.llm import counts, licences, scratch, toxicity

GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
NAMED = [
    (GNU.format("", 2), "GPL-2.0"),
    (GNU.format("", 3), "GPL-3.0"),
    (GNU.format("Affero ", 3), "AGPL-3.0"),
    (GNU.format("Lesser ", "2.1"), "LGPL-2.1"),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under the MIT License.", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("This file is not licensed under the GPL.", None),
    ("An essay on licences and who may grant them.", None),
    ("", None),
    (None, None),
]


def test_names_of_licences(spark):
    df = spark.createDataFrame([(f"d{i}/x.c", t, "a", "b", "c") for i, (t, _) in enumerate(NAMED)], "path string, text string, licence string, scope string, dir string")
    got = {r["path"]: r["licence"] for r in licences.scan(df).collect()}
    assert got == {f"d{i}/x.c": n for i, (_, n) in enumerate(NAMED)}


def test_licences_on_odd_tables(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/COPYING", mit), ("a/b/c/d/e.py", "code"), ("a/LICENSE", mit), ("a/LICENSE", None), ("a/x.py", "code"), ("a/x.py", apache), (None, mit), ("/LICENSE", apache), ("/r.py", "x"), ("long", "word " * 200_000 + apache)]
    df = spark.createDataFrame([(*r, "l", "s") for r in rows], "path string, text string, licence string, score string")
    got = {r["path"]: tuple(r)[1:] for r in licences.scan(df).collect()}
    assert set(got) == {p for p, _ in rows if p is not None}
    assert got["a/b/c/d/e.py"][0] == "MIT" and got["a/b/c/d/e.py"][2:] == ("inherited", "a/COPYING")  # of equal scores the first path
    assert got["a/x.py"][0] == "Apache-2.0" and got["a/x.py"][2] == "header" and got["/r.py"][2:] == ("inherited", "/LICENSE") and got["long"][0] == "Apache-2.0"
    assert licences.scan(df.limit(0)).count() == 0


def test_long_and_odd_texts_are_counted(spark):
    pieces = counts.vocabulary()
    fallback = min(pieces.values()) - 10
    texts = ["word " * 30_000, "x" * 5000, "日本" * 800, "", " \n", None, "a\x0bb\x0cc\x1cd e", "the the"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "the the"), (None, "a b")]
    df = spark.createDataFrame([(*r, "n", "w") for r in rows], "doc_id bigint, text string, n_tokens string, n_words string")
    want = []
    for i, t in rows:
        words = [w for w in (t or "").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        seen = {w: plain_count(counts.MARK + w, pieces, fallback) for w in set(words)}
        want.append((i, len(words), sum(seen[w] for w in words)))
    got = [tuple(r) for r in counts.token_counts(df, pieces).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_training_rows_are_bounded_and_fixed(spark):
    rows = [(i, f"good words {i} " * 20 if i % 2 else f"you moron {i} " * 20) for i in range(400)]
    d = spark.createDataFrame(rows + [(1, "another text of row one"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    models = [toxicity.fit(x, labels, toxicity.Settings(sample_bytes=40_000)) for x in (d, d.repartition(5).orderBy(F.rand(3)))]
    assert (models[0].table == models[1].table).all() and (models[0].layer == models[1].layer).all()
    few = toxicity.fit(d, labels, toxicity.Settings(sample_bytes=600))
    assert not (few.table == models[0].table).all()
    prob = toxicity.probability(spark, models[0])(F.col("text"))
    by = {r["doc_id"]: r["p"] for r in d.where("doc_id > 3").select("doc_id", prob.alias("p")).collect()}
    assert sum((by[i] >= 0.5) == (i % 2 == 0) for i in by) > 0.97 * len(by)


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)


def test_tables_are_deleted(spark):
    before = scratch.written(spark)
    a, b = scratch.materialize(spark.range(3), "a"), scratch.materialize(spark.range(4), "b")
    scratch.drop(a)
    assert len(scratch.written(spark) - before) == 1
    scratch.release(spark, keep=[b], since=before)
    assert b.count() == 4
    scratch.release(spark, since=before)
    assert scratch.written(spark) == before
