"""Line dedup against a plain version of its definition."""

import collections
import random
import re
import time

from hexavane.llm import lines

COLUMNS = "doc_id bigint, text string, line string, leaf string, gone string, n_lines string"


def words(line):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^ \t\n\v\f\r]+", line)]


def plain(rows, depth, similar, min_docs):
    """Which distinct lines recur, and what is left of each row."""
    docs = {(i, t): t for i, t, *_ in rows if t is not None}
    by_line, by_leaf = collections.defaultdict(set), collections.defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            if w := tuple(words(x)):
                by_line[w].add(d)
    masked = {w: tuple(None if re.search("[0-9]", x) else x for x in w) for w in by_line}
    leaf = {w: (len(w), m[:depth]) for w, m in masked.items()}
    support = collections.Counter()
    for w, m in masked.items():
        by_leaf[leaf[w]].add(w)
        for p, x in enumerate(m):
            support[leaf[w], p, x] += len(by_line[w])
    recur = {w for w, d in by_line.items() if len(d) >= min_docs}
    for group in by_leaf.values():
        for bound in lines.LEVELS:
            found = collections.defaultdict(list)
            for w in group:
                m = tuple(x if x is not None and support[leaf[w], p, x] >= bound * min_docs else None for p, x in enumerate(masked[w]))
                if sum(x is not None for x in m) >= similar * len(w) - 1e-9:
                    found[m].append(w)
            for some in found.values():
                if len(set().union(*(by_line[w] for w in some))) >= min_docs:
                    recur.update(some)
    out = []
    for i, t, *_ in rows:
        kept = None if t is None else [x for x in t.split("\n") if not words(x) or tuple(words(x)) not in recur]
        out.append((i, 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept), None if t is None else "\n".join(kept)))
    return out


def made(rng, n):
    """Documents of lines from templates whose fields have common and rare values, of prose and of repeated passages."""
    names = ["admin"] * 6 + [f"{chr(97 + a)}{chr(97 + b)}x" for a in range(20) for b in range(10)]
    passage = ["the same long passage " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(26)) for k in range(3)]
    rows = []
    for i in range(n):
        some = [f"posted by {rng.choice(names)} on day {rng.randint(1, 9)} in the forum of {rng.choice(names)} here"]
        some += [" ".join(rng.choice("the of and a to in it is Was".split()) for _ in range(rng.randint(1, 9))) for _ in range(3)]
        some += [rng.choice(passage)] * rng.randint(0, 2) + ["", "  ", f"{i} {i} {i}", "12 34 56", rng.choice(["Chapter 1", "chapter two", "x"])]
        rng.shuffle(some)
        rows.append((i, "\n".join(some[: rng.randint(0, 9)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", "f", "g", "n") for r in rows], COLUMNS)


def test_against_plain(spark):
    rng = random.Random(4)
    for depth, similar, min_docs in ((3, 0.7, 6), (2, 0.5, 3), (3, 1.0, 4)):
        rows = made(rng, 150)
        rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (900, None), (901, ""), (902, "\n\n"), (3, rows[5][1]), (903, "x " * 3000), (904, "\n".join(["y z"] * 4000 + ["q"]))]
        got = lines.drop_recurring(frame(spark, rows), depth=depth, similar=similar, min_docs=min_docs)
        want = plain(rows, depth, similar, min_docs)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
        assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_order_and_partitions_have_no_part(spark):
    rows = made(random.Random(8), 200)
    one = sorted(map(repr, lines.drop_recurring(frame(spark, rows).coalesce(1)).collect()))
    two = sorted(map(repr, lines.drop_recurring(frame(spark, rows[::-1]).repartition(7)).collect()))
    assert one == two


def test_fields_of_a_forum(spark):
    rows = [(i, f"own words number{i} of document alpha beta\nposted by user u{i} on day {i} in the forum\nShare this page\n\nclosing text {'abcdefghijklmnop'[i]} here now") for i in range(10)]
    rows += [(50, "Share this page"), (51, None), (52, ""), (None, "Share this page\nkeep me"), (50, "Share this page")]
    by = {r["doc_id"]: r for r in lines.drop_recurring(frame(spark, rows)).collect()}
    assert by[3]["n_lines"] == 5 and by[3]["n_dropped"] == 3 and by[3]["text"] == "\nclosing text d here now" and by[None]["text"] == "keep me"
    assert lines.drop_recurring(frame(spark, rows), min_docs=100).where("n_dropped > 0").count() == 0
    assert lines.drop_recurring(frame(spark, rows).limit(0)).count() == 0


def test_long_text_is_linear(spark):
    """80,000 lines of which most go."""
    text = "\n".join(f"line {'abcdefghij'[i % 10]} of it" for i in range(80_000))
    rows = [(i, text) for i in range(7)]
    lines.drop_recurring(frame(spark, rows[:1])).count()
    began = time.perf_counter()
    got = lines.drop_recurring(frame(spark, rows)).collect()
    assert all(r["n_dropped"] == 80_000 for r in got) and time.perf_counter() - began < 60
