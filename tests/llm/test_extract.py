"""Extraction against pages whose article is known, and its clusters against a plain version."""

import math
import random
import re

import numpy as np
import pytest

from hexavane.llm import extract as X


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta of the a to and ratio cluster line".split()) for _ in range(n))


def page(rng):
    """HTML and the blocks of its article."""
    blocks, body = [words(rng, 4)], []
    body.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(3, 9)):
        kind, text = rng.choice(["p", "p", "p", "long", "list", "h2", "short", "quote"]), words(rng, rng.randint(12, 60))
        if kind == "list":
            items = [words(rng, rng.randint(4, 12)) for _ in range(3)]
            blocks += items
            body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
        elif kind == "h2":
            blocks += [words(rng, 3), text]
            body.append(f"<h2>{blocks[-2]}</h2><p>{text}</p>")
        elif kind == "short":
            blocks += ["So it is.", text]
            body.append(f"<p>So it is.</p><p>{text}")
        else:
            blocks.append(text + " " + text if kind == "long" else text)
            body.append({"quote": "<blockquote>{}</blockquote>"}.get(kind, "<p>{}</p>").format(blocks[-1].replace("ratio", "<b>ratio</b>").replace("line ", "<i>line</i> ")))
    blocks.append(words(rng, 40))
    body.append(f"<p>{blocks[-1]}</p>")
    links = "".join(f'<li><a href="/{i}">{words(rng, 2)}</a></li>' for i in range(8))
    head = f'<head><title>{blocks[0]}</title><style>p{{}}</style><script>var t="</p>";</script></head>'
    before = [f"<nav><ul>{links}</ul></nav>", '<div class="cookie-notice">We use cookies.</div>', "<!-- ad --><div class=ad>Buy this now, it is good.</div>", f'<header><a href="/">{words(rng, 2)}</a></header>']
    after = [f"<aside><p>{words(rng, 9)}</p></aside>", f'<div class="sidebar">{words(rng, 9)}</div>', f'<section id="comments"><p>{words(rng, 30)}</p></section>', "<footer>&copy; 2020 me</footer>", f'<form><label>Mail</label><button>{words(rng, 2)}</button></form>']
    rng.shuffle(before)
    shape = rng.choice(["article", "main", "main-article", "wrapped", "div"])
    inner = "".join(body)
    if shape != "div":
        inner += rng.choice(["", f'<div class="social-share">{words(rng, 3)}</div>', f"<footer>{words(rng, 5)}</footer>", f'<ul>{links}</ul>'])
    html = {"article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "main-article": f"<main><article>{inner}</article></main>", "wrapped": f'<div class="page has-sidebar content-sidebar-wrap"><article class="post">{inner}</article></div>', "div": f'<div id="content">{inner}</div>'}[shape]
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before[: rng.randint(1, 4)])}{html}{''.join(rng.sample(after, 3))}</body></html>", blocks


def test_known_articles():
    rng = random.Random(11)
    for _ in range(400):
        html, blocks = page(rng)
        assert X.main_text(html).split("\n\n") == blocks, html


def test_given_pages(spark):
    """The driver's pages are plain enough for a pattern to tell their article."""
    import html as H

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in X.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br>", " ", inner))
        want = [t for p in parts if (t := re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]+>", "", p))).strip())]
        assert got[r["page_id"]].split("\n\n") == want


def plain_clusters(ratios, share):
    """Weighted means of five neighbours, and which of them reach the share of their deviation."""
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-((k - i) ** 2) / 2), ratios[k]) for k in range(i - 2, i + 3) if 0 <= k < len(ratios)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return smooth, share * deviation


@pytest.mark.parametrize("share", [0.3, 0.5, 1.0])
def test_clusters_against_plain(share):
    rng = random.Random(2)
    for _ in range(50):
        lines = [X.Line("x" * rng.randint(1, 400), rng.randint(0, 12), 0, 0, (), False) for _ in range(rng.randint(1, 40))]
        smooth, edge = plain_clusters([len(x.text) / max(x.tags, 1) for x in lines], share)
        got = X.clusters(lines, share)
        assert all(abs(s - edge) < 1e-9 or bool(g) == (s >= edge) for s, g in zip(smooth, got, strict=True))


def test_ratios_decide(monkeypatch):
    """With all ratios equal, pages give something else: the clusters choose the content."""
    rng = random.Random(5)
    made = [page(rng) for _ in range(200)]
    right = [X.main_text(h) for h, _ in made]
    monkeypatch.setattr(X, "clusters", lambda lines, share: np.ones(len(lines), bool))
    assert sum(X.main_text(h) != r for (h, _), r in zip(made, right, strict=True)) > 30


LONG = ["A first paragraph of the article, long enough to be one. " * 5, "A second one, no shorter than that. " * 6, "And a third of them to end with. " * 6]
LONG = [x.strip() for x in LONG]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize("name", ["content no-sidebar", "post comments-open", "legal news", "social science", "with-sidebar", "related-work study"])
def test_names_that_are_topics_or_layout(name):
    for html in (f'<body><nav>Menu</nav><div class="{name}"><h1>Title</h1>{PARAGRAPHS}</div><footer>f</footer></body>', f'<body><nav>Menu</nav><article class="{name}"><h1>Title</h1>{PARAGRAPHS}</article></body>', f'<body><div class="{name}"><main><h1>Title</h1>{PARAGRAPHS}</main></div></body>'):
        assert X.main_text(html).split("\n\n") == ["Title", *LONG]


def test_pages_with_faults():
    for end in ("", "</body></html>"):
        assert X.main_text(f"<body><nav><a href=x>Menu</a><h1>Title</h1>{PARAGRAPHS}{end}").split("\n\n")[-4:] == ["Title", *LONG]
    assert X.main_text(f'<body><main><article><h1>Title</h1>{PARAGRAPHS}</article><article class="comment"><p>{LONG[0]}</p></article></main></body>').split("\n\n") == ["Title", *LONG]
    assert X.main_text(f"<body><article><header><h1>Title</h1><p>By me</p></header>{PARAGRAPHS}</article></body>").split("\n\n") == ["Title", *LONG]
    both = f"<article><h2>One</h2>{PARAGRAPHS}</article><article><h2>Two</h2>{PARAGRAPHS}</article>"
    for html in (f"<body><nav>Menu</nav>{both}</body>", f"<body><main>{both}</main></body>"):
        assert X.main_text(html).split("\n\n") == ["One", *LONG, "Two", *LONG]
    assert X.main_text(f'<body><div class="comments"><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[1]}</p></div><article>{PARAGRAPHS}</article></body>').split("\n\n") == LONG
    assert X.main_text("<body><nav>Menu</nav><script>x</script></body>") == ""


def test_odd_tables(spark):
    long = "<article>" + "<p>" + "word " * 400 + "</p>" * 2000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, "u", ""), (3, "u", "<p>just " + "text " * 100), (4, "u", "<<<>&#;<p"), (5, "u", "<p>x</p>" * 5000)]
    df = spark.createDataFrame([(*r, "t", "n") for r in rows], "page_id bigint, url string, html string, text string, n_chars string")
    got = X.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got) and {r["page_id"] for r in got if not r["text"]} >= {None, 2}
    assert next(r for r in got if r["page_id"] == 5)["text"] == "\n\n".join(["x"] * 5000)
    assert X.extract(df.limit(0)).count() == 0
