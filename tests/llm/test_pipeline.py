"""Each stage of the pipeline against a plain version, on documents with every odd row."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from hexavane.llm import scratch, tokens, toxicity

from test_llm import ALNUM, SF, SPACED, plain_contaminated, plain_targets, plain_words


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, ids with several texts, null ids, texts and sources, a long text, near copies and an extra column."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    first = df.orderBy("doc_id")
    parts = [df, first.limit(3), first.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")), first.limit(4).withColumn("text", F.concat("text", F.lit(" and a tail"))).withColumn("doc_id", F.col("doc_id") + 5000)]
    parts += [first.limit(6).withColumn("doc_id", F.lit(77).cast("bigint")).withColumn("text", F.concat(F.lit("new words here "), "text"))]
    odd = [(-1, None, "en", None, 0), (-2, None, "en", "a", 0), (-3, "", None, "b", 0), (-4, " \n ", None, "b", 3), (-5, "one two", None, None, 7), (-6, "One  TWO", None, None, 8), (-7, " ".join(f"t{i}" for i in range(30_000)), "en", "c", 9)]
    out = parts[0]
    for p in [*parts[1:], spark.createDataFrame(odd, df.schema)]:
        out = out.unionByName(p)
    return scratch.materialize(out.withColumn("row", F.lit("extra")), "odd")


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.Settings())
    buckets, offset = model.bucket_scores(), model.offset()

    def odds(text):
        found = [w for x in (text or "").lower().split() if (w := x.strip(toxicity.EDGES))]
        return offset + (float(np.mean([buckets[toxicity.subwords(w, model.settings)].mean() for w in found])) if found else 0.0)

    value = {r["text"]: odds(r["text"]) for r in docs.select("text").distinct().collect()}
    clear = {t for t, v in value.items() if abs(v) > 1e-6}
    got = rows(P.drop_toxic(spark, docs, SF))
    want = collections.Counter({r: n for r, n in rows(docs).items() if value[r[1]] < 0})
    assert {r: n for r, n in got.items() if r[1] in clear} == {r: n for r, n in want.items() if r[1] in clear} and sum(got.values()) < docs.count()


def test_near(spark, docs):
    every = list(rows(docs))
    sets = []
    for r in every:
        w = plain_words(SPACED, r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups = collections.defaultdict(list)
    for i, k in enumerate(label):
        groups[k].append(every[i])
    got = rows(P.drop_near_copies(spark, docs, SF))
    assert set(got.values()) == {1} and len(got) == len(groups)
    for g in groups.values():
        stayed = [r for r in g if r in got]
        assert len(stayed) == 1 and (stayed[0][0] is None, stayed[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in g)
    assert any(len(g) > 1 for g in groups.values())


def test_leaks(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [plain_words(ALNUM, t)] for i in range(max(1, len(w) - 9))}

    def leaks(text):
        w = plain_words(ALNUM, text)
        return any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1)) if w else False

    judged = {r["text"]: leaks(r["text"]) for r in docs.select("text").distinct().collect()}
    some = next(t for t, yes in judged.items() if yes)
    assert plain_contaminated(some, items, 10)[1] > 0
    assert rows(P.drop_leaks(spark, docs, SF)) == collections.Counter({r: n for r, n in rows(docs).items() if not judged[r[1]]})


def test_mixing(spark, docs):
    got, before = rows(P.mix_sources(spark, docs, SF)), rows(docs)
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r, n in before.items():
        words = len(plain_words(SPACED, r[1]))
        sizes[r[3]] += n * words
        taken[r[3]] += got[r] * words
        longest[r[3]] = max(longest[r[3]], words)
    assert set(got) <= set(before) and all(n <= 3 * before[r] for r, n in got.items())
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]
    assert got == rows(P.mix_sources(spark, docs.repartition(5), SF))


def test_tokens(spark, docs):
    plain = tokens.ChunkEncoder(P.tokenizer_definition()).tokenizer
    got = sorted(P.write_token_files(spark, docs, SF).collect(), key=lambda r: r["start"])
    want = collections.Counter()
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))


def test_chain(spark, docs):
    for source in (docs, docs.limit(0)):
        now = source
        for name, stage in P.STAGES:
            out = stage(spark, now, SF)
            assert name == "tokens" or out.columns == docs.columns
            now = scratch.materialize(out, name)
        assert set(now.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_run_leaves_one_table(spark):
    before = scratch.written(spark)
    assert P.run(spark, SF).count() > 0
    assert len(scratch.written(spark) - before) == 1


def test_unsafe_tokenizer_gets_whole_texts():
    import public_tokenizers

    definition = P.tokenizer_definition(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.ChunkEncoder(definition)
    texts = ["  Two  spaces\n\nand lines ", "", "it's <|endoftext|> x", "é日本"]
    ids, at = encoder.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
