"""The operators on the driver's tables with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, counts, extract, licences, lines, mixing, near, neighbours, scratch, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def tokenizer_definition(path: str | None = None) -> str:
    """JSON text of a tokenizer file; by default the public 49k word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_definition(), end=2)
    return tokens.read_tokens(spark, path, ids=False)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), counts.vocabulary())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    found = licences.scan(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"[^/]*$", 0).cast("bigint"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = scratch.materialize(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM bw),
lengths AS (SELECT DISTINCT n FROM p),
dw AS (SELECT r, l.n, unnest(range(1, len(w) - l.n + 2)) AS s, w FROM d, lengths l WHERE len(w) >= l.n),
hits AS (SELECT dw.r, dw.s, dw.n, p.item_id FROM dw JOIN p ON p.n = dw.n AND p.g = array_to_string(dw.w[dw.s : dw.s + dw.n - 1], ' ')),
cover AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + least(4, len(w)) - 1], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) AS (SELECT u, u FROM (SELECT DISTINCT u FROM links) UNION SELECT a, v FROM reach JOIN links ON b = u),
label AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN label USING (doc_id)
"""


def queries() -> dict:
    all_of = [op1_decontamination, op2_token_output, op3_near_dedup, op4_token_counts, op5_toxicity, op6_html_extraction, op7_licence_scan, op8_nearest_vectors, op9_source_mixing, op10_line_dedup]
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_near_dedup": OP3_SQL}
