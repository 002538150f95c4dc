"""From raw documents to token files: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents. Extra columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexavane.llm import contamination, mixing, near, scratch, tokens, toxicity
from hexavane.llm.queries import table, tokenizer_definition


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5 stay, all columns as they were. The model is trained on the labelled rows of ``docs``. Null, empty
    and wordless texts get the bias's score; each of repeated rows is judged, with the same outcome; ids may be null."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.Settings())
    return docs.where(toxicity.probability(spark, model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) the row of the smallest doc_id stays, nulls last.
    Different texts under one id are told apart; rows equal in all columns are one; rows without words all stay."""
    return near.one_of_each(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay that share no ten consecutive words with a benchmark item. Rows are known by a hash of id and text, so rows
    without id, and different texts under one id, are judged as well; rows without words stay, and so do repeated clean rows."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("row_key"), F.col("text"))
    found = contamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), window=10, doc_id="row_key")
    leaks = scratch.materialize(found.where("contaminated").select("doc_id").distinct(), "leaks")
    return docs.join(leaks.withColumnRenamed("doc_id", "__leak"), key == F.col("__leak"), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, 0 to 3 times. Null sources are one source; rows without words may be left out or
    repeated as others are; repeated rows and rows without id are rounded one by one. A row travels once, with its fraction:
    a join back by key would send it as far, and could not tell repeated rows apart."""
    per = scratch.materialize(mixing.targets(mixing.sizes(docs)), "targets")
    mixed = mixing.mix(mixing.sizes(docs, carry=True), per_source=per)
    return mixed.withColumn("__copy", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the packed files. Null texts are empty; rows without id
    come first; repeated rows are written as often as they are there."""
    path = scratch.new_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_definition(), end=2)
    return tokens.read_tokens(spark, path, ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: Training, hashing and random rounding have no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Intermediate tables of a stage are deleted when the stage is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = scratch.written(spark)
        out = scratch.materialize(stage(spark, docs, sf_dir), name)
        scratch.release(spark, keep=[out], since=before)
        if docs is not None and hasattr(docs, "_scratch"):
            scratch.drop(docs)
        docs = out
    return docs
