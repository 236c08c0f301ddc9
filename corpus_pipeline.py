"""A corpus pipeline: toxic documents out, one of each near-duplicate group, private data replaced, sources mixed, encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read as the next one's
``docs``.  ``run`` applies them to ``documents``.  Stages that send texts to
Python lower the session's Arrow batch to ``BATCH_ROWS`` rows, as their frames
run after they return.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.bpe import digests, encode_decode
from faultline.llm.common import BATCH, Scratch, crc_mod, load, small
from faultline.llm.mixing import mix_sources
from faultline.llm.ngram_join import ngram_components
from faultline.llm.surrogates import replace_private
from faultline.llm.toxicity import score, train

#: Texts that travel to a Python worker at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS``; a lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from the labels of two folds of three, is below 0.7."""
    small_batches(spark)
    model = train(docs, load(spark, sf_dir, "labels"), crc_mod("doc_id", 3) == 1)
    return docs.where(score(spark, model) < 0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles.

    It is the one with the smallest id.  Of rows that share an id, and of rows
    without one, equal texts are one group as well, and of several texts each is
    compared by itself; documents without words are each kept.
    """
    small_batches(spark)
    scratch = Scratch(spark, "distinct")
    # rows are named by a number of their own, so an id may repeat or be missing
    rows = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = scratch.write(ngram_components(rows.select(F.col("__row").alias("doc_id"), "text"), n=5, num=4, den=5), "groups")
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    member = groups.join(several, "component_id").select(F.col("doc_id").alias("__row"), "component_id")
    member = scratch.write(member.join(rows.select("__row", "doc_id"), "__row"), "member")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    stays = member.groupBy("component_id").agg(F.min_by("__row", order).alias("stays"))
    other = scratch.write(member.join(stays, "component_id").where("__row <> stays").select("__row"), "other")
    return rows.join(small(other, other.count()), "__row", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by surrogates; n_chars follows the new text."""
    out = replace_private(docs, count_col="__entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    copies = mix_sources(docs, weights=(5, 2, 1), cap=3).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    taken = docs.join(small(copies, docs.count()), F.col("doc_id").eqNullSafe(F.col("__id"))).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every row."""
    small_batches(spark)
    # workers of the stages before may still be alive, so this one remembers less
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode_decode(docs.select("doc_id", "lang", "source", "text"), path, remember=60_000))


STAGES = [
    ("toxicity", clean),
    ("ngram_jaccard", distinct),
    ("pii_surrogates", private),
    ("source_mix", mixed),
    ("bpe", encoded),
]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
