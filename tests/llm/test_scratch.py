"""Scratch tables leave no shuffle files behind where that is asked for."""

import glob

from pyspark.sql import functions as F

from faultline.llm.common import CLEANUP, Scratch


def _shuffled(spark):
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in at for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_shuffle_files_go_with_their_step(spark):
    before, set_ = _shuffled(spark), spark.conf.get(CLEANUP)
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    assert Scratch(spark, "test", tidy=True).write(rows, "t").agg(F.sum("n")).first()[0] == 10_000
    assert spark.conf.get(CLEANUP) == set_
    kept = Scratch(spark, "test").write(rows, "t")
    left = len(_shuffled(spark) - before)
    # the plain write's files and those of the sum may be there, those of the tidy write are not
    again = Scratch(spark, "test", tidy=True).write(rows.withColumn("m", F.col("n")), "t")
    assert len(_shuffled(spark) - before) <= left
    assert again.count() == kept.count() == 1000


def test_batches_are_bounded_where_asked(spark):
    import pandas as pd

    from faultline.llm.common import BATCH

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    before = spark.conf.get(BATCH)
    got = Scratch(spark, "test").write(spark.range(3_000).coalesce(1).mapInPandas(sizes, "n long"), "t", batch=500)
    assert spark.conf.get(BATCH) == before
    assert got.agg(F.max("n"), F.sum("n")).first() == (500, 3_000)


def test_pipeline_sends_few_texts_at_once(spark, tmp_path):
    import pandas as pd

    import corpus_pipeline
    from faultline.llm import toxicity
    from faultline.llm.common import BATCH

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get(BATCH)
    try:
        assert corpus_pipeline.clean(spark, docs, str(tmp_path)).count() == 4_000
        assert docs.coalesce(1).mapInPandas(sizes, "n long").agg(F.max("n")).first()[0] <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(BATCH, "7")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(BATCH) == "7"
        # null and empty texts are scored as texts without words
        odd = spark.createDataFrame([(None,), ("",), ("a b",)], "text string")
        got = [r[0] for r in odd.select(toxicity.score(spark, toxicity.Model({}, 0.0))).collect()]
        assert got == [0.5, 0.5, 0.5]
    finally:
        spark.conf.set(BATCH, before)


def test_blocks_are_bounded_where_asked(spark):
    import pyarrow.dataset as ds

    scratch = Scratch(spark, "test")
    rows = spark.range(0, 4000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"))
    for block, groups in ((None, 1), (32 << 10, 4)):
        assert scratch.write(rows, f"rows-{block}", None, block).count() == 4000
        files = list(ds.dataset(f"{scratch.base.removeprefix('file:')}/rows-{block}").get_fragments())
        assert sum(f.metadata.num_row_groups for f in files) >= groups
        assert (block is None) == (sum(f.metadata.num_row_groups for f in files) == 1)
