"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import WORD, Scratch

#: Hex digits of the seeded hash that name a sampling bucket; two levels of 256 buckets a source.
HEX = 4


def n_words(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, without one task that holds all sources."""
    key = [F.col("source").isNull(), F.col("source")]
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = scratch.write(
        sources.repartitionByRange(n, *key).sortWithinPartitions(*key)
        .select("*", F.monotonically_increasing_id().alias("id"))
        .withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1)),
        "ranked",
    )
    # one row a partition
    counts = sorted(part.groupBy("part").count().collect())
    before, total = {}, 0
    for row in counts:
        before[row["part"]], total = total, total + row["count"]
    if not before:
        return part.select("source", "source_size", F.lit(0).cast("long").alias("rank"))
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")]
    return part.select("source", "source_size", (start + F.col("at")).alias("rank"))


def water_fill(scratch: Scratch, sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``cap`` times its size.

    Each round gives the words that clamped sources leave over to the others by
    weight; it ends when no further source is above its cap.  A round is one
    aggregation over the table of sources, which stays in the cluster.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = scratch.write(_ranked(scratch, sources).select("source", "source_size", pick.cast("long").alias("w")), "weights")
    limit = F.col("source_size") * cap
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = None, -1
    while True:
        shut = F.lit(False) if level is None else level * F.col("w") > limit
        got = s.agg(
            F.coalesce(F.sum(F.when(shut, limit)), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~shut, F.col("w"))), F.lit(0)).alias("open"),
            F.coalesce(F.sum(shut.cast("long")), F.lit(0)).alias("full"),
        ).first()
        if got["full"] == full or got["open"] == 0:
            break
        full, level = got["full"], F.lit((total - got["used"]) / got["open"])
    level = F.lit(0.0) if level is None else level
    return s.select("source", "source_size", F.least(level * F.col("w"), limit.cast("double")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source, copies) of all ``docs`` (doc_id, text, source).

    size is the number of words.  Sources by code point, null last, have the
    weights in turn and share all words; a target stops at ``cap`` times its
    source's words, the excess goes to the others by weight until none is above.
    Every document is repeated floor(target / source_size) times whole; the rest
    of the target is filled with one further copy of documents in the order of a
    seeded hash of id and text, up to the document whose middle passes the target.  So a
    source's taken words miss its target by half a document at most, and reruns
    agree.

    A null or empty text has size 0 and takes 0 words; null sources are one
    source; a source without words has target 0; rows that share an id or have
    none are ordered by their texts, equal rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), own).cast("binary"))
    sized = scratch.write(
        docs.select("doc_id", "source", n_words().alias("size"), h.alias("h"))
        .withColumn("b", F.conv(F.substring("h", 1, HEX), 16, 10).cast("int")),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = scratch.write(
        water_fill(scratch, sources, weights, cap).withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "plan",
    )

    # Where the rest ends: among 256 buckets of the hash, then among the 256 within that one.
    buckets = scratch.write(sized.groupBy("source", "b").agg(F.sum("size").alias("words")), "buckets")
    cut = plan.select("source", "rest", F.lit(0).alias("top"))
    for shift, sums in ((8, buckets), (0, buckets)):
        rows = sums.groupBy("source", F.shiftright("b", shift).alias("at")).agg(F.sum("words").alias("words")).alias("r")
        inside = F.lit(True) if shift else F.shiftright(F.col("r.at"), 8) == F.col("c.top")
        rows = rows.join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & inside)
        rows = rows.select("r.source", "r.at", "r.words", "c.rest")
        upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("before", F.sum("words").over(upto) - F.col("words")).where("before < rest")
        last = rows.groupBy("source").agg(F.max(F.struct("at", "before", "rest")).alias("x"))
        cut = scratch.write(last.select("source", F.col("x.at").alias("top"), (F.col("x.rest") - F.col("x.before")).alias("rest")), f"cut-{shift}")
    ends = cut.select(F.col("source").alias("cs"), "top", F.col("rest").alias("left"))
    plan = scratch.write(
        plan.join(ends, F.col("source").eqNullSafe(F.col("cs")), "left")
        .select(F.col("source").alias("ps"), "source_size", "target", "whole", F.coalesce("top", F.lit(-1)).alias("top"), "left"),
        "cuts",
    )
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("size").over(order) - F.col("size") / 2
    edge = placed.where("b = top").withColumn("extra", (middle < F.col("left")).cast("long"))
    clear = placed.where("b <> top").withColumn("extra", (F.col("b") < F.col("top")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    return edge.unionByName(clear).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies")
    )
