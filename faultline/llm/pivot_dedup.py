"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are well separated vectors of a bounded sample,
completed by seeded directions.  A vector is described by the ordered list of
its nearest pivots.  Posting lists are kept for pairs of pivots: vectors meet
in the list of every two pivots that they share, so candidates have at least
two shared pivots, and are counted in the list of the two lowest ones they
share, once.  There the cosine is taken in double precision.

Equal vectors become one class first.  A list longer than a block is compared
block by block, so no list is gathered whole, and what a block returns is one
row a vector: the links it has there and its component within the block.  A
group of n near copies therefore returns rows in proportion to n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, components
from faultline.llm.vectors import long_lengths, matrix, one_each, runs, unit

#: Pivots, pivots that describe a vector, sample that they are taken from, and the cosine that separates them.
#: On 64 dimensions a pair at cosine 0.95 shares two of its 8 nearest of 256 pivots in 99.8 % of cases or more.
PIVOTS, NEAREST, SAMPLE, APART = 256, 8, 4096, 0.6
#: Vectors of a posting list that are compared at once.
BLOCK = 1024
#: Up to so many vectors of one length are one posting list; more have pivots of their own.
FEW = 512


def choose_pivots(sample: np.ndarray, dim: int, pivots: int = PIVOTS) -> np.ndarray:
    """Unit pivots: sample vectors in order that are apart from those before, then seeded directions."""
    out: list[np.ndarray] = []
    for v in sample:
        if len(out) == pivots:
            break
        if not out or (np.array(out) @ v).max() < APART:
            out.append(v)
    if len(out) < pivots:
        more = unit(np.random.default_rng(0).normal(size=(pivots - len(out), dim)))
        out += list(more)
    return np.array(out)


def _describe(shared, nearest: int):
    """(rep, key, low, mask): a row for each pair of a vector's nearest pivots; mask: all of them, as bits."""

    def run(batches):
        p = shared.value
        first, second = np.triu_indices(nearest, 1)
        for b in batches:
            if not len(b):
                continue
            near = np.argsort(-(unit(matrix(b["vec"])) @ p.T), axis=1, kind="stable")[:, :nearest]
            near.sort(axis=1)
            key = near[:, first] * len(p) + near[:, second]
            mask = np.zeros((len(b), len(p)), np.uint8)
            np.put_along_axis(mask, near, 1, axis=1)
            packed = [m.tobytes() for m in np.packbits(mask, axis=1)]
            yield pd.DataFrame({
                "rep": np.repeat(b["rep"].to_numpy(), key.shape[1]),
                "key": key.ravel(),
                "mask": np.repeat(np.array(packed, object), key.shape[1]),
            })

    return run


def _link(pivots: int, threshold: float):
    """(rep, links, low): of each vector with a link in its run, the copies it links to there and its component there."""

    def run(batches):
        for r in runs(batches, ["key", "i", "j"]):
            if len(r) < 2:
                continue
            key, i, j = r[["key", "i", "j"]].to_numpy()[0]
            rep, side, copies = r["rep"].to_numpy(), r["block"].to_numpy(), r["copies"].to_numpy()
            x = unit(matrix(r["vec"]))
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(left) or not len(right):
                continue
            near = x[left] @ x[right].T >= threshold
            near &= left[:, None] < right[None, :] if i == j else True
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = left[a], right[b]
            # counted where the key names the two lowest pivots that they share
            upto = np.zeros(pivots, np.uint8)
            upto[: key % pivots + 1] = 1
            mask = np.stack([np.frombuffer(m, np.uint8) for m in r["mask"]]) & np.packbits(upto)
            own = np.bitwise_count(mask[a] & mask[b]).sum(axis=1) == 2
            links = np.bincount(a[own], copies[b[own]], len(r)) + np.bincount(b[own], copies[a[own]], len(r))
            low = rep.copy()
            while True:
                new = low.copy()
                np.minimum.at(new, a, low[b])
                np.minimum.at(new, b, low[a])
                if (new == low).all():
                    break
                low = new
            on = np.zeros(len(r), bool)
            on[a] = on[b] = True
            yield pd.DataFrame({"rep": rep[on], "links": links[on].astype(np.int64), "low": low[on]})

    return run


def _one_list(pivots: int):
    """The rows of vectors of a rare length, which share one posting list a length."""

    def run(batches):
        mask = np.zeros(pivots, np.uint8)
        mask[:2] = 1
        packed = np.packbits(mask).tobytes()
        for b in batches:
            # a key no pivots have; its lowest two shared pivots are 0 and 1
            key = 1 - b["vec"].map(len).astype(np.int64) * pivots * pivots
            yield pd.DataFrame({"rep": b["rep"], "key": key, "mask": [packed] * len(b)})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): one for each vector id.

    Links join vectors with a cosine >= ``threshold``; a component is what links
    connect, named by its smallest vec_id; kept marks that vector.  No pair
    below the threshold is linked; pairs above it that share fewer than two of
    their nearest pivots are missed (see NEAREST for the measured recall).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors link with those of their own length: lengths that
    few vectors have are compared whole, others have an index of their own.  Rows that
    repeat a vec_id count once (the least usable vector); rows with a null
    vec_id are left out; equal vectors link; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    each = one_each(vectors, id_col, vec_col)
    each = scratch.write(each.withColumn("c1", F.xxhash64("vec")).withColumn("c2", F.md5(F.to_json("vec"))), "each")
    groups = each.groupBy("c1", "c2")
    classes = scratch.write(groups.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec")), "classes")
    named = each.join(classes.select("c1", "c2", "rep", "copies"), ["c1", "c2"], "left").select("vec_id", "rep", "copies")
    length, of_list = F.size("vec"), "rep long, key long, mask binary"
    dims = long_lengths(classes, FEW)
    lists = classes.where(~length.isin(dims)).select("rep", "vec").mapInPandas(_one_list(pivots), of_list)
    for i, dim in enumerate(dims):
        same = classes.where(length == dim)
        sample = same.orderBy(F.xxhash64("c2"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"]
        shared = spark.sparkContext.broadcast(choose_pivots(unit(matrix(sample)), dim, pivots))
        described = same.select("rep", "vec").mapInPandas(_describe(shared, nearest), of_list)
        lists = lists.union(described.withColumn("key", F.col("key") + i * pivots * pivots))
    lists = scratch.write(lists, "lists")
    long = lists.groupBy("key").agg(F.count("*").alias("n"))
    long = long.where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = (
        lists.join(long, "key")
        .withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .join(classes.select("rep", "copies", "vec"), "rep")
        .select("key", "i", "j", "block", "rep", "copies", "mask", "vec")
    )
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    found = scratch.write(dealt.mapInPandas(_link(pivots, threshold), "rep long, links long, low long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(scratch, found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "cc")
    joined = joined.select(F.col("node").alias("rep"), "component")
    out = named.join(counts, "rep", "left").join(joined, "rep", "left").select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    )
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    out = ids.join(out, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
