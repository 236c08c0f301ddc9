"""Nearest vectors by collision counting over query-aware projections.

Each block of vectors is projected on single random directions, and every
projection is a sorted array.  A query opens a window around its own
projection in each array; the windows widen round by round (virtual rehashing:
the radius grows, the arrays stay).  A vector that lies in the windows of
enough arrays is verified with its cosine.  A query is done in a block when
enough verified vectors are within the round's radius, or when the radius
covers the sphere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Scratch
from faultline.llm.vectors import matrix, one_each, unit

#: Projections, half a window's width for radius 1, and the share of windows that a vector must lie in to be verified.
#: A vector at the radius lies in a window with probability 0.63, and in 0.56 of 128 windows with about 0.95.
PROJECTIONS, HALF, SHARE = 128, 0.9, 0.56
#: Radii on the unit sphere, whose diameter is 2.
RADII = (0.2, 0.4, 0.6, 0.8, 0.95, 1.05, 1.15, 1.25, 2.1)
#: Vectors of a block, and queries that travel to the tasks at once.
BLOCK, QUERIES = 16_384, 20_000


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vec_id, score) of the k nearest that each query finds in one block."""
    a = np.random.default_rng(0).normal(size=(PROJECTIONS, x.shape[1]))
    ux, uq = unit(x), unit(q)
    px, pq = ux @ a.T, uq @ a.T
    order = np.argsort(px, axis=0, kind="stable").astype(np.int32).T.copy()
    values = np.take_along_axis(px.T, order, axis=1)
    least, n = int(np.ceil(SHARE * PROJECTIONS)), len(ids)
    lo = [np.stack([np.searchsorted(v, pq[:, j] - HALF * r, "left") for j, v in enumerate(values)], 1) for r in RADII[:-1]]
    hi = [np.stack([np.searchsorted(v, pq[:, j] + HALF * r, "right") for j, v in enumerate(values)], 1) for r in RADII[:-1]]
    out = []
    for i, own in enumerate(qids):
        count, scores = np.zeros(n, np.int64), np.full(n, -np.inf)
        checked = ids == own
        mid = None
        for r, radius in enumerate(RADII):
            if r == len(RADII) - 1:
                new = np.flatnonzero(~checked)
            else:
                low, high = lo[r][i], hi[r][i]
                if mid is None:
                    parts = [order[j, s:e] for j, (s, e) in enumerate(zip(low.tolist(), high.tolist()))]
                else:
                    parts = [order[j, s:e] for j, (s, e) in enumerate(zip(low.tolist(), mid[0].tolist()))]
                    parts += [order[j, s:e] for j, (s, e) in enumerate(zip(mid[1].tolist(), high.tolist()))]
                mid = low, high
                count += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((count >= least) & ~checked)
            if len(new):
                checked[new] = True
                scores[new] = (ux[new] * uq[i]).sum(axis=1)
            # within the radius: a distance of r is a cosine of 1 - r * r / 2
            if np.count_nonzero(scores >= 1 - radius * radius / 2) >= k:
                break
        # everything as near as the k-th, so that equal scores are ranked by id
        found = np.flatnonzero(scores > -np.inf)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((ids[found], -scores[found]))][:k]
        if len(found):
            exact = cosine(x[found], q[i])
            out += [(int(own), int(v), float(s)) for v, s in zip(ids[found], exact)]
    return out


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the original vectors; equal vectors get equal numbers whatever their place."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x, q = x / top, q / np.abs(q).max()
    return np.clip((x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())), -1.0, 1.0)


def _search(shared, k: int):
    """The nearest that each query finds in each block of vectors of its own length."""

    def run(batches):
        queries = shared.value  # length -> (ids, vectors)
        held: dict[int, list] = {}

        def out(dim: int):
            some = held.pop(dim)
            ids, x = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
            for s in range(0, len(ids), BLOCK):
                rows = search_block(ids[s : s + BLOCK], x[s : s + BLOCK], *queries[dim], k)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len)):
                if dim in queries:
                    held.setdefault(dim, []).append((part["vec_id"].to_numpy(np.int64), matrix(part["vec"])))
            for dim in [d for d, some in held.items() if sum(len(i) for i, _ in some) >= BLOCK]:
                yield from out(dim)
        for dim in list(held):
            yield from out(dim)

    return run


def nearest_vectors(vectors: DataFrame, query_ids, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest by cosine that are found for each query.

    ``query_ids`` is a condition on the column vec_id that picks the queries;
    all other rows are their candidates.  Every vector is indexed; with the
    parameters above at least 0.9 of the true nearest are found.  Queries go
    to the blocks in bounded chunks.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors of different lengths are no candidates for each other;
    rows that repeat a vec_id count once; with fewer candidates all are returned; equal scores are
    ranked by the smaller vec_id; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    each = scratch.write(one_each(vectors, id_col, vec_col), "vectors")
    queries = each.where(query_ids)
    chunks = queries.count() // QUERIES + 1
    found = None
    for c in range(chunks):
        # at most about QUERIES rows
        chunk = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toPandas().sort_values("vec_id")
        if not len(chunk):
            continue
        by_length = chunk.groupby(chunk["vec"].map(len))
        shared = spark.sparkContext.broadcast({d: (rows["vec_id"].to_numpy(np.int64), matrix(rows["vec"])) for d, rows in by_length})
        part = each.mapInPandas(_search(shared, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = scratch.write(found, "found")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
