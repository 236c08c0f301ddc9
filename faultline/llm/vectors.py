"""Helpers of the vector operators: usable rows, matrices, sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def one_each(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the usable vectors: of rows that repeat an id the least vector counts."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    rows = rows.where(usable(F.col("vec"))).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows


def long_lengths(vectors: DataFrame, more_than: int) -> list[int]:
    """The lengths that more than so many vectors have."""
    counts = vectors.groupBy(F.size("vec").alias("d")).count().where(F.col("count") > more_than)
    return sorted(r["d"] for r in counts.collect())  # at most a row for every so many vectors


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; very large and very small components do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of sorted batches, across batch borders."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        key = b[keys].to_numpy()
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(b)] if len(b) else [0]
        for s, e in zip(cut, cut[1:]):
            if rest and (rest[-1][keys].to_numpy()[-1] != key[s]).any():
                yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(b.iloc[s:e])
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
