"""URL filtering with Bloom filter cascades.

The keys of a URL are the ends of its host joined with the beginnings of its
path, in the label counts and lengths that rules have: the only strings that a
rule could equal.  The distinct keys of all URLs are the key universe.  Level 0
of a cascade is a Bloom filter of the listed keys, level 1 one of the keys that
level 0 takes in wrongly, level 2 one of the listed keys that level 1 takes in,
and so on until a level errs on no key.  The first level that a key is not in
decides, so membership of every key of the universe is exact, and URLs are
judged by probing broadcast bits: no join.

A cascade is broadcast only while its first level, by the counted number of
listed keys, is within a bound.  Beyond it the keys are cut by hash into slices,
each with a cascade within the bound, and the URLs are judged slice by slice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, Scratch

#: Bits of the first level of a cascade that may be broadcast (64 MB).
MOST_BITS = 1 << 29
#: The place of a key that no cascade holds.
NOWHERE = (1 << 31) - 1


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys of a URL, the longest first."""
    parts = F.split(host, r"\.")
    ends = F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n)), ".")) for n in labels
    ])
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    both = F.flatten(F.transform(F.filter(ends, lambda e: e.isNotNull()), lambda e: F.transform(F.filter(starts, lambda s: s.isNotNull()), lambda s: F.concat(e, s))))
    sized = F.transform(F.array_distinct(both), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(sized), lambda x: x["k"])


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit numbers of keys, a row a key; every level uses other bits."""
    a, b = h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1), h2.view(np.uint64) | np.uint64(1)
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    a = a ^ (a >> np.uint64(31))
    i = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + i * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """Levels of (bits as words, number of bits, hashes)."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        words, bits, hashes = self.levels[level]
        at = _positions(h1, h2, level, hashes, bits)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For keys of the universe: whether they are listed."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h1), bool)
        for level in range(len(self.levels)):
            i = np.flatnonzero(open_)
            stop = i[~self.passes(level, h1[i], h2[i])]
            out[stop], open_[stop] = level % 2 == 1, False
        return out


def _size(n: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and hashes for n keys: the first level errs on as many others as there are keys, further ones on half."""
    p = min(0.5, math.sqrt(0.5) * n / max(others, 1)) if first else 0.5
    return max(64, math.ceil(n * math.log(1 / p) / math.log(2) ** 2)), max(1, round(math.log2(1 / p)))


def _bits(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """The words of a Bloom filter, combined on the executors; as many bits as were asked for reach the driver."""

    def words(batches):
        for b in batches:
            at = np.unique(_positions(b["h1"].to_numpy(), b["h2"].to_numpy(), level, hashes, bits))
            word, first = np.unique(at >> 6, return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pd.DataFrame({"word": word, "value": value.view(np.int64)})

    got = keys.select("h1", "h2").mapInPandas(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros((bits + 63) // 64, np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _taken(shared, level: int):
    @F.pandas_udf("boolean")
    def taken(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(level, a.to_numpy(), b.to_numpy()))

    return taken


def build(scratch: Scratch, listed: DataFrame, others: DataFrame, name: str) -> Cascade:
    """The cascade of ``listed`` (h1, h2) against ``others`` (h1, h2), which together are the universe."""
    spark, out = scratch.spark, Cascade()
    sets = [listed, others]
    n = [listed.count(), others.count()]
    while n[len(out.levels) % 2]:
        level = len(out.levels)
        mine, other = level % 2, 1 - level % 2
        bits, hashes = _size(n[mine], n[other], level == 0)
        out.levels.append((_bits(sets[mine], level, bits, hashes), bits, hashes))
        taken = _taken(spark.sparkContext.broadcast(out), level)
        sets[other] = scratch.write(sets[other].where(taken("h1", "h2")), f"{name}-{level}")
        n[other] = sets[other].count()
    return out


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """``urls`` with host, path, rule and verdict strings added.

    ``rules`` are (host, path, verdict) with the verdicts allow and block.  A
    rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest rule that fits decides (of equally long ones the first
    by code point), and is returned as host + path.  Of one rule given twice the
    first counts.  Without one, rule is null and the
    URL, being in no cascade, gets ``default``.

    A null URL and one without ``://`` have an empty host and path and no rule;
    empty and very long URLs are judged whole; repeated rows are treated alike;
    without rules every URL gets ``default``; an empty table gives an empty
    result; other columns are kept, but for those named host, path, rule or
    verdict, which are replaced.
    """
    spark = urls.sparkSession
    scratch = Scratch(spark, "urls")
    verdict_of: dict[str, str] = {}
    for host, path, verdict in rules:
        verdict_of.setdefault(host.lower() + path, verdict)
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    urls = urls.drop("host", "path", "rule", "verdict")
    host, path = host_path(F.col(url_col))
    urls = urls.withColumns({"host": host, "path": path})
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    names = keys_of(F.col("host"), F.col("path"), labels, lengths)
    universe = scratch.write(
        urls.select(F.explode(names).alias("key")).distinct().select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "universe",
    )
    listing = spark.createDataFrame(sorted(verdict_of.items()), "key string, verdict string")
    marked = scratch.write(universe.join(listing, "key", "left"), "marked")
    total, known = marked.agg(F.count("*"), F.count("verdict")).first()
    slices = _size(known, total - known, True)[0] // most_bits + 1 if known else 1
    out = urls.withColumns({"__at": F.lit(NOWHERE), "__verdict": F.lit(None).cast("string")})
    for g in range(slices):
        part = marked.where(F.pmod("h1", F.lit(slices)) == g)
        made = {
            v: build(scratch, part.where(F.col("verdict") == v), part.where(F.col("verdict").isNull() | (F.col("verdict") != v)), f"{v}-{g}")
            for v in ("allow", "block")
        }
        out = _probe(out, made, slices, g, names)
        out = scratch.write(out, f"slice-{g}") if slices > 1 else out
    rule = F.when(F.col("__at") < NOWHERE, F.try_element_at(names, F.col("__at") + 1))
    return out.withColumns({"rule": rule, "verdict": F.coalesce("__verdict", F.lit(default))}).drop("__at", "__verdict")


def _probe(urls: DataFrame, made: dict[str, Cascade], slices: int, g: int, names: Column) -> DataFrame:
    """``urls`` with __at, the place of the first of a row's keys that a cascade so far holds (or NOWHERE), and its __verdict."""
    shared = urls.sparkSession.sparkContext.broadcast(made)
    kept = [c for c in urls.columns if c not in ("__at", "__verdict")]
    hashes = [F.transform(names, lambda k: F.xxhash64(k)), F.transform(names, lambda k: F.xxhash64(F.lit(1), k))]

    def run(batches):
        for b in batches:
            n = np.diff(b.column(len(kept) + 2).offsets.to_numpy())
            h1, h2 = (b.column(len(kept) + i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at, verdict = b.column(len(kept)).to_numpy(zero_copy_only=False).copy(), b.column(len(kept) + 1).to_numpy(zero_copy_only=False).copy()
            here = h1 % slices == g
            for v, cascade in shared.value.items():
                hit = np.zeros(len(h1), bool)
                hit[here] = cascade.contains(h1[here], h2[here])
                best = np.full(len(n), NOWHERE)
                np.minimum.at(best, row[hit], place[hit])
                sooner = best < at
                at[sooner], verdict[sooner] = best[sooner], v
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(at, pa.int32()), pa.array(verdict, pa.string())], [*kept, "__at", "__verdict"]
            )

    rows = urls.select(*kept, "__at", "__verdict", hashes[0].alias("__h1"), hashes[1].alias("__h2"))
    return rows.mapInArrow(run, urls.select(*kept, "__at", "__verdict").schema)
