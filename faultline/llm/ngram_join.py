"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the hashes of its distinct n-word shingles.  Sizes are
cut into bands whose ends have the ratio of the threshold, so two linked sets
lie in one band or in neighbouring ones; every set is signed for its own band
and, as the larger partner, for the band below.  If the smaller partner lies in
a band that ends at r, linked sets differ in at most k = r * (1 - t) / t
shingles.  The domain of shingles is cut into n1 groups of n2 partitions; a
signature is the content of n2 - k2 partitions of one group.  With
n1 * (k2 + 1) > k some group differs in k2 partitions at most, so linked sets
share a signature: no link is lost, and nothing is capped.

Equal sets become one class before any pair is formed.  Classes that share a
signature are compared with a hub of the shared bucket first; only buckets that
still hold several components afterwards are compared pair by pair, in blocks,
within tasks that return no more links than join the block's components.  A
parity sketch (whose Hamming distance never exceeds the sets' difference) throws
out false candidates before the exact comparison of the sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, components, small

#: Rows of a bucket compared by one task.
BLOCK = 256
#: Packed signatures that one task sorts, in bytes.
TASK_BYTES = 8 << 20
#: Signatures of a batch that are packed at once.
SLICE = 250_000
#: Groups of up to this many differing shingles are enumerated over 3 partitions of which 1 may differ.
N2, K2 = 3, 1

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; emptied when it grows past its bound, so long tasks stay small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle; no word, no shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(n, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix(acc * _C1 + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the hashes in at least 2 * len(s) bits, a power of two: xor-ing halves gives the sketch of half the size.

    Sets of one bucket differ in size by less than two, so a sketch that is
    folded to the least size there still has a bit for each of its hashes.
    """
    bits = max(64, 1 << (2 * max(1, len(s)) - 1).bit_length())
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    while a.shape[-1] > size:
        h = a.shape[-1] // 2
        a = a[..., :h] ^ a[..., h:]
    return a


class Bands:
    """Size bands for the threshold num / den and the signatures of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ends, low = [], 1
        while low < 1 << 40:
            ends.append(low * den // num)
            low = ends[-1] + 1
        self.ends = np.array(ends, np.int64)
        self._plans: dict[int, tuple] = {}

    def plan(self, band: int) -> tuple:
        """(bounds of the partitions, first and second member of each subset, salts) of a band."""
        if band not in self._plans:
            k = int(self.ends[band]) * (self.den - self.num) // self.num
            if k == 0:
                n1, n2, keep = 1, 1, 1
            else:
                n1, n2, keep = k // (K2 + 1) + 1, N2, N2 - K2
            parts = n1 * n2
            bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
            subsets = np.array([[g * n2 + i for i in c] for g in range(n1) for c in combinations(range(n2), keep)])
            salt = mix(np.arange(len(subsets), dtype=np.uint64) + np.uint64((band + 1) << 32))
            self._plans[band] = bounds, subsets, salt
        return self._plans[band]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set.  Partitions are ranges of the hash, so they are slices of the set."""
        own = int(np.searchsorted(self.ends, len(s)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + _C1), dtype=np.uint64)])
        out = []
        for band in (own, own - 1) if own else (own,):
            bounds, subsets, salt = self.plan(band)
            at = np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]])
            part = total[at[1:]] - total[at[:-1]]
            sig = salt.copy()
            for i in range(subsets.shape[1]):
                sig = mix(sig * _C1 + part[subsets[:, i]])
            out.append(sig)
        return np.concatenate(out)


def _rows(batch: pa.RecordBatch):
    """(doc_id, text) of a batch one by one, so that only one text is a Python string at a time."""
    for doc, text in zip(batch.column(0), batch.column(1)):
        yield doc.as_py(), text.as_py()


def _info(n: int):
    def run(batches):
        words = _Words()
        for b in batches:
            rows = []
            for doc, text in _rows(b):
                s = shingle_set(text, n, words)
                f1, f2 = (int(np.sum(mix(x), dtype=np.uint64).astype(np.int64)) for x in (s, s ^ _C1))
                rows.append((doc, len(s), f1, f2, sketch(s)))
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "n", "f1", "f2", "sketch"]), preserve_index=False)

    return run


def _sign(n: int, num: int, den: int, parts: int):
    """Rows (part, docs, sigs, shared): signatures and their documents, packed by the task that will sort them.

    Within one slice of a batch, equal sets are signed once, and a signature of
    several documents travels once to its task; all its documents are named in
    a ``shared`` row, which goes to a task by the slice instead.  So the entries
    of one hot signature in its task are as many as slices.
    """

    def packed(ids: np.ndarray, sig: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((of, sig))
        sig, of = sig[order], of[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        several = ~(new & np.concatenate([new[1:], [True]]))
        rows = []
        if several.any():
            part = int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(parts))
            rows.append((part, ids[of[several]].tobytes(), sig[several].tobytes(), True))
        sig, of = sig[new], of[new]
        part = ((mix(sig) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, sig, docs = part[order], sig[order], ids[of[order]]
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        rows += [(int(part[i]), docs[i:j].tobytes(), sig[i:j].tobytes(), False) for i, j in zip(cut, cut[1:])]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "docs", "sigs", "shared"])

    def run(batches):
        words, bands = _Words(), Bands(num, den)
        for b in batches:
            ids, sigs, of, seen, held = [], [], [], set(), 0
            for at, (doc, text) in enumerate(_rows(b)):
                s = shingle_set(text, n, words)
                if len(s) and (key := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                    seen.add(key)
                    sigs.append(bands.signatures(s))
                    of.append(np.full(len(sigs[-1]), len(ids), np.int32))
                    ids.append(doc)
                    held += len(sigs[-1])
                if ids and (held >= SLICE or at == b.num_rows - 1):
                    yield packed(np.array(ids, np.int64), np.concatenate(sigs), np.concatenate(of))
                    ids, sigs, of, seen, held = [], [], [], set(), 0

    return run


def _shared(batches):
    """Of one task's packed signatures, the (sig, doc_id) rows of those that several documents have."""
    sigs, docs = [], []
    for b in batches:
        for s, d, flag in zip(b["sigs"], b["docs"], b["shared"]):
            s, d = np.frombuffer(s, np.int64), np.frombuffer(d, np.int64)
            if flag:
                yield pd.DataFrame({"sig": s, "doc_id": d})
            else:
                sigs.append(s)
                docs.append(d)
    if sigs:
        s, d = np.concatenate(sigs), np.concatenate(docs)
        sigs.clear()
        docs.clear()
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        same = s[1:] == s[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        s, d = s[keep], d[keep]
        for i in range(0, len(s), 200_000):
            yield pd.DataFrame({"sig": s[i : i + 200_000], "doc_id": d[i : i + 200_000]})


def _allowed(x: int, y: np.ndarray, size: np.ndarray, sk: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``y`` that sizes and sketches allow to be linked to x."""
    lo, hi = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    y = y[hi * num <= lo * den]
    far = np.bitwise_count(sk[y] ^ sk[x]).sum(axis=1, dtype=np.int64)
    return y[far * (num + den) <= (size[x] + size[y]) * (den - num)]


def _sides(run: pd.DataFrame, i: int, j: int):
    """For each row of block i, the rows of block j that it is compared with."""
    doc, side = run["rep"].to_numpy(np.int64), run["block"].to_numpy(np.int64)
    right = np.flatnonzero(side == j)
    for x in np.flatnonzero(side == i):
        yield x, right[(doc[right] > doc[x]) if i == j else slice(None)]


def _hopeful(num: int, den: int):
    """The rows (sig, rep, comp) of a run that the sketches allow a link to another component."""

    def find(run: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        comp, size = run["comp"].to_numpy(np.int64), run["n"].to_numpy(np.int64)
        least = min(map(len, run["sketch"]))
        sk = np.stack([_fold(np.frombuffer(x, np.uint8), least) for x in run["sketch"]])
        on = np.zeros(len(run), bool)
        for x, y in _sides(run, i, j):
            y = _allowed(x, y[comp[y] != comp[x]], size, sk, num, den)
            on[y] = True
            on[x] |= len(y) > 0
        return run.loc[on, ["sig", "rep", "comp"]]

    return _by_run(find)


def _in_blocks(num: int, den: int):
    """Links (a, b) within a run that join its components: at most one fewer than it has.

    Rows carry their sets, so a pair that the sketches allow is compared exactly
    here, and a pair whose components have met is not compared at all.  What
    leaves the task grows with the rows of a run, not with their pairs.
    """

    def find(run: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        doc, sets = run["rep"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in run["items"]]
        size = np.array([len(s) for s in sets])
        sketches = [np.frombuffer(sketch(s), np.uint8) for s in sets]
        least = min(map(len, sketches))
        sk = np.stack([_fold(x, least) for x in sketches])
        _, label = np.unique(run["comp"].to_numpy(np.int64), return_inverse=True)  # merged as links are found
        out = []
        for x, y in _sides(run, i, j):
            for at in _allowed(x, y[label[y] != label[x]], size, sk, num, den).tolist():
                if label[at] != label[x]:
                    both = len(np.intersect1d(sets[x], sets[at], assume_unique=True))
                    if den * both >= num * (size[x] + size[at] - both):
                        label[label == label[at]] = label[x]
                        out.append((min(doc[x], doc[at]), max(doc[x], doc[at])))
        return pd.DataFrame(out, columns=["a", "b"])

    return _by_run(find)


def _by_run(find):
    """Applies find(rows, i, j) to each (sig, i, j) run of sorted rows, across batch borders."""

    def run(batches):
        rest = None
        for b in _then_none(batches):
            if b is not None:
                rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if rest is None or not len(rest):
                continue
            key = rest[["sig", "i", "j"]].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            ends = [*cut[1:], len(rest)]
            done = list(zip(cut, ends)) if b is None else list(zip(cut, ends))[:-1]
            out = [find(rest.iloc[s:e].reset_index(drop=True), int(key[s, 1]), int(key[s, 2])) for s, e in done if e - s > 1]
            out = [o for o in out if len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
            rest = None if b is None else rest.iloc[cut[-1] :]

    return run


def _in_runs(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (sig, rep, comp, many, ..) dealt out as runs of two blocks of a bucket, sorted by (sig, i, j)."""
    dealt = (
        rows.withColumn("blocks", (F.col("many") / BLOCK).cast("int") + 1)
        .withColumn("block", F.pmod(F.xxhash64("rep", "sig"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", *more)
    )
    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def _then_none(batches):
    yield from batches
    yield None


def _sets(n: int):
    """(doc_id, items) with the shingle hashes of each text."""

    def run(batches):
        words = _Words()
        for b in batches:
            held, size = [], 0
            for at, (doc, text) in enumerate(_rows(b)):
                held.append((doc, shingle_set(text, n, words).view(np.int64)))
                size += len(held[-1][1])
                if size >= SLICE or at == b.num_rows - 1:
                    ends = np.cumsum([0, *(len(s) for _, s in held)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s for _, s in held])))
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), lists], ["doc_id", "items"])
                    held, size = [], 0

    return run


def _set_bytes(n: int):
    """(rep, items) with the shingle hashes of each text as bytes."""

    def run(batches):
        words = _Words()
        for b in batches:
            for doc, text in _rows(b):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([shingle_set(text, n, words).tobytes()], pa.binary())], ["rep", "items"])

    return run


class _Join:
    """State of one join: class table, known sets, links found so far."""

    def __init__(self, scratch: Scratch, docs: DataFrame, reps: DataFrame, n: int, num: int, den: int):
        self.scratch, self.docs, self.reps, self.n, self.num, self.den = scratch, docs, reps, n, num, den
        self.links: DataFrame | None = None
        self.round = 0

    def verify(self, pairs: DataFrame) -> int:
        """Adds the pairs (a, b) of classes that are linked to the links; returns how many passed the sketches."""
        num, den, n, r = self.num, self.den, self.n, self.round

        @F.pandas_udf("boolean")
        def near(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
            out = []
            for i, j, k in zip(x, y, (p + q) * (den - num)):
                a, b = np.frombuffer(i, np.uint8), np.frombuffer(j, np.uint8)
                least = min(len(a), len(b))
                out.append(int(np.bitwise_count(_fold(a, least) ^ _fold(b, least)).sum()) * (num + den) <= k)
            return pd.Series(out)

        a = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        fit = (F.greatest("na", "nb") * num <= F.least("na", "nb") * den) & near("sa", "sb", "na", "nb")
        cand = self.scratch.write(pairs.join(a, "a").join(b, "b").where(fit).select("a", "b"), f"cand-{r}")
        count = cand.count()
        if count:
            ids = cand.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            found = self.docs.join(small(ids, 2 * count), "doc_id", "left_semi").select("doc_id", "text")
            items = self.scratch.write(found.mapInArrow(_sets(n), "doc_id long, items array<long>"), f"sets-{r}")
            x = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
            y = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
            both = F.size(F.array_intersect("x", "y"))
            linked = den * both >= num * (F.size("x") + F.size("y") - both)
            got = self.scratch.write(cand.join(x, "a").join(y, "b").where(linked).select("a", "b"), f"links-{r}")
            self.links = got if self.links is None else self.links.union(got)
            self.scratch.drop(f"sets-{r}")
        self.round += 1
        return count

    def add(self, links: DataFrame) -> None:
        """Adds pairs that are known to be linked."""
        got = self.scratch.write(links, f"links-{self.round}")
        self.links = got if self.links is None else self.links.union(got)
        self.round += 1

    def labels(self) -> DataFrame:
        """(rep, comp) of the linked classes so far."""
        if self.links is None:
            return self.reps.select("rep", F.col("rep").alias("comp")).limit(0)
        got = components(self.scratch, self.links, f"cc-{self.round}")
        return self.scratch.write(got.select(F.col("node").alias("rep"), F.col("component").alias("comp")), f"label-{self.round}")


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows (sig, rep, comp, many) of the buckets that hold several components."""
    rows = shared.join(labels, "rep", "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"))
    return rows.join(several.where("lo <> hi").select("sig", "many"), "sig")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of ``docs`` (doc_id long unique, text string).

    Two documents link when den * |A and B| >= num * |A or B| for the sets of
    their distinct n-word shingles (A-Z lower-cased, ASCII white space between
    words).  component_id is the smallest doc_id reachable by links.

    A null or empty text, or one of white space only, has 0 shingles and is its
    own component; a text of fewer than n words is one shingle; texts of any
    length are read whole; equal sets are linked; an empty table gives an empty
    result; other columns of ``docs`` are ignored; rows with a null doc_id are
    left out, as they cannot be named.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    info = scratch.write(docs.mapInArrow(_info(n), "doc_id long, n long, f1 long, f2 long, sketch binary"), "info")
    classes = info.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = scratch.write(
        info.select(F.col("doc_id").alias("rep"), "n", "sketch").join(classes.select("rep"), "rep", "left_semi"), "reps"
    )
    named = scratch.write(
        info.drop("sketch").join(classes, ["n", "f1", "f2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")),
        "named",
    )
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # about 2 bands * 1.5 signatures a differing shingle
    packed = 3 * 8 * total * (den - num) // num
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed // TASK_BYTES + 1)
    signed = docs.mapInArrow(_sign(n, num, den, parts), "part int, docs binary, sigs binary, shared boolean")
    dealt = signed.repartitionById(parts, F.col("part")).select("docs", "sigs", "shared")
    raw = scratch.write(dealt.mapInPandas(_shared, "sig long, doc_id long"), "raw")
    by_rep = raw.join(named.select("doc_id", "rep"), "doc_id").select("sig", "rep").distinct()
    shared = scratch.write(by_rep, "shared")
    scratch.drop("raw")

    # Hubs: in every mixed bucket one class meets those of the other components.
    join, left = _Join(scratch, docs, reps, n, num, den), None
    while True:
        labels = join.labels()
        mixed = scratch.write(_mixed(shared, labels), f"mixed-{join.round}")
        now = mixed.count()
        if now == 0 or (left is not None and now > 0.7 * left):
            break
        left = now
        order = F.struct(F.xxhash64("rep", F.lit(join.round)), "rep", "comp")
        hub = mixed.groupBy("sig").agg(F.min(order).alias("h")).select("sig", F.col("h.rep").alias("hub"), F.col("h.comp").alias("hc"))
        star = mixed.join(hub, "sig").where("comp <> hc").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        join.verify(star.distinct())
    if now:
        # Exact rest: every pair of different components within the buckets that are still mixed.
        two = mixed.where("many = 2").groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).select("a", "b")
        join.verify(two.distinct())
        left = _in_runs(mixed.where("many > 2").join(reps, "rep"), "n", "sketch")
        # few rows have a candidate at all; only these are compared with their sets
        hopeful = left.mapInPandas(_hopeful(num, den), "sig long, rep long, comp long").distinct()
        hopeful = scratch.write(hopeful, "hopeful")
        need = scratch.write(hopeful.select(F.col("rep").alias("doc_id")).distinct(), "need")
        texts = docs.join(small(need, need.count()), "doc_id", "left_semi").select("doc_id", "text")
        sets = scratch.write(texts.mapInArrow(_set_bytes(n), "rep long, items binary"), "sets")
        many = hopeful.groupBy("sig").agg(F.count("*").alias("many"))
        runs = _in_runs(hopeful.join(many, "sig").join(sets, "rep"), "items")
        join.add(runs.mapInPandas(_in_blocks(num, den), "a long, b long").distinct())
        scratch.drop("sets", "hopeful")
        labels = join.labels()
    comp = named.join(labels, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    return scratch.write(comp, "result")
