"""Ranked lexical search over bit-sliced Bloom signatures.

The index cuts documents into blocks of similar vocabulary.  A block is a
matrix of bits: a row for each slot of a Bloom filter, a column for each
document.  The rows of a term's slots, ANDed, are a bitmap of the documents that
may hold it: never too few, now and then too many.  A term is entered once for
each of a few least counts (LEVELS) that it reaches in the document, so the
bitmaps also bound its count from above.

A search adds up, slice by slice, the weights of a query's terms times what a
count of that level can yield in a document of that length: an upper bound of
every document's score.  The documents with the greatest bounds are scored
exactly; the k-th best of them is a score that the k-th best of all reaches at
least, so a document whose bound is below it is provably excluded.  All others
are scored exactly from their texts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, small

#: A term is a run of ASCII letters and digits and of other than ASCII characters; A-Z is lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Least counts of a term in a document that are entered on their own.
LEVELS = (1, 2, 3, 5, 9)
#: Slots a key, at least, before rounding up to a power of two; rows ANDed for a key; most slots (21 bits of the hash each).
PER_KEY, ROWS, MOST_SLOTS = 8, 3, 1 << 21
#: Documents of a block, and slots times documents of a block, at most.
BLOCK, CELLS = 1024, 1 << 23
#: Documents scored first for each query, for each result asked for.
SEEDS = 5
#: Characters of the queries that are searched together.
QUERY_CHARS = 4 << 20
#: Terms whose documents a task counts before it hands the counts on.
COUNTED = 300_000

_GAP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) > COUNTED:
            self.clear()
        self[term] = h = xxhash.xxh3_64_intdigest(term)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    """The keys under which terms are entered for a level."""
    return _mix(hashes + np.uint64(_GAP * (level + 1) & _MASK))


def slots_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The ROWS slots of each key."""
    return np.stack([(keys >> np.uint64(21 * i)) & np.uint64(slots - 1) for i in range(ROWS)]).astype(np.int64)


def signature(columns: list[np.ndarray], slots: int) -> np.ndarray:
    """The bits of a block: a row a slot, 8 documents a byte, for each document's keys."""
    wide = np.zeros((slots, -(-len(columns) // 8) * 8), np.uint8)
    for d, keys in enumerate(columns):
        wide[slots_of(keys, slots).ravel(), d] = 1
    return np.packbits(wide, axis=1, bitorder="little")


def _indexed(batches):
    """Rows of the index: blocks (slots, bits, keys, n, docs, total) and counts of documents by term (terms, df)."""
    hashes, df, open_ = _Hashes(), Counter(), {}
    kinds = pa.schema([
        ("slots", pa.int32()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
        ("docs", pa.int64()), ("total", pa.int64()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())),
    ])

    def block(slots: int):
        ids, n, columns = zip(*open_.pop(slots))
        row = {"slots": slots, "bits": signature(columns, slots).tobytes(), "keys": ids, "n": n, "docs": len(n), "total": sum(n)}
        return pa.RecordBatch.from_pylist([row], kinds)

    def counted():
        row = {"terms": [t.decode("utf-8", "surrogatepass") for t in df], "df": list(df.values())}
        df.clear()
        return pa.RecordBatch.from_pylist([row], kinds)

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            found = Counter(terms(text.as_py()))
            if not found:
                continue
            df.update(found.keys())
            h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
            tf = np.fromiter(found.values(), np.int64, len(found))
            keys = np.concatenate([level_keys(h[tf >= least], i) for i, least in enumerate(LEVELS)])
            slots = min(MOST_SLOTS, 1 << (PER_KEY * len(keys) - 1).bit_length())
            some = open_.setdefault(slots, [])
            some.append((key.as_py(), int(tf.sum()), keys))
            if len(some) >= min(BLOCK, max(8, CELLS // slots)):
                yield block(slots)
            if len(df) > COUNTED:
                yield counted()
    for slots in list(open_):
        yield block(slots)
    if df:
        yield counted()


_INDEX = "slots int, bits binary, keys array<long>, n array<long>, docs long, total long, terms array<string>, df array<long>"


def gain(tf, m):
    """What ``tf`` occurrences yield in a document of length norm m, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


#: No count yields more.
MOST_GAIN = 1_000_000


def norm(n, total: int, docs: int):
    return 100 - 75 + (75 * n * docs) // total


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """A block of queries with the weights of their terms: what the tasks of a search need."""

    docs: int
    total: int
    hashes: np.ndarray
    #: term -> its number
    number: dict[bytes, int]
    #: query -> (numbers of its terms, weight times repeats of each)
    items: dict[int, tuple[np.ndarray, np.ndarray]]

    def bounds(self, slots: int, bits: np.ndarray, n: np.ndarray, cache: dict):
        """(query, upper bounds of the scores of a block's documents) of the queries that have one above 0."""
        if slots not in cache:
            cache[slots] = [slots_of(level_keys(self.hashes, i), slots) for i in range(len(LEVELS))]
        maps, held = [], None
        for rows in cache[slots]:
            one = bits[rows[0]]
            for r in rows[1:]:
                one &= bits[r]
            held = one if held is None else held & one
            maps.append((held, held.any(axis=1)))
        m = norm(n, self.total, self.docs)
        most = [gain(least - 1, m) for least in LEVELS[1:]] + [np.full(len(n), MOST_GAIN)]
        steps = [most[0], *(b - a for a, b in zip(most, most[1:]))]
        for q, (at, w) in self.items.items():
            bound = None
            for (held, some), step in zip(maps, steps):
                here = some[at]
                if not here.any():
                    break
                slices = np.unpackbits(held[at[here]], axis=1, count=len(n), bitorder="little")
                add = (w[here].astype(np.float64) @ slices).astype(np.int64) * step  # whole numbers far below 2**53
                bound = add if bound is None else bound + add
            if bound is not None:
                yield q, bound

    def score(self, found: Counter, m: int, q: int) -> int:
        at, w = self.items[q]
        return sum(x * gain(tf, m) for t, x in zip(at.tolist(), w.tolist()) if (tf := found.get(t)))


def _blocks(batches):
    for batch in batches:
        for slots, bits, keys, n in zip(*(batch.column(c) for c in ("slots", "bits", "keys", "n"))):
            n, keys = n.values.to_numpy(), keys.values.to_numpy()
            slots = slots.as_py()
            yield slots, np.frombuffer(bits.as_buffer(), np.uint8).reshape(slots, -1), keys, n


_FOUND = pa.schema([("q", pa.int64()), ("key", pa.int64()), ("bound", pa.int64())])


def _best_bounds(shared, k: int):
    """The k greatest bounds of each query within a task."""

    def run(batches):
        queries, cache, best = shared.value, {}, {}
        for slots, bits, keys, n in _blocks(batches):
            for q, bound in queries.bounds(slots, bits, n, cache):
                heap = best.setdefault(q, [])
                top = np.argpartition(bound, -k)[-k:] if len(bound) > k else np.arange(len(bound))
                for b, key in zip(bound[top].tolist(), keys[top].tolist()):
                    if b > 0 and (len(heap) < k or (b, key) > heap[0]):
                        (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (b, key))
            if len(best) * k > 1_000_000:  # more queries than a task should hold results of
                yield from _found(best)
        yield from _found(best)

    def _found(best):
        rows = [(q, key, b) for q, heap in best.items() for b, key in heap]
        best.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_FOUND)

    return run


def _not_excluded(shared, least):
    """Every (query, document) whose bound reaches the query's least score."""

    def run(batches):
        queries, floor, cache = shared.value, least.value, {}
        for slots, bits, keys, n in _blocks(batches):
            found = []
            for q, bound in queries.bounds(slots, bits, n, cache):
                at = np.flatnonzero(bound >= floor.get(q, 1))
                if len(at):
                    found.append((np.full(len(at), q), keys[at], bound[at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_FOUND)

    return run


def _scored(shared):
    """Exact scores (q, doc_id, score) of documents for the queries that they come with."""

    def run(batches):
        queries = shared.value
        number = queries.number
        for batch in batches:
            of, qs, scores = [], [], []
            for at, (text, wanted) in enumerate(zip(batch.column(1), batch.column(2))):
                words = terms(text.as_py())
                m = norm(len(words), queries.total, queries.docs)
                found = Counter(i for w in words if (i := number.get(w)) is not None)
                for q in wanted.as_py():
                    if (s := queries.score(found, m, q)) > 0:
                        of.append(at)
                        qs.append(q)
                        scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(scores, pa.int64())], ["q", "doc_id", "score"])

    return run


class Index:
    """The signatures of all ``docs`` (doc_id, text) as tables in the shared folder, ready to be searched."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "bitsliced")
        #: a row's key names its id and text, so rows with a common or no id are told apart
        self.docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
        made = self.docs.select("key", "text").where("text is not null").mapInArrow(_indexed, _INDEX)
        self.table = self.scratch.write(made, "index")
        self.blocks = self.table.where("bits is not null").select("slots", "bits", "keys", "n")
        docs_, total = self.table.agg(F.sum("docs"), F.sum("total")).first()
        self.n_docs, self.n_terms = docs_ or 0, total or 0

    def _queries(self, items: list) -> Queries:
        """Queries of collected (q, text) rows, weighed by the exact document counts of their terms."""
        counts = {q: Counter(terms(text)) for q, text in items}
        vocabulary = sorted({t for c in counts.values() for t in c})
        wanted = self.spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in vocabulary], "term string")
        entered = self.table.where("df is not null").select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select("e.terms", "e.df")
        here = entered.join(small(wanted, len(vocabulary)), entered.terms == wanted.term, "left_semi")
        df = {r.terms.encode("utf-8", "surrogatepass"): r.df for r in here.groupBy("terms").agg(F.sum("df").alias("df")).collect()}
        weights = {t: w for t in vocabulary if t in df and (w := weight(df[t], self.n_docs)) > 0}
        number = {t: i for i, t in enumerate(weights)}
        by = {}
        for q, c in counts.items():
            held = [t for t in c if t in number]
            if held:
                by[q] = np.array([number[t] for t in held]), np.array([c[t] * weights[t] for t in held], np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in weights], np.uint64)
        return Queries(self.n_docs, self.n_terms, hashes, number, by)

    def _score(self, found: DataFrame, rows: int, shared, id_type: str) -> DataFrame:
        """Exact scores of the documents found, each text read once for all its queries."""
        wanted = found.groupBy("key").agg(F.collect_set("q").alias("qs"))
        texts = self.docs.join(small(wanted, rows), "key").select("doc_id", "text", "qs")
        return texts.mapInArrow(_scored(shared), f"q long, doc_id {id_type}, score long")

    def _search(self, items: list, k: int, name: str) -> DataFrame:
        """(q, rank, doc_id, score) of a block of queries."""
        sc, id_type = self.spark.sparkContext, self.docs.schema["doc_id"].dataType.simpleString()
        shared = sc.broadcast(self._queries(items))
        rank = Window.partitionBy("q")
        # Any documents may set the least score; good ones make it high.
        first = self.blocks.mapInArrow(_best_bounds(shared, SEEDS * k), "q long, key long, bound long")
        order = rank.orderBy(F.desc("bound"), "key")
        seeds = self.scratch.write(first.withColumn("i", F.row_number().over(order)).where(f"i <= {SEEDS * k}").drop("i"), f"seeds-{name}")
        scored = self._score(seeds, SEEDS * k * len(items), shared, id_type)
        kth = scored.withColumn("i", F.row_number().over(rank.orderBy(F.desc("score")))).where(f"i = {k}")
        least = sc.broadcast({r.q: r.score for r in kth.select("q", "score").collect()})  # a row a query of the block
        left = self.scratch.write(self.blocks.mapInArrow(_not_excluded(shared, least), "q long, key long, bound long"), f"left-{name}")
        scored = self._score(left, left.count(), shared, id_type)
        order = rank.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("q", "rank", "doc_id", "score")
        return self.scratch.write(best, f"best-{name}")

    def search(self, items: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` best documents of every row of ``items`` (item_id, text): item_id, rank int, doc_id, score long.

        A document's score sums, over the item's terms with repeats,
        w * gain(tf, m): w is floor(1000 * ln((2N + 2) / (2df + 1))), m is
        25 + 75 n N div L; N counts the documents with a term, L their terms, n
        the document's.  Only scores above 0 rank; equal scores go by
        ascending doc_id, null last.

        Null and empty texts have no terms: such documents are not counted and
        such items find nothing.  Texts of any length are read whole; repeated
        rows are documents of their own, repeated items too; empty tables give
        an empty result; other columns are ignored, whatever their names.
        Items are searched in blocks of QUERY_CHARS characters.
        """
        rows = self.scratch.write(items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()), "items")
        chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        blocks, out = chars // QUERY_CHARS + 1, None
        for b in range(blocks):
            some = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).where("text is not null").select("q", "text")
            got = self._search([tuple(r) for r in some.collect()], k, str(b))  # a bounded block of the queries
            out = got if out is None else out.union(got)
        return out.join(rows.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
