"""Documents packed into sequences of a fixed size: dominance reduction, then best fit.

The lengths of the pieces are whole numbers up to the sequence size, so an
instance of any number of documents is a histogram of at most ``size`` counts.
Its reduction follows Martello and Toth: a small set of pieces {j, ..} is fixed
as one sequence for good when it dominates every other set that holds j (the
others could be swapped for its pieces without needing more sequences), all
copies of such a set at once.  What is left goes by best fit, largest first,
again whole groups of equal sequences at a time.

The plan (kinds of sequences, how often each is used) is made of the histogram
alone.  Pieces find their place by their rank among the pieces of their length,
which Spark numbers in each task as it tokenises and then shifts by the counts of
the tasks before, so no task sorts or holds the pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.bpe import PIECE, Codec, Vocabulary
from faultline.llm.common import Scratch, ship, small

#: Kinds of sequences: (lengths of the pieces in their order, number of such sequences).
Plan = list[tuple[tuple[int, ...], int]]

#: Pieces of an output batch.
HELD = 2000

_PIECES = "piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


class _Left:
    """Pieces that are left, by length."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def up_to(self, limit: int, *without: int) -> int:
        """The largest length <= limit, not counting one piece for each of ``without``; 0 if there is none."""
        c = self.counts[: max(limit, 0) + 1]
        for s in reversed(np.flatnonzero(c)):
            if c[s] > without.count(s):
                return int(s)
        return 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces beside one of length ``without``."""
        out: list[int] = []
        for s in np.flatnonzero(self.counts):
            out += [int(s)] * min(n - len(out), int(self.counts[s]) - (s == without))
            if len(out) == n:
                break
        return out

    def best_pair(self, limit: int, without: int) -> int:
        """The largest sum <= limit of two pieces beside one of length ``without``; 0 if no two fit."""
        best = 0
        for y in np.flatnonzero(self.counts[: limit // 2 + 1]):
            if self.counts[y] > (y == without) and (z := self.up_to(limit - y, without, int(y))) >= y:
                best = max(best, int(y) + z)
        return best

    def uncovered(self, limit: int, without: int, a: int, b: int) -> bool:
        """Whether two pieces fit that (a, b) cannot stand in for: the smaller exceeds b and their sum exceeds a."""
        for y in np.flatnonzero(self.counts[: limit // 2 + 1]):
            if y > b and self.counts[y] > (y == without):
                z = self.up_to(limit - y, without, int(y))
                if z >= y and y + z > a:
                    return True
        return False

    def dominating(self, j: int, size: int) -> tuple[int, ...] | None:
        """A set that dominates all sets with a piece of length j, if one of up to three pieces is proven to."""
        rest = size - j
        x = self.up_to(rest, j)
        if x == 0:
            return (j,)
        if x == rest or sum(self.smallest(2, j) or [size]) > rest or len(self.smallest(2, j)) < 2:
            return (j, x)
        three = self.smallest(3, j)
        if len(three) == 3 and sum(three) <= rest:
            return None  # three others may fit
        if x >= self.best_pair(rest, j):
            return (j, x)
        b = self.up_to(rest - x, j, x)
        return (j, x, b) if b and not self.uncovered(rest, j, x, b) else None


def reduce_dominated(counts: np.ndarray, size: int) -> tuple[Plan, np.ndarray]:
    """Fixes dominating sets until none is found: (what is fixed, the counts that are left).

    A set that is proven once holds for all its copies: taking pieces away only
    leaves fewer sets to dominate.
    """
    left, fixed, changed = _Left(counts.copy()), [], True
    while changed:
        changed = False
        for j in range(size, 0, -1):
            while left.counts[j] and (found := left.dominating(j, size)):
                need = Counter(found)
                times = min(int(left.counts[s]) // n for s, n in need.items())
                for s, n in need.items():
                    left.counts[s] -= times * n
                fixed.append((found, times))
                changed = True
    return fixed, left.counts


def best_fit(counts: np.ndarray, size: int) -> Plan:
    """Best fit, largest pieces first, over whole groups of equal sequences."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], times: int, free: int) -> None:
        if times:
            room.setdefault(free, []).append((pattern, times))

    for s in range(size, 0, -1):
        todo = int(counts[s])
        while todo:
            free = min((f for f in room if f >= s), default=size)
            if free in room:
                pattern, times = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                pattern, times = (), -(-todo // (size // s))
            fit = free // s
            full = min(times, todo // fit)
            todo -= full * fit
            put(pattern + (s,) * fit, full, free - fit * s)
            if full < times:  # fewer pieces than one more sequence has room for
                put(pattern + (s,) * todo, 1, free - todo * s)
                put(pattern, times - full - 1, free)
                todo = 0
    return [g for groups in room.values() for g in groups]


def plan(counts: np.ndarray, size: int) -> Plan:
    fixed, left = reduce_dominated(counts, size)
    return fixed + best_fit(left, size)


def _slots(made: Plan, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, sequence, offset, base): slots of all lengths by the number of their first piece, and where lengths begin."""
    base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    used, sequence, rows = base[:-1].copy(), 0, []
    for pattern, times in made:
        offset = 0
        for s in pattern:
            rows.append((used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    first, seq, off = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return first, seq, off, base


class Tokens:
    """Ids of whole texts: the fast library where it can, the segment tree where its pattern runs out of stack."""

    def __init__(self, v: Vocabulary):
        ranks = {b: i for i, b in v.bytes.items() if i not in v.added.values()}
        self.fast = tiktoken.Encoding("pack", pat_str=PIECE, mergeable_ranks=ranks, special_tokens=v.added)
        self.codec = Codec(v)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            return np.frombuffer(self.codec.encode(text), "<u4")


def _tokens(shared) -> Tokens:
    """One tokenizer for a worker process."""
    if "it" not in _made:
        _made["it"] = Tokens(shared.value)
    return _made["it"]


_made: dict[str, Tokens] = {}


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or pieces of ``size`` of which only the first may be shorter."""
    head = (n - 1) % size + 1
    return [(0, head), *((i, size) for i in range(head, n, size))]


def _pieces(shared, size: int, end: int, keep_ids: bool):
    names = ["doc_id", *(c.split()[0] for c in _PIECES.split(", "))]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

    def run(batches):
        tokens, part = _tokens(shared), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            of, rows = [], []
            for at in range(batch.num_rows):
                ids = np.append(tokens.ids(texts[at].as_py() or ""), np.uint32(end)).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), size)):
                    raw = ids[start : start + n].tobytes()
                    of.append(at)
                    rows.append((i, start, n, zlib.crc32(raw), raw if keep_ids else None, part, int(seen[n])))
                    seen[n] += 1
                if len(rows) >= HELD or at == batch.num_rows - 1:
                    columns = (pa.array(c, k) for c, k in zip(zip(*rows), kinds))
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(of)), *columns], names)
                    of, rows = [], []

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Packs all ``docs`` (doc_id, text) into sequences of up to ``size`` tokens.

    A document is its ids by the tokenizer file at ``path`` and the id ``end``.
    Documents of more than ``size`` ids are cut into pieces of ``size``, the
    first of which may be shorter; others are never cut.  Returns a row per
    piece: doc_id, piece int (from 0), start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), sequence_id, offset (longs; offsets
    of a sequence are gapless from 0), and with ``keep_ids`` the ids (binary).

    A null or empty text is the single id ``end``; texts of any length are read
    whole; repeated rows and rows with a null doc_id are packed row by row;
    equal lengths are placed in the order they are read; an empty table gives
    an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack")
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_PIECES}"
    pieces = scratch.write(rows.mapInArrow(_pieces(shared, size, end, keep_ids), schema), "pieces")
    here = scratch.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(size + 1, np.int64)
    for length, n in here.groupBy("length").agg(F.sum("n")).collect():  # size rows at most
        counts[length] = n
    first, sequence, offset, base = _slots(plan(counts, size), counts)
    slots = spark.sparkContext.broadcast((first, sequence, offset, base))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = here.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = pieces.join(small(shift, here.count()), ["part", "length"])
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    placed = placed.select(*out, (F.col("nth") + F.col("shift")).alias("__rank"))

    def place(batches):
        first, sequence, offset, base = slots.value
        for b in batches:
            number = base[b.column("length").to_numpy()] + b.column("__rank").to_numpy()
            slot = np.searchsorted(first, number, "right") - 1
            kept = [b.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[slot] + number - first[slot]), pa.array(offset[slot])], [*out, "sequence_id", "offset"])

    return placed.mapInArrow(place, placed.select(*out).schema.add("sequence_id", "long").add("offset", "long"))
