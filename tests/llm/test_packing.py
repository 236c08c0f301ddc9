"""Packing: the plan against exhaustive search, the pieces against the tokenizers library."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from faultline.llm.packing import best_fit, cut, pack, plan, reduce_dominated

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, size):
    """The least number of sequences, by trying all."""

    @lru_cache(None)
    def go(left, rooms):
        if not left:
            return 0
        s, rest, best = left[0], left[1:], 99
        for i, r in enumerate(rooms):
            if r >= s and r not in rooms[:i]:
                best = min(best, go(rest, tuple(sorted((*rooms[:i], *rooms[i + 1 :], r - s)))))
        return min(best, 1 + go(rest, tuple(sorted((*rooms, size - s)))))

    return go(tuple(sorted(items, reverse=True)), ())


def histogram(items, size):
    return np.bincount(np.array(items, int), minlength=size + 1)


def total(made, size):
    used = Counter()
    for pattern, times in made:
        assert times > 0 and 0 < sum(pattern) <= size
        for s in pattern:
            used[s] += times
    return used, sum(t for _, t in made)


@pytest.mark.parametrize("seed", range(12))
def test_fixed_sets_keep_the_optimum(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        size = int(rng.integers(8, 31))
        low = int(rng.integers(1, size // 2))
        items = rng.integers(low, size + 1, rng.integers(1, 10)).tolist()
        fixed, left = reduce_dominated(histogram(items, size), size)
        rest = [s for s, n in enumerate(left) for _ in range(n)]
        used, n = total(fixed, size)
        assert used + Counter(rest) == Counter(items)
        assert n + fewest(rest, size) == fewest(items, size)


def one_by_one(items, size):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(size - s)
    return len(rooms)


def test_grouped_best_fit_is_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = int(rng.integers(5, 60))
        items = rng.integers(1, size + 1, rng.integers(0, 80)).tolist()
        used, n = total(best_fit(histogram(items, size), size), size)
        assert used == Counter(items) and n == one_by_one(items, size)


def test_many_documents_come_near_the_bound():
    rng = np.random.default_rng(1)
    items = np.minimum(1 + rng.lognormal(6, 1, 200_000).astype(int), 1024)
    made = plan(histogram(items, 1024), 1024)
    used, n = total(made, 1024)
    assert used == Counter(items.tolist())
    # no packing needs fewer than the total, or than the pieces above half a sequence
    assert n <= 1.002 * max(-(-items.sum() // 1024), int((items > 512).sum()))
    assert len(made) < 5000


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)]
    assert cut(9, 8) == [(0, 1), (1, 8)] and cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def check(rows, texts, size, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        for i, (start, n) in enumerate(cut(len(ids), size)):
            want[doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= size
    return len(at)


TEXTS = [
    (1, "one two three"), (2, None), (3, ""), (4, "<|endoftext|> a  \n b"), (None, "nobody"), (None, "nobody"), (7, "x " * 500),
    (7, "same id"), (7, "same id"), (8, " " * 300_000 + "x"), (9, "Ünïcödé \x85 　 汉字 " * 40),
]


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_pieces_and_places(spark, size):
    docs = spark.createDataFrame([(*t, 1, 2, 3) for t in TEXTS], "doc_id long, text string, part int, length int, ids int").repartition(3)
    out = pack(docs, PATH, size=size, end=2)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(out.collect(), TEXTS, size, 2)
    ids = pack(docs, PATH, size=size, keep_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in ids)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs, PATH).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024, 2)
    assert n <= 1.01 * max(-(-sum(r.length for r in rows) // 1024), sum(r.length > 512 for r in rows)) + 1
