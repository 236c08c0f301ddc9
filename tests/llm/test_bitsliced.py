"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faultline.llm import bitsliced as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Rows (item_id, rank, doc_id, score) by scoring all documents, as a multiset."""
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c in bags:
            m, s = 25 + 75 * sum(c.values()) * n // total, 0
            for t in split(text):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out[item, rank, d, -s] += 1
    return out


def made(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Größe", "été", "汉字", "naïve", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]

    def text(n):
        return " ".join(rng.choices(vocab, weights, k=n)).replace(" w7 ", "\x00W7--")

    docs = [(i, text(rng.choice([1, 5, 30, 120, 400]))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " .,;"), (1003, docs[4][1]), (4, docs[4][1]), (4, docs[4][1]), (4, "another text w3")]
    docs += [(None, docs[9][1]), (None, docs[9][1]), (None, "w399 w398"), (1004, " ".join(f"only{i}" for i in range(30_000)) + " w399 w12"), (1005, "w5 " * 20_000)]
    items = [(i, text(rng.choice([1, 8, 25]))) for i in range(20)]
    items += [(50, docs[12][1][:200]), (50, "w399 W399 w399 unseen"), (None, "w200 w201"), (51, None), (52, "--"), (53, "unseen only"), (54, "only7 only8 w5"), (54, "only7 only8 w5")]
    return docs, items


@pytest.mark.parametrize("k,block,chars", [(10, 1024, 1 << 22), (3, 16, 300), (1000, 64, 1 << 22)])
def test_search_matches_scoring_all(spark, monkeypatch, k, block, chars):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "QUERY_CHARS", chars)
    docs, items = made()
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, q int, key string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, q int")
    got = Counter(tuple(r) for r in B.Index(d).search(i, k).collect())
    assert got == ranked(docs, items, k)


def test_bounds_hold_and_exclude():
    docs, items = made(1)
    bags = [Counter(B.terms(t)) for _, t in docs if B.terms(t)]
    n, total = len(bags), sum(sum(c.values()) for c in bags)
    df = Counter(t for c in bags for t in c)
    weights = {t: w for t in df if (w := B.weight(df[t], n)) > 0}
    number = {t: i for i, t in enumerate(weights)}
    by = {}
    for q, (_, text) in enumerate(items):
        c = Counter(t for t in B.terms(text) if t in number)
        if c:
            by[q] = np.array([number[t] for t in c]), np.array([weights[t] * x for t, x in c.items()])
    hashes = np.array([B.xxhash.xxh3_64_intdigest(t) for t in weights], np.uint64)
    queries = B.Queries(n, total, hashes, number, by)
    slots, tight = 1 << 12, []
    for start in range(0, n, 64):
        some = bags[start : start + 64]
        columns = []
        for c in some:
            h = np.array([B.xxhash.xxh3_64_intdigest(t) for t in c], np.uint64)
            tf = np.array(list(c.values()))
            columns.append(np.concatenate([B.level_keys(h[tf >= x], i) for i, x in enumerate(B.LEVELS)]))
        lengths = np.array([sum(c.values()) for c in some])
        for q, bound in queries.bounds(slots, B.signature(columns, slots), lengths, {}):
            for c, b, m in zip(some, bound, B.norm(lengths, total, n)):
                s = queries.score(Counter({number[t]: x for t, x in c.items() if t in number}), int(m), q)
                assert s <= b
                tight.append((s, b))
    assert sum(b for _, b in tight) < 1.25 * sum(s for s, _ in tight)


def test_few_documents_are_left(spark, sf):
    index = B.Index(spark.read.parquet(f"{sf}/documents.parquet"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index.search(items).collect()
    left = spark.read.parquet(f"{index.scratch.base}/left-0").count()
    assert left < 0.5 * items.count() * index.n_docs


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert B.Index(none).search(items).collect() == []
    assert B.Index(docs).search(items.limit(0)).collect() == []
    assert [tuple(r) for r in B.Index(docs).search(items).collect()] == list(ranked([(1, "a b")], [(1, "a")], 10))
