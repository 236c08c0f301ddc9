"""Vector, URL and page operators, the registered queries and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm.oracle import SQL

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, seed=0, dim=32):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(300)]
    for i in range(60):
        rows.append(rows[i % 5] + 0.05 * rng.normal(size=dim))
    rows += [rows[7] * 2, rows[7], rows[8]]
    data = [(10 * i, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(rows)]
    odd = [(90001, None), (90002, [0.0] * dim), (90003, [float("nan")] * dim), (90004, [1.0] * (dim - 1) + [None]), (90005, []), (90006, [1.0, 2.0]), (90050, [float("inf")] * dim)]
    data += [(i, v, 0) for i, v in odd] + [data[0], (None, data[1][1], 0)]
    return spark.createDataFrame(data, VEC).withColumn("rep", F.lit("clash")), [d[:2] for d in data]


def test_vectors_of_every_length(spark, monkeypatch):
    """Links and neighbours are found within each length, whether few or many vectors have it."""
    import faultline.llm.pivot_dedup as D
    from faultline.llm.collision_ann import nearest_vectors

    rng = np.random.default_rng(8)
    data, at = [], 0
    for dim, n in ((2, 3), (3, 40), (48, 700), (64, 90), (5, 1)):
        base = rng.normal(size=(n // 3 + 1, dim))
        for i in range(n):
            data.append((at, (base[i % len(base)] + 0.05 * rng.normal(size=dim)).tolist()))
            at += 1
    data += [(at + i, [1.0] * (2 + i % 2)) for i in range(6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], VEC)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data}
    cos = lambda a, b: float(unit[a] @ unit[b]) if len(unit[a]) == len(unit[b]) else -9.0
    ids = sorted(unit)
    links = {a: {b for b in ids if b != a and cos(a, b) >= 0.95} for a in ids}
    got = {r.vec_id: r.n_links for r in D.near_duplicates(df).collect()}
    assert got == {a: len(b) for a, b in links.items()}
    found = {}
    for r in nearest_vectors(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score <= 1.0
    for q in [i for i in ids if i % 50 == 0]:
        near = sorted((b for b in ids if b != q and len(unit[b]) == len(unit[q])), key=lambda b: (-cos(q, b), b))[:5]
        assert len(found.get(q, [])) == len(near) and len(set(found.get(q, [])) & set(near)) >= len(near) - 1


def usable(data, dim=32):
    out = {}
    for i, v in data:
        if i is not None and v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out[i] = np.array(v, float)
    return out


def test_near_duplicates_match_all_pairs(spark):
    from faultline.llm.pivot_dedup import near_duplicates

    df, data = vectors(spark)
    good = usable(data)
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= 0.95
    low = np.array(ids)
    for _ in ids:
        low = np.where(near, low[None, :], 1 << 60).min(axis=1)
    want = {i: (int(n) - 1, int(c)) for i, n, c in zip(ids, near.sum(axis=1), low)}
    want |= {i: (0, i) for i, _ in data if i is not None and i not in good}
    out = near_duplicates(df, 0.95).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want and len(out) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    import faultline.llm.pivot_dedup as D

    df, _ = vectors(spark, 3)
    whole = {r.vec_id: r for r in D.near_duplicates(df, 0.95).collect()}
    monkeypatch.setattr(D, "BLOCK", 7)
    assert {r.vec_id: r for r in D.near_duplicates(df, 0.95).collect()} == whole


def test_nearest_vectors_recall(spark):
    from faultline.llm.collision_ann import nearest_vectors

    df, data = vectors(spark, 1)
    good = usable(data)
    ids = np.array(sorted(good))
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    out = nearest_vectors(df, F.col("vec_id") % 50 == 0, 5).collect()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[list(ids).index(q)]
        best = sorted((-round(float(v), 12), int(i)) for v, i in zip(s, ids) if i != q)[:5]
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - s[list(ids).index(r.vec_id)]) < 1e-12 for r in mine)
        hits, total = hits + len({i for _, i in best} & {r.vec_id for r in mine}), total + 5
    assert hits >= 0.9 * total and not {r.vec_id for r in out} & {90001, 90002, 90003, 90004, 90005, 90006, 90050}
    few = nearest_vectors(df.where("vec_id in (0, 10, 20)"), F.col("vec_id") == 0, 5).collect()
    assert [r["rank"] for r in few] == [1, 2] and nearest_vectors(df.limit(0), F.lit(True)).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "", "block")]


def by_rules(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fit, key=lambda x: (-len(x[0]), x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules_in_slices(spark):
    from faultline.llm.url_cascade import judge

    rng = random.Random(0)
    hosts = ["x.example.net", "EXAMPLE.net", "net", "planet", "example.com", "w.example.com", "example.org", "a.b.org", "z.a.b.org", "", "ünï.net", "net.", "com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/x', '/de/', '/fr/1'])}{rng.choice(['', '?a=/en/', '#t', '?u=http://x.net/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "://net/", "http://" + "a." * 5000 + "net/" + "x" * 50_000, urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, RULES, most_bits=40).collect()}
    assert out == {i: by_rules(u) for i, u in enumerate(urls)}
    assert judge(df.limit(0), RULES).count() == 0 and judge(df, []).where("verdict <> 'allow' or rule is not null").count() == 0


def test_cascade_is_exact(spark):
    from faultline.llm.common import Scratch
    from faultline.llm.url_cascade import build

    keys = spark.range(900).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), "id").cache()
    cascade = build(Scratch(spark, "test"), keys.where("id % 7 = 0"), keys.where("id % 7 <> 0"), "t")
    rows = keys.toPandas()
    assert (cascade.contains(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == (rows["id"] % 7 == 0).to_numpy()).all()
    assert len(cascade.levels) > 2


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/>News</a></ul></nav>
<script>var t="<p>no</p>";</script><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>The  title &amp; more</h1><p>First paragraph of the story, with <b>bold&nbsp;text</b>.<p>Second one &lt;here&gt;
on two lines.</p><aside class="related"><a href=/x>Related story</a></aside></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this.</p></div></section>
<form class="newsletter"><label>Mail</label><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_html_extraction(spark, sf):
    from faultline.llm.html_crf import blocks, extract, features, fit, labelled, laid_out

    sample = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(30).collect()]
    field = fit(labelled(sample, 300), steps=80)
    rng, wrong, total = random.Random(5), 0, 0
    for _ in range(60):
        page, truth = laid_out([b.text for p in sample for b in blocks(p) if len(b.text) > 40], rng)
        bs = blocks(page)
        if len(bs) == len(truth):
            wrong += sum(a != b for a, b in zip(field.decode(features(bs)), truth))
            total += len(truth)
    assert total and wrong <= 0.05 * total
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit("clash"))
    more = [(-1, "u", PAGE, ""), (-2, "u", None, ""), (-3, "u", "", ""), (-4, "u", "<<a <p>" * 2000 + "&am", ""), (-5, "u", "<p " + "x" * 300_000, ""), (-1, "u", PAGE, "")]
    out = extract(pages.unionByName(spark.createDataFrame(more, pages.schema))).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == pages.count() + len(more)
    assert by[-1].text == "The title & more\nFirst paragraph of the story, with bold text.\nSecond one <here> on two lines."
    assert by[-2].text == by[-3].text == "" and by[-2].n_chars == 0 and by[-1].n_chars == len(by[-1].text)
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        assert by[r.page_id].text == "\n".join(b.text for b in blocks(inner))


def test_crf_decoding_is_the_best_labelling():
    from itertools import product

    from faultline.llm.html_crf import Field

    rng = np.random.default_rng(0)
    f = Field({c: i for i, c in enumerate("abcd")}, rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    for _ in range(30):
        rows = [[*rng.choice(list("abcdx"), 2)] for _ in range(6)]

        def score(y):
            s = f.start[y[0]] + sum(f.move[a, b] for a, b in zip(y, y[1:]))
            return s + sum(f.emit[f.names[x], k] for row, k in zip(rows, y) for x in row if x in f.names)

        assert f.decode(rows) == list(max(product((0, 1), repeat=6), key=score))
    assert f.decode([]) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, sf, name):
    from faultline.llm.queries import ORACLE, QUERIES
    from faultline.plans.check import compare, duck_connect

    r = compare(spark, duck_connect(sf), name, QUERIES[name], ORACLE[name], sf)
    assert r["ok"], r


def test_every_operator_is_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P
    from faultline.llm.common import Scratch

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copy = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(200_000, None, None, None, None), (200_001, "", "en", "src0", 0)], docs.schema)
    docs = docs.union(copy).union(odd).withColumn("score", F.lit("clash"))
    scratch, kept = Scratch(spark, "test"), [docs]
    for name, stage in P.STAGES:
        kept.append(scratch.write(stage(spark, kept[-1], sf), name))
    clean, distinct, private, mixed, encoded = kept[1:]
    assert all(d.columns == docs.columns for d in kept[1:5])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.where("toxic = 0").count() <= 1 and rejected.where("toxic = 1").count() >= 1
    # of equal texts one is left, and the first
    assert distinct.where("doc_id between 100000 and 199999").count() == 0
    assert distinct.where("text is null or text = ''").count() == 2
    assert private.count() == distinct.count() and private.where(F.col("text").rlike(r"\d@mail\d")).count() == 0
    assert 0 < mixed.select("doc_id").distinct().count() <= private.count()
    assert encoded.count() == mixed.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(encoded.columns)
    empty = kept[0].limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_distinct_with_repeated_and_missing_ids(spark, sf):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w3 ", "x ")
    rows = [(7, text), (7, text), (None, text), (None, near), (3, near), (7, "another text of the id"), (None, "no id here"), (None, "no id here"), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __row string").repartition(3)
    left = P.distinct(spark, docs.drop("__row"), sf).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(
        [(3, near), (7, "another text of the id"), (None, "no id here"), (None, None), (None, None), (9, "")], key=repr
    )


def test_unclosed_elements_leave_the_rest_of_the_page():
    from faultline.llm.html_crf import blocks

    for tag in ("noscript", "template", "svg", "math", "iframe", "object", "select"):
        got = blocks(f"<p>one</p><{tag}><article><p>two</p></article><nav>three</nav>")
        assert [b.text for b in got] == ["one", "two", "three"], tag
        assert "article" in got[1].path and "nav" in got[2].path
        assert [b.text for b in blocks(f"<p>one</p><{tag}>no</{tag}><p>two</p>")] == ["one", "two"]
    for tag in ("script", "style", "textarea", "title"):
        assert [b.text for b in blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one"]
    got = blocks("<div>" + "<span>x " * 300 + "<article><div><p>two</p></div><p>three</p></article><footer>four</footer>")
    assert [b.text for b in got[1:]] == ["two", "three", "four"]
    assert "article" in got[1].path and "article" in got[2].path and "footer" in got[3].path and "div" in got[3].path
