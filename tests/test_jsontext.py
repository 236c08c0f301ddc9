"""JSON text of any depth against a recursive rewrite in Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import jsontext as J

MASK = C.MASK_STRING


def mask_secrets(s):
    for p, r in C.SECRET_PATTERNS:
        s = re.sub(p, r.replace("$1", r"\1"), s, flags=re.ASCII)
    return s


def walk(v, leaf, key=None):
    if isinstance(v, dict):
        return {k: walk(x, leaf, k) for k, x in v.items()}
    if isinstance(v, list):
        return [walk(x, leaf) for x in v]
    return leaf(v, key)


def masked(v, key):
    if key is not None and any(p in key.lower() for p in C.MASK_PATTERNS):
        return MASK
    return mask_secrets(v) if isinstance(v, str) else v


KEYS = ["user", "password", "API_KEY", "x-token-y", "note", "é\n", 'q"k', "back\\", "", "a:b", "0", "list"]
STRINGS = ["", "plain", "password=abc d", 'say "hi"', "line\nbreak", "tab\t\\", "token=x&y=1", "{not: json}", "[1,2]", "é😀", "4111-1111-1111-1234", "a,b:c}"]


def value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind == 6:
        return {rng.choice(KEYS): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 7:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [rng.choice(STRINGS), rng.choice(STRINGS), rng.randrange(100), 1.5, None, True][kind]


def documents(n=300):
    rng = random.Random(4)
    docs = [rng.choice([dict, list])() for _ in range(2)]
    for _ in range(n):
        docs.append({rng.choice(KEYS): value(rng, 5) for _ in range(rng.randrange(5))} if rng.random() < 0.8 else [value(rng, 4)])
    deep = "password=deep"
    for _ in range(300):
        deep = {"k": [deep, {"password": 1}]}
    return [*docs, deep, {"long": "x " * 100_000 + "token=abc"}]


@pytest.fixture(scope="module")
def frame(spark):
    docs = documents()
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None)) for i, d in enumerate(docs)]
    return docs, spark.createDataFrame(rows, "id int, j string").cache()


def run(df, fn):
    return [json.loads(r.o) for r in df.select("id", fn(F.col("j")).alias("o")).orderBy("id").collect()]


def test_masking_at_any_depth(frame):
    docs, df = frame
    assert run(df, J.mask_json) == [walk(d, masked) for d in docs]


def test_order_types_and_escapes_stay(frame):
    docs, df = frame
    kept = [r.o for r in df.select("id", J.walk_json(F.col("j"), lambda t, k: t, lambda s: s).alias("o")).orderBy("id").collect()]
    assert all("\n" not in o for o in kept)
    for d, o in zip(docs, kept):
        assert json.loads(o, object_pairs_hook=list) == json.loads(json.dumps(d), object_pairs_hook=list)


def test_request_data_and_context(frame):
    docs, df = frame
    exact = lambda v, k: C.KEY_REDACTED if k is not None and k.lower() in C.SENSITIVE_KEYS else v
    assert run(df, J.sanitize_request_json) == [walk(d, exact) for d in docs]
    strings = lambda v, k: masked(v, k) if isinstance(v, str) and masked(v, k) == MASK and k and any(p in k.lower() for p in C.MASK_PATTERNS) else v
    assert run(df, J.sanitize_json) == [walk(d, strings) for d in docs]


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "j string").select(fn(F.col("j")).alias("o")).first().o


def test_pii_and_switches(spark):
    text = '{"message": "User john@example.com\\nfrom 192.168.1.100", "details": {"ip": "192.168.1.100", "phone": ["+1234567890"], "n": 5}}'
    want = {"message": "User j***@example.com\nfrom 192.*.*.*", "details": {"ip": "192.*.*.*", "phone": ["******7890"], "n": 5}}
    assert json.loads(one(spark, text, J.redact_json)) == want
    assert one(spark, text, lambda c: J.redact_json(c, enabled=False)) == text
    off = C.RedactionConfig(mask_sensitive_data=False)
    assert json.loads(one(spark, '{"password": "john@example.com"}', lambda c: J.secure_json(c, off))) == {"password": "j***@example.com"}
    custom = C.RedactionConfig(mask_patterns=("color",))
    assert json.loads(one(spark, '{"password": 1, "Color": 2}', lambda c: J.secure_json(c, custom))) == {"password": 1, "Color": MASK}


@pytest.mark.parametrize(
    "text,want",
    [
        (None, None),
        ("", ""),
        ("login password=abc x", "login password=***REDACTED*** x"),
        ('{"a": {"password": "abc', '{"a":{"password":"***REDACTED***"'),
        ('{"a": "password=abc\\', None),
        ("[1, 2", "[1, 2"),
        ("{}", "{}"),
        ('"token=abc"', '"token=***REDACTED***'),
    ],
)
def test_text_that_is_no_document(spark, text, want):
    got = one(spark, text, J.mask_json)
    assert got == want if want is not None or text is None else "abc" not in got


def test_entries_and_merge(spark, frame):
    docs, df = frame
    rows = df.select("id", J.entries(F.col("j")).alias("e"), J.obj(J.entries(F.col("j"))).alias("o")).orderBy("id").collect()
    for d, r in zip(docs, rows):
        want = list(d.items()) if isinstance(d, dict) else []
        assert [(x.key, json.loads(x.value)) for x in r.e] == want
        assert json.loads(r.o) == dict(want)
    both = spark.createDataFrame([('{"a":1,"b":{"c":[2]},"a":3}', '{"z":"x","b":null}'), (None, "{}"), ("[1]", '{"a":1}')], "x string, y string")
    out = [r.o for r in both.select(J.obj(J.merged(J.entries(F.col("x")), J.entries(F.col("y")))).alias("o")).collect()]
    assert out == ['{"a":3,"b":null,"z":"x"}', "{}", '{"a":1}']
