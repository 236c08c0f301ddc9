"""Redaction and JSON quoting in few passes: the same texts as a plain rewrite in Python, and no search that goes back and forth."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import jsontext as J
from faultline.functions import redact as RD
from faultline.sources import tables as T


def mask_ip(m):
    octets = m[0].split(".")
    return octets[0] + ".*.*.*" if all(re.fullmatch(r"0|[1-9]\d{0,2}", o) and int(o) <= 255 for o in octets) else m[0]


def mask_email(m):
    local, domain = m[0].split("@")
    bad = len(local) > 64 or local[0] == "." or local[-1] == "." or ".." in local or domain[0] == "." or ".." in domain
    if bad or re.search(r"(^|\.)-|-($|\.)", domain) or len(domain) > 253:
        return m[0]
    return local[0] + "*" * min(len(local) - 1, 5) + "@" + domain


def mask_phone(m):
    digits = re.sub(r"\D", "", m[0])
    return "*" * (len(digits) - 4) + digits[-4:]


def redacted(text):
    for pattern, fn in ((C.PII_IP_PATTERN, mask_ip), (C.PII_EMAIL_PATTERN, mask_email), (C.PII_PHONE_PATTERN, mask_phone)):
        text = re.sub(pattern, fn, text, flags=re.ASCII)
    return text


PIECES = ["1.2.3.4", "255.0.10.256", "01.2.3.4", "9", ".", "7.", "a", "_", "é", "b@c.de", "@", "x@-y.com", ".q@r.st", "long.name-1@h.example.com1", "%", "+", "-",
          "+1234567890", "+12345678901234567", "\x01", "\n", " ", "$0", "\\", "😀", "com", "@d.ef2@g.hi"]


def test_redact_as_plain_rewrite(spark):
    rng = random.Random(5)
    texts = ["", *PIECES, *("".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", RD.redact(F.col("t")).alias("r")).collect()
    assert [(r.t, r.r) for r in rows if r.r != (None if r.t is None else redacted(r.t))] == []


def test_quote_as_json(spark):
    texts = ["", "plain", 'a"b', "back\\slash", "line\nbreak", "end\n", "\x01\x1f\x7f", "é😀", "/path?x=1&y='2'", "[]{}~ !#"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", J.quote(F.col("t")).alias("q")).collect()
    assert [r.q if r.q is None else json.loads(r.q) for r in rows] == [*texts, None]
    assert [r.q for r in rows][:2] == ['""', '"plain"']


def test_long_runs_are_searched_once(spark):
    """An address was tried from every character of a run, to its end."""
    run = "a" * 600_000
    text = spark.createDataFrame([(run + " +1234567890 x@y.zz",)], "t string")
    start = time.monotonic()
    assert text.select(RD.redact(F.col("t"))).first()[0] == run + " ******7890 x@y.zz"
    assert time.monotonic() - start < 30


def test_rows_use_all_cores(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    for make in (T.contact_lines, T.error_responses):
        assert make(spark, sf).rdd.getNumPartitions() >= cores
