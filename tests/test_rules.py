"""Masking rules as data, and one test for each switch of the config."""

import pytest
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import redact as RD
from faultline.functions import rules as R

ROW = {
    "message": "john@example.com from 192.168.1.100 password=abc call +1234567890",
    "request_headers": '{"Authorization":"Bearer x","X-Trace":"t"}',
    "request_data": '{"token":"t","token_type":"u","n":1}',
    "context": '{"secret_code":"s","secret_count":3,"plain":"p"}',
    "sql": "SELECT id FROM users",
}


def protect(spark, cfg=C.RedactionConfig()):
    df = spark.createDataFrame([tuple(ROW.values())], ", ".join(f"{c} string" for c in ROW))
    return R.protect_request(df, cfg).first().asDict()


def test_defaults(spark):
    assert protect(spark) == {
        "message": "j***@example.com from 192.*.*.* password=***REDACTED*** call ******7890",
        "request_headers": '{"Authorization":"[REDACTED]","X-Trace":"t"}',
        "request_data": '{"token":"[REDACTED]","token_type":"u","n":1}',
        "context": '{"secret_code":"***REDACTED***","secret_count":3,"plain":"p"}',
        "sql": "SELECT id FROM [table]",
    }


@pytest.mark.parametrize(
    "cfg,changed",
    [
        ({"sensitive_headers": ("x-trace",)}, {"request_headers": '{"Authorization":"Bearer x","X-Trace":"[REDACTED]"}'}),
        ({"sensitive_keys": ("N",)}, {"request_data": '{"token":"t","token_type":"u","n":"[REDACTED]"}'}),
        ({"sensitive_keys": ()}, {"request_data": ROW["request_data"]}),
        ({"mask_patterns": ("plain",)}, {"context": '{"secret_code":"s","secret_count":3,"plain":"***REDACTED***"}'}),
        ({"sanitize_sql": False}, {"sql": ROW["sql"]}),
        ({"production": False}, {"sql": ROW["sql"]}),
        ({"mask_sensitive_data": False}, {"context": ROW["context"], "message": "j***@example.com from 192.*.*.* password=abc call ******7890"}),
        ({"pii_redaction": False}, {"message": ROW["message"].replace("abc", "***REDACTED***")}),
        ({"pii_rules": C.TAG_RULES[:1]}, {"message": "[email:REDACTED] from 192.168.1.100 password=***REDACTED*** call +1234567890"}),
        ({"secret_rules": (C.Rule("trace", r"(call )\S+", "$1-"),), "pii_rules": ()}, {"message": "john@example.com from 192.168.1.100 password=abc call -"}),
    ],
)
def test_every_switch(spark, cfg, changed):
    plain = protect(spark)
    assert protect(spark, C.RedactionConfig(**cfg)) == plain | changed


def test_rules_of_a_table_apply_in_order(spark):
    rows = [(2, "email", C.PII_EMAIL_PATTERN, None), (1, "code", r"\b[A-Z]{3}-\d+\b", "[code]"), (3, "ip", C.PII_IP_PATTERN, "[ip]")]
    rules = R.rule_table(spark.createDataFrame(rows, "ord int, kind string, pattern string, replacement string"))
    assert [r.kind for r in rules] == ["code", "email", "ip"]
    df = spark.createDataFrame([("ABC-12 john@example.com 10.0.0.1",), (None,), ("",)], "t string")
    out = [r[0] for r in df.select(R.apply_rules(F.col("t"), rules)).collect()]
    assert out == ["[code] j***@example.com [ip]", None, ""]
    with pytest.raises(ValueError, match="needs a replacement"):
        R.apply_rules(F.col("t"), (C.Rule("name", "x"),))


def test_default_rules_equal_the_guarded_masks(spark, sf):
    text = spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text is not null")
    same = text.select((R.apply_rules(F.col("text"), C.PII_RULES) == RD.redact(F.col("text"))).alias("a"), (R.apply_rules(F.col("text"), C.SECRET_RULES) == RD.mask_secrets(F.col("text"))).alias("b"))
    assert same.where("not a or not b").count() == 0
