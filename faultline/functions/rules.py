"""Masking rules as data (U4): a rule table becomes one column expression when the plan is built.

Rules apply in their order, each to what the one before left.  A rule with a
replacement is a regular-expression replacement; the kinds ip, email and phone
without one keep a part of each match (``redact``).  The default rules are those
of ``redact`` and ``mask_secrets``, which skip texts without any hint of a match;
other rules are tried on every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import jsontext as J
from faultline.functions import redact as RD

PARTIAL = {"ip": RD.mask_ip_match, "email": RD.mask_email_match, "phone": RD.mask_phone_match}


def apply_rules(text: Column, rules: tuple[C.Rule, ...]) -> Column:
    """``text`` after all rules, in order; null stays null."""
    out = text
    for rule in rules:
        pattern = RD.java_regex(rule.pattern)
        if rule.replacement is not None:
            out = F.regexp_replace(out, pattern, rule.replacement)
        elif rule.kind in PARTIAL:
            out = RD.replace_callback(out, pattern, PARTIAL[rule.kind])
        else:
            raise ValueError(f"a rule of kind {rule.kind!r} needs a replacement; partial masks: {sorted(PARTIAL)}")
    return out


def rule_table(rows: DataFrame) -> tuple[C.Rule, ...]:
    """Rules of a table (ord, kind, pattern, replacement), by ord; a table of rules is small by nature."""
    found = rows.orderBy("ord").select("kind", "pattern", "replacement").limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("more than 1000 rules")
    return tuple(C.Rule(*r) for r in found)


def protect_text(text: Column, cfg: C.RedactionConfig = C.RedactionConfig()) -> Column:
    """Secrets, then PII, by the rules and switches of ``cfg``."""
    out = text
    if cfg.mask_sensitive_data:
        out = RD.mask_secrets(out) if cfg.secret_rules == C.SECRET_RULES else apply_rules(out, cfg.secret_rules)
    if cfg.pii_redaction:
        out = RD.redact(out) if cfg.pii_rules == C.PII_RULES else apply_rules(out, cfg.pii_rules)
    return out


def protect_request(err: DataFrame, cfg: C.RedactionConfig = C.RedactionConfig()) -> DataFrame:
    """An errors table with its request made safe to store, by ``cfg``; columns that it lacks are skipped.

    request_headers (JSON text) lose the values of ``sensitive_headers`` and
    request_data those of ``sensitive_keys``, by exact name; ``sql`` is
    sanitised in production; context loses the strings whose key contains one of
    ``mask_patterns``; message is masked by the rules.
    """
    make = {
        "request_headers": lambda c: J.sanitize_request_json(c, cfg.sensitive_headers),
        "request_data": lambda c: J.sanitize_request_json(c, cfg.sensitive_keys),
        "context": lambda c: J.sanitize_json(c, cfg.mask_patterns, cfg.mask_sensitive_data),
        "sql": lambda c: RD.sanitize_sql(c, cfg.sanitize_sql, cfg.production),
        "message": lambda c: protect_text(c, cfg),
    }
    return err.withColumns({c: fn(F.col(c)) for c, fn in make.items() if c in err.columns})
