"""Text redaction and secret masking as column expressions.

Replace-with-callback without a Python UDF: put a mark around every match, cut
the text at the marks, rewrite every second piece with a column lambda and join
the pieces again::

    pieces = split(regexp_replace(t, R, MARK || '$0' || MARK), MARK, -1)
    out    = array_join(transform(pieces, (p, i) -> i % 2 = 1 ? f(p) : p), '')

So a pass searches a text once.  Texts that hold the mark themselves are split
on the pattern instead.  Everything runs in the JVM; the array lambdas are
interpreted, outside the generated stage code (``tag_redact`` alone is inside),
where a column that is used twice is computed twice unless ``let`` binds it.
Word boundaries are written as ASCII look-arounds because Java's ``\\b`` treats
accented letters as word characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import config as C

NW_BEFORE = r"(?<![A-Za-z0-9_])"
NW_AFTER = r"(?![A-Za-z0-9_])"



#: Patterns that match the same, from the same places, in fewer steps: a digit is looked at before what stands
#: before it, and an address is only tried where its run of characters begins (or the match before it ended).
QUICK = {
    C.PII_IP_PATTERN: r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]{0,2}\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}" + NW_AFTER,
    C.PII_EMAIL_PATTERN: r"[a-zA-Z0-9._%+-](?:(?<![a-zA-Z0-9._%+-].)|(?<=\G.))[a-zA-Z0-9._%+-]*+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
}


def java_regex(pattern: str) -> str:
    """The configured pattern with ``\b`` spelled as ASCII look-arounds (Java's
    ``\b`` treats accented letters as word characters)."""
    if pattern in QUICK:
        return QUICK[pattern]
    out = pattern
    if out.startswith(r"\b"):
        out = NW_BEFORE + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + NW_AFTER
    return out


IP_RE = java_regex(C.PII_IP_PATTERN)
EMAIL_RE = java_regex(C.PII_EMAIL_PATTERN)
PHONE_RE = java_regex(C.PII_PHONE_PATTERN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Chained passes reference their input several times; without a binding
    the expression tree of k chained passes grows as 4^k.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Stands around the matches while a text is cut; one character, which Java splits at without a pattern.
MARK = "\x01"


def replace_callback(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` in ``text`` by ``fn(match)``."""

    def body(t: Column) -> Column:
        pieces = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, fn(p)).otherwise(p)), "")
        return F.when(t.contains(MARK), _split_callback(t, pattern, fn)).otherwise(joined)

    return let(text, body)


def _split_callback(t: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    parts = F.split(t, pattern, -1)
    ms = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    tail = F.zip_with(ms, F.slice(parts, 2, F.size(ms)), lambda m, p: F.concat(fn(m), p))
    return F.when(t.rlike(pattern), F.concat(F.element_at(parts, 1), F.array_join(tail, ""))).otherwise(t)


# ---- match rewriters ---------------------------------------------------------


OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"


def valid_ipv4(m: Column) -> Column:
    return m.rlike(rf"^{OCTET}(?:\.{OCTET})*$")


def mask_ip_match(m: Column) -> Column:
    """``192.168.1.100`` -> ``192.*.*.*``; invalid addresses stay as they are."""
    return F.when(valid_ipv4(m), F.concat(F.substring_index(m, ".", 1), F.lit(".*.*.*"))).otherwise(m)


def valid_email(m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    domain = F.substring_index(m, "@", -1)
    return (
        (F.length(local) <= 64)
        & ~local.startswith(".")
        & ~local.endswith(".")
        & ~local.contains("..")
        & ~domain.startswith(".")
        & ~domain.contains("..")
        & ~domain.rlike(r"(^|\.)-|-($|\.)")
        & (F.length(domain) <= 253)
    )


def mask_email_match(m: Column) -> Column:
    """``john@example.com`` -> ``j***@example.com`` (at most 5 stars)."""
    local = F.substring_index(m, "@", 1)
    domain = F.substring_index(m, "@", -1)
    masked = F.concat(
        F.substring(local, 1, 1), F.repeat(F.lit("*"), F.least(F.length(local) - 1, F.lit(5))), F.lit("@"), domain
    )
    return F.when(valid_email(m), masked).otherwise(m)


def mask_phone_match(m: Column) -> Column:
    """``+1234567890`` -> ``******7890`` (the plus sign is dropped)."""

    def masked(digits: Column) -> Column:
        n = F.length(digits)
        return F.when(n < 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.substring(digits, -4, 4)))

    return let(F.regexp_replace(m, r"\D", ""), masked)


# ---- text functions ------------------------------------------------------------


def mask_ips(text: Column) -> Column:
    return replace_callback(text, IP_RE, mask_ip_match)


def mask_emails(text: Column) -> Column:
    return replace_callback(text, EMAIL_RE, mask_email_match)


def mask_phones(text: Column) -> Column:
    return replace_callback(text, PHONE_RE, mask_phone_match)


# A text can only hold a match of any of the three patterns if it has one of
# these; the guard is one cheap scan that lets most rows skip the passes.
PII_HINT = r"@|\+[1-9]|\d\.\d{1,3}\.\d"
SECRET_HINT = r"password=|token=|api_key=|Authorization:|\d{4}[\s\-]?\d{4}"


def redact(text: Column, enabled: bool = True) -> Column:
    """PII redaction with partial masks: IPs first, then e-mails, then phones."""
    if not enabled:
        return text
    # plain searches first: they cost a fraction of a pattern
    hinted = lambda t: t.contains("@") | t.contains("+") | t.rlike(r"\d\.\d{1,3}\.\d")
    return let(text, lambda t: F.when(hinted(t), mask_phones(mask_emails(mask_ips(t)))).otherwise(t))


def tag_redact(text: Column, enabled: bool = True) -> Column:
    """Typed-tag redaction ``[email:REDACTED]`` ... in configured order."""
    if not enabled:
        return text
    out = text
    for name, pattern in C.TAG_PATTERNS:
        out = F.regexp_replace(out, java_regex(pattern), f"[{name}:REDACTED]")
    return out


SECRET_RULES = tuple((java_regex(p), r) for p, r in C.SECRET_PATTERNS)


def mask_secrets(text: Column, enabled: bool = True) -> Column:
    """Mask ``password=``, ``token=``, ``api_key=``, bearer/basic credentials
    and 16-digit card numbers, in that order."""
    if not enabled:
        return text

    def body(t: Column) -> Column:
        out = t
        for pattern, repl in SECRET_RULES:
            out = F.regexp_replace(out, pattern, repl)
        words = t.contains("password=") | t.contains("token=") | t.contains("api_key=") | t.contains("Authorization:")
        return F.when(words | t.rlike(r"\d{4}[\s\-]?\d{4}"), out).otherwise(t)

    return let(text, body)


SQL_RULES = tuple((java_regex(p), r) for p, r in C.SQL_SANITIZE_PATTERNS)


def sanitize_sql(sql: Column, enabled: bool = True, production: bool = True) -> Column:
    """Hide quoted values, back-ticked names and bare table names (production only)."""
    if not (enabled and production):
        return sql
    out = sql
    for pattern, repl in SQL_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return out
