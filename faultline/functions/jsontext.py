"""JSON text of unknown depth and mixed types as column expressions.

A typed column is rewritten along its schema (``nested.py``); text has none.  So
the text is cut into tokens by one regular expression that reads strings whole,
and each token is rewritten by what stands beside it: a scalar after a colon has
the key before the colon, a string before a colon is a key.  Every level is
reached without recursion, values keep their types and their order, and nothing
leaves the JVM.

Rewritten documents are compact (no white space outside strings); those with
nothing to rewrite are returned as they are.  Text that does not start
with ``{`` or ``[`` is no document: it is rewritten as one plain string.  A
document that ends early is rewritten as far as it goes, so a truncated body does
not leak its last value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import redact as RD
from faultline.functions.redact import let

#: One token and the white space after it; possessive, so long strings need no stack.
TOKEN = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}\[\]:,]|[^\s{}\[\]:,"]++)\s*+'
#: Tokens that are structure.
MARKS = ("{", "}", "[", "]", ":", ",")

#: (token of a scalar, its key or null) -> token
Leaf = Callable[[Column, Column], Column]
ENTRIES = "array<struct<key:string,value:string>>"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def is_document(text: Column) -> Column:
    return text.rlike(r"^\s*[{\[]")


def unquote(token: Column) -> Column:
    """The string that a JSON string token stands for."""

    def plain(t: Column) -> Column:
        closed = (F.length(t) > 1) & t.endswith('"')
        inner = F.when(closed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.substring(t, F.lit(2), F.length(t)))
        read = F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)
        return F.when(t.contains("\\"), F.coalesce(read, inner)).otherwise(inner)

    return let(token, plain)


#: Printable ASCII without quotes and backslashes: what JSON writes as it is.
AS_IT_IS = r"^[ !#-\[\]-~]*+\z"


def quote(text: Column) -> Column:
    """The JSON string token of a string; null for null.  Only strings that need it pass through a JSON writer."""
    token = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
    return let(text, lambda t: F.when(t.rlike(AS_IT_IS), quote_plain(t)).when(t.isNotNull(), let(F.to_json(F.array(t)), token)))


def requote(token: Column, fn: Callable[[Column], Column]) -> Column:
    """A string token with ``fn`` applied to its string; kept as it is written when that changes nothing."""
    return let(unquote(token), lambda s: let(fn(s), lambda r: F.when(r.eqNullSafe(s), token).otherwise(quote(r))))


def walk_json(text: Column, leaf: Leaf, plain: Callable[[Column], Column], hint: str | None = None) -> Column:
    """Rewrites every scalar of a document by ``leaf``, other text by ``plain``; null stays null.

    A document without a match of ``hint``, if given, and without escapes is
    returned as it is: it holds nothing to rewrite.
    """

    def document(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            is_key = t.startswith('"') & (F.get(ts, i + 1) == ":")
            key = F.when(F.get(ts, i - 1) == ":", F.get(ts, i - 2))
            return F.when(t.isin(*MARKS), t).when(is_key, t).otherwise(leaf(t, key))

        return F.array_join(F.transform(ts, one), "")

    walked = F.when(is_document(text), let(tokens(text), document)).otherwise(plain(text))
    return walked if hint is None else F.when(text.rlike(rf"\\|{hint}"), walked).otherwise(text)


def _any(words) -> str:
    """A pattern for any of the words as they are, whatever the case."""
    return "(?iu:" + "|".join(rf"\Q{w}\E" for w in words) + ")"


def _key_matches(token: Column, pattern: str) -> Column:
    """Whether a key's token matches; its escapes are only read if it has any.  No key, no match."""
    hit = token.rlike(pattern) | (token.contains("\\") & quote_plain(unquote(token)).rlike(pattern))
    return F.coalesce(hit, F.lit(False))


def quote_plain(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def holds(key: Column, patterns) -> Column:
    """Whether a key contains one of the patterns, whatever the case; a null key does not."""
    return F.coalesce(key.rlike(_any(patterns)), F.lit(False)) if patterns else F.lit(False)


def _is_string(token: Column) -> Column:
    return token.startswith('"')


def secure_json(text: Column, cfg: C.RedactionConfig = C.RedactionConfig()) -> Column:
    """Masking and PII redaction in one pass, each by its switch.

    A scalar of any type whose key contains a mask pattern becomes the mask
    string; other strings, at any depth, lose the secrets and then the PII in
    them; other scalars, keys and list items without strings stay.
    """
    mask, redact = cfg.mask_sensitive_data, cfg.pii_redaction
    hints = ([RD.SECRET_HINT] if mask else []) + ([RD.PII_HINT] if redact else [])
    keys = _any(cfg.mask_patterns) if mask and cfg.mask_patterns else None
    if not hints:
        return text
    in_text = "|".join(hints)

    def text_of(s: Column) -> Column:
        return RD.redact(RD.mask_secrets(s, mask), redact)

    def leaf(t: Column, key: Column) -> Column:
        out = F.when(_is_string(t) & t.rlike(rf"\\|{in_text}"), requote(t, text_of)).otherwise(t)
        return F.when(_key_matches(key, keys), F.lit(f'"{C.MASK_STRING}"')).otherwise(out) if keys else out

    return walk_json(text, leaf, text_of, "|".join([*hints, *([keys] if keys else [])]))


def mask_json(text: Column, cfg: C.RedactionConfig = C.RedactionConfig()) -> Column:
    """F8 over text: keys by contains-match, secrets in other strings."""
    return secure_json(text, C.RedactionConfig(mask_sensitive_data=cfg.mask_sensitive_data, pii_redaction=False, mask_patterns=cfg.mask_patterns))


def redact_json(text: Column, enabled: bool = True) -> Column:
    """F2 over text: PII redaction of every string."""
    return secure_json(text, C.RedactionConfig(mask_sensitive_data=False, pii_redaction=enabled))


def sanitize_json(text: Column, patterns=C.MASK_PATTERNS, enabled: bool = True) -> Column:
    """F12 over text: only strings whose key contains a pattern are masked; other scalars stay."""
    if not enabled or not patterns:
        return text
    mask, keys = F.lit(f'"{C.MASK_STRING}"'), _any(patterns)
    return walk_json(text, lambda t, key: F.when(_is_string(t) & _key_matches(key, keys), mask).otherwise(t), lambda s: s, keys)


def sanitize_request_json(text: Column, keys=C.SENSITIVE_KEYS, replacement: str = C.KEY_REDACTED) -> Column:
    """F11 over text: scalars of any type whose lower-cased key is exactly one of ``keys``."""
    if not keys:
        return text
    exact, hit = f'^"{_any(keys)}"$', F.lit(f'"{replacement}"')
    return walk_json(text, lambda t, key: F.when(_key_matches(key, exact), hit).otherwise(t), lambda s: s, _any(keys))


# ---- members of an object, in order ---------------------------------------------


def entries(text: Column) -> Column:
    """The members of a JSON object: (key, value as JSON text), in order.

    Nested values keep their order; numbers are written as Spark's parser reads
    them.  A key that repeats keeps its first place and its last value.  Null,
    lists, incomplete and other text have no members.
    """
    none = F.array().cast(ENTRIES)

    def one(p: Column, t: Column) -> Column:
        value = F.when(F.schema_of_variant(t.getField("value")) == "STRING", quote(p.getField("value"))).otherwise(p.getField("value"))
        return F.struct(p.getField("key").alias("key"), F.coalesce(value, F.lit("null")).alias("value"))

    def read(j: Column) -> Column:
        plain, typed = F.map_entries(F.from_json(j, "map<string,string>")), F.map_entries(F.from_json(j, "map<string,variant>"))
        known = let(F.json_object_keys(j), lambda k: F.size(F.array_distinct(k)) == F.size(k))
        return let(known, lambda once: F.when(once, F.zip_with(plain, typed, one)).when(once.isNotNull(), _repeated(j)))

    return F.coalesce(let(text, read), none)


def _repeated(text: Column) -> Column:
    """Members of an object with repeated keys, read token by token (a map could not hold them)."""

    def read(ts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("at"), F.array().cast(ENTRIES).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            t, depth = F.element_at(ts, i), acc.getField("depth")
            opens, closes = t.isin("{", "["), t.isin("}", "]")
            names = (depth == 1) & (t == ":") & acc.getField("key").isNull()
            ends = (depth == 1) & (t.isin(",", "}")) & acc.getField("key").isNotNull()
            value = F.array_join(F.slice(ts, acc.getField("at"), i - acc.getField("at")), "")
            done = merged(acc.getField("out"), F.array(F.struct(unquote(acc.getField("key")).alias("key"), value.alias("value"))))
            return F.struct(
                F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
                F.when(names, F.element_at(ts, i - 1)).when(ends, F.lit(None).cast("string")).otherwise(acc.getField("key")).alias("key"),
                F.when(names, i + 1).otherwise(acc.getField("at")).alias("at"),
                F.when(ends, done).otherwise(acc.getField("out")).alias("out"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(ts)), start, step, lambda acc: acc.getField("out"))

    return let(tokens(text), read)


def merged(base: Column, over: Column) -> Column:
    """``over`` written onto ``base``: a key that is there keeps its place and takes the new value, others follow."""

    def with_both(b: Column, o: Column) -> Column:
        def put(x: Column) -> Column:
            hit = F.filter(o, lambda y: y.getField("key") == x.getField("key"))
            return F.coalesce(F.get(hit, F.lit(0)), x)

        new = F.filter(o, lambda y: ~F.exists(b, lambda x: x.getField("key") == y.getField("key")))
        return F.when(F.size(o) == 0, b).when(F.size(b) == 0, o).otherwise(F.concat(F.transform(b, put), new))

    return let(base, lambda b: let(over, lambda o: with_both(b, o)))


def without(e: Column, keys) -> Column:
    return F.filter(e, lambda x: ~x.getField("key").isin(list(keys)))


def value_of(e: Column, key: str) -> Column:
    """The JSON text of a member; SQL null if there is none."""
    return F.get(F.filter(e, lambda x: x.getField("key") == key), F.lit(0)).getField("value")


def members(*pairs: tuple[str, Column]) -> Column:
    """Members (key, JSON text) of which those with a null text are left out."""
    if not pairs:
        return F.array().cast(ENTRIES)
    made = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.filter(made, lambda x: x.getField("value").isNotNull())


def obj(e: Column) -> Column:
    """The JSON text of an object of members."""
    return F.concat(F.lit("{"), F.array_join(F.transform(e, lambda x: F.concat(quote(x.getField("key")), F.lit(":"), x.getField("value"))), ","), F.lit("}"))


def listed(items: Column) -> Column:
    """The JSON text of a list of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
