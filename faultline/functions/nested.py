"""Masking of nested values.

Typed nested columns are rewritten by walking the *schema* on the driver and
emitting one expression tree: structs are rebuilt field by field, arrays go
through ``transform`` and maps through ``transform_values``.  The per-leaf
decision (is the key sensitive?) is taken at plan time for struct fields and
at run time for map keys.  Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import config as C
from faultline.functions import redact as RD

# leaf rewriter: (value, key_name_or_None, key_column_or_None, dtype) -> Column
Leaf = Callable[[Column, "str | None", "Column | None", T.DataType], Column]


def walk(col: Column, dtype: T.DataType, leaf: Leaf, key: str | None = None, key_col: Column | None = None) -> Column:
    """Rebuild ``col`` of type ``dtype`` applying ``leaf`` to every scalar leaf.

    ``key`` is the enclosing struct field name (known at plan time);
    ``key_col`` the enclosing map key (known at run time).  Array elements
    have no string key.
    """
    if isinstance(dtype, T.StructType):
        fields = [walk(col.getField(f.name), f.dataType, leaf, f.name, None).alias(f.name) for f in dtype.fields]
        return F.when(col.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: walk(x, dtype.elementType, leaf, None, None))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda k, v: walk(v, dtype.valueType, leaf, None, k))
    return leaf(col, key, key_col, dtype)


def _contains_any(key_col: Column, patterns) -> Column:
    low = F.lower(key_col)
    out = F.lit(False)
    for p in patterns:
        out = out | low.contains(p.lower())
    return out


def _key_contains(key: str | None, patterns) -> bool:
    return key is not None and any(p.lower() in key.lower() for p in patterns)


def _is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def mask_leaves(cfg: C.RedactionConfig = C.RedactionConfig()) -> Leaf:
    """``maskArray``: a leaf whose key contains a mask pattern becomes the mask
    string; any other string leaf gets the in-text secret masking."""

    def leaf(v, key, key_col, dtype):
        if not cfg.mask_sensitive_data:
            return v
        if _key_contains(key, cfg.mask_patterns):
            return F.lit(C.MASK_STRING)
        plain = RD.mask_secrets(v) if _is_string(dtype) else v
        if key_col is not None:
            masked = F.lit(C.MASK_STRING)
            if not _is_string(dtype):
                plain = plain.cast("string")
            return F.when(_contains_any(key_col, cfg.mask_patterns), masked).otherwise(plain)
        return plain

    return leaf


def redact_leaves(enabled: bool = True) -> Leaf:
    """``redactArray``: PII redaction on every string leaf."""

    def leaf(v, key, key_col, dtype):
        return RD.redact(v) if enabled and _is_string(dtype) else v

    return leaf


def sanitize_leaves(patterns=C.MASK_PATTERNS, enabled: bool = True) -> Leaf:
    """Context sanitising: only *string* leaves whose key contains a pattern
    are masked; numbers and booleans are kept."""

    def leaf(v, key, key_col, dtype):
        if not enabled or not _is_string(dtype):
            return v
        if _key_contains(key, patterns):
            return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(F.lit(C.MASK_STRING))
        if key_col is not None:
            return F.when(_contains_any(key_col, patterns), F.lit(C.MASK_STRING)).otherwise(v)
        return v

    return leaf


def exact_key_leaves(keys=C.SENSITIVE_KEYS, replacement: str = C.KEY_REDACTED) -> Leaf:
    """Request-body sanitising: a leaf whose lower-cased key is exactly one of
    ``keys`` becomes ``[REDACTED]`` whatever its type; list items have no key."""
    keyset = {k.lower() for k in keys}

    def leaf(v, key, key_col, dtype):
        if key is not None and key.lower() in keyset:
            return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(F.lit(replacement))
        if key_col is not None:
            plain = v if _is_string(dtype) else v.cast("string")
            return F.when(F.lower(key_col).isin(list(keyset)), F.lit(replacement)).otherwise(plain)
        return v

    return leaf


def mask_nested(col: Column, dtype: T.DataType, cfg: C.RedactionConfig = C.RedactionConfig()) -> Column:
    return walk(col, dtype, mask_leaves(cfg))


def redact_nested(col: Column, dtype: T.DataType, enabled: bool = True) -> Column:
    return walk(col, dtype, redact_leaves(enabled))


def sanitize_context(col: Column, dtype: T.DataType, patterns=C.MASK_PATTERNS) -> Column:
    return walk(col, dtype, sanitize_leaves(patterns))


def sanitize_request_data(col: Column, dtype: T.DataType, keys=C.SENSITIVE_KEYS) -> Column:
    return walk(col, dtype, exact_key_leaves(keys))


def secure_pipeline(
    col: Column, dtype: T.DataType, mask: bool = True, redact_pii: bool = True, cfg: C.RedactionConfig = C.RedactionConfig()
) -> Column:
    """Secret masking by ``cfg`` then PII redaction, each switchable."""
    out, out_type = col, dtype
    if mask and cfg.mask_sensitive_data:
        out = walk(out, out_type, mask_leaves(cfg))
        out_type = _masked_type(out_type, None, cfg.mask_patterns)
    if redact_pii:
        out = walk(out, out_type, redact_leaves())
    return out


def _masked_type(dtype: T.DataType, key: str | None = None, patterns=C.MASK_PATTERNS) -> T.DataType:
    """Type after ``mask_leaves``: sensitive scalar leaves become strings."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _masked_type(f.dataType, f.name, patterns), True) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_masked_type(dtype.elementType, None, patterns), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, T.StringType() if not isinstance(dtype.valueType, (T.StructType, T.ArrayType, T.MapType)) else _masked_type(dtype.valueType, None, patterns), True)
    if _key_contains(key, patterns):
        return T.StringType()
    return dtype


def sanitize_headers(headers: Column, sensitive=C.SENSITIVE_HEADERS) -> Column:
    """map<string, array<string>> -> map<string, string>: an exactly named
    sensitive header becomes ``[REDACTED]``, any other keeps its first value."""
    keyset = [h.lower() for h in sensitive]
    return F.transform_values(
        headers, lambda k, v: F.when(F.lower(k).isin(keyset), F.lit(C.KEY_REDACTED)).otherwise(F.element_at(v, 1))
    )


def merge_meta(base: Column, extra: Column) -> Column:
    """Merge two maps; keys of ``extra`` win.  Colliding keys are dropped
    from ``base`` first, so no session dedup policy is needed."""
    empty = F.create_map().cast("map<string,string>")
    b, e = F.coalesce(base, empty), F.coalesce(extra, empty)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(e), k)), e)
