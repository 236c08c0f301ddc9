"""Display column functions: ISO timestamps, truncation, relative time.

All are built-in expressions (codegen'd, JVM side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso8601(ts: Column) -> Column:
    """``2024-01-30T23:59:59+00:00`` (UTC, seconds precision)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def iso_string(ts: Column) -> Column:
    """``2024-01-30T23:59:59.000000Z`` (UTC, microseconds)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp (floor), independent
    of the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def truncate(text: Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer than ``n``."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _unit(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.lit(unit), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def relative_time(ts: Column, as_of: Column) -> Column:
    """Human relative time against ``as_of``: ``5 minutes ago`` /
    ``2 hours from now``.  Units floor: seconds, minutes, hours, days (< 7),
    weeks (< 30 days), months (30-day), years (365-day)."""
    # whole seconds between the two wall-clock times, independent of the session zone
    secs = F.abs(epoch_seconds(as_of) - epoch_seconds(ts))
    days = F.floor(secs / 86400)
    amount = (
        F.when(secs < 60, _unit(secs, "second"))
        .when(secs < 3600, _unit(F.floor(secs / 60), "minute"))
        .when(secs < 86400, _unit(F.floor(secs / 3600), "hour"))
        .when(days < 7, _unit(days, "day"))
        .when(days < 30, _unit(F.floor(days / 7), "week"))
        .when(days < 365, _unit(F.floor(days / 30), "month"))
        .otherwise(_unit(F.floor(days / 365), "year"))
    )
    suffix = F.when(ts <= as_of, F.lit(" ago")).otherwise(F.lit(" from now"))
    return F.when(ts.isNotNull(), F.concat(amount, suffix))


# DuckDB twin of ``relative_time`` for oracle SQL (``{ts}`` and ``{as_of}`` are SQL).
RELATIVE_SQL = """CASE WHEN {ts} IS NULL THEN NULL ELSE concat(
  CASE
    WHEN s < 60 THEN s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END
    WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END
    WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END
    WHEN s // 86400 < 7 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END
    WHEN s // 86400 < 30 THEN (s // 86400 // 7) || ' week' || CASE WHEN s // 86400 // 7 = 1 THEN '' ELSE 's' END
    WHEN s // 86400 < 365 THEN (s // 86400 // 30) || ' month' || CASE WHEN s // 86400 // 30 = 1 THEN '' ELSE 's' END
    ELSE (s // 86400 // 365) || ' year' || CASE WHEN s // 86400 // 365 = 1 THEN '' ELSE 's' END
  END,
  CASE WHEN {ts} <= {as_of} THEN ' ago' ELSE ' from now' END) END"""


def relative_sql(ts: str, as_of: str) -> str:
    s = f"abs(CAST(epoch({as_of}) AS BIGINT) - CAST(floor(epoch({ts})) AS BIGINT))"
    return RELATIVE_SQL.replace("s //", f"{s} //").replace("WHEN s <", f"WHEN {s} <").replace("WHEN s =", f"WHEN {s} =").replace(
        "THEN s ||", f"THEN {s} ||"
    ).format(ts=ts, as_of=as_of)
