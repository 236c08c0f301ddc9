"""Stored tables: declared schemas, folders by day, and commits that are whole or not at all.

A table keeps its rows under ``data/<version>/day=YYYY-MM-DD`` and, for each
version, a manifest that names the folder standing for each day.  A write stages
its days in a folder of its own and then commits by renaming one manifest into
place, so a crash at any moment leaves either the old table or the new one;
readers take the newest manifest.  Only the days that a change touches are
written again.  A manifest has a line a day, and days outside a reader's range
are pruned by it before any file is listed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The errors table; JSON columns are text, read by ``functions.jsontext``.
ERRORS = (
    "id long, error_id string, exception_class string, error_code string, message string, status_code int, context string, meta string, "
    "request_method string, request_url string, request_headers string, request_data string, user_id string, ip_address string, "
    "user_agent string, is_resolved boolean, resolved_at timestamp_ntz, resolved_by string, resolution_notes string, occurrence_count long, "
    "first_occurred_at timestamp_ntz, last_occurred_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
TRENDS = "date date, error_code string, status_code int, count long, hourly_distribution array<int>"
BREAKERS = (
    "id long, service string, operation string, state string, failure_count int, failure_threshold int, recovery_timeout int, "
    "success_threshold int, last_failure_at timestamp_ntz, opened_at timestamp_ntz, next_attempt_at timestamp_ntz, updated_at timestamp_ntz"
)
#: The day of rows that have none.
NO_DAY = "none"


def as_schema(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are null, others are left out."""
    fields = T.StructType.fromDDL(schema).fields
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


class StoredTable:
    """A table of ``schema`` under ``path`` with the rows of each ``day`` in a folder of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, day: Callable[[], Column]):
        self.spark, self.path, self.schema, self.day = spark, path, schema, day
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))

    # ---- manifests ----

    def version(self) -> int:
        """The number of commits so far."""
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """day -> folder (under ``path``) of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path("manifests", str(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, version: int, days: dict[str, str]) -> None:
        """Puts the manifest of ``version`` in place; fails if another writer was first."""
        staged = self._path("manifests", f".{version}-{uuid.uuid4().hex}")
        out = self.fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        finally:
            out.close()
        target = self._path("manifests", str(version))
        if self.fs.exists(target) or not self.fs.rename(staged, target):
            self.fs.delete(staged, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another job")

    # ---- reading ----

    def read(self, since: str | None = None, until: str | None = None, days: list[str] | None = None) -> DataFrame:
        """The rows, of the days from ``since`` to ``until`` (inclusive, YYYY-MM-DD) or of ``days`` only.

        Files of older versions of the schema are read as they are: columns
        that they lack are null, columns that the schema lacks are left out.
        Rows without a day are read when no range is given.
        """
        found = self.manifest()
        if days is not None:
            found = {d: f for d, f in found.items() if d in days}
        elif since is not None or until is not None:
            found = {d: f for d, f in found.items() if d != NO_DAY and (since is None or d >= since) and (until is None or d <= until)}
        if not found:
            return self.spark.createDataFrame([], self.schema)
        folders = [os.path.join(self.path, f) for _, f in sorted(found.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    # ---- writing ----

    def write(self, rows: DataFrame, whole: bool = False, empty: list[str] = ()) -> list[str]:
        """Commits ``rows`` as the new content of their days and returns these days.

        ``whole``: the rows are the whole table, so other days go.  ``empty``
        names days that have no rows any more.  ``rows`` may be derived from
        this table: the old folders stay until ``vacuum``.
        """
        version = self.version() + 1
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        day = F.coalesce(F.date_format(self.day(), "yyyy-MM-dd"), F.lit(NO_DAY))
        staged = os.path.join(self.path, folder)
        as_schema(rows, self.schema).withColumn("day", day).write.partitionBy("day").parquet(staged)
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory()]
        written = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("day=")}
        kept = {} if whole else {d: f for d, f in self.manifest().items() if d not in empty}
        self._commit(version, kept | written)
        return sorted(written)

    def change(self, days: list[str], make: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Rewrites ``days`` by ``make``, whose rows stay on these days; days that it leaves empty go."""
        return self.write(make(self.read(days=days)), empty=days)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the versions but for the newest ``keep``, and folders that none of these names; returns the folders."""
        newest = self.version()
        live = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v).values()}
        gone = []
        for version in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []:
            name = f"data/{version.getPath().getName()}"
            if int(version.getPath().getName().partition("-")[0]) > newest:
                continue  # a write that has not committed yet
            for part in self.fs.listStatus(version.getPath()):
                folder = f"{name}/{part.getPath().getName()}"
                if part.isDirectory() and folder not in live:
                    self.fs.delete(part.getPath(), True)
                    gone.append(folder)
        for status in self.fs.listStatus(self._path("manifests")) if newest else []:
            number = status.getPath().getName()
            if number.isdigit() and int(number) <= newest - keep:
                self.fs.delete(status.getPath(), False)
        return sorted(gone)


def errors_table(spark: SparkSession, path: str) -> StoredTable:
    """The errors by the day of their first sighting (``created_at`` where that is unknown)."""
    return StoredTable(spark, path, ERRORS, lambda: F.coalesce("first_occurred_at", "created_at"))


def trends_table(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, TRENDS, lambda: F.col("date"))


def breakers_table(spark: SparkSession, path: str) -> StoredTable:
    """The breakers, a small table in one folder."""
    return StoredTable(spark, path, BREAKERS, lambda: F.lit(None).cast("date"))


def merge_errors(table: StoredTable, batch: DataFrame) -> list[str]:
    """D1 over a stored errors table: the days that were written.

    The batch is rolled up by error_id.  A known error adds to its counts and
    widens its sightings and keeps its other columns; a new one is added on the
    day of its first sighting.  Only the days of the known errors and of the new
    ones are read whole and written again; the rest of the table is read for its
    ids alone.  An error whose first sighting moves to an earlier day moves
    along.
    """
    spark, new = table.spark, as_schema(batch, ERRORS)
    at = F.coalesce("first_occurred_at", "created_at")
    order, last = F.struct(at, F.col("id")), F.coalesce("last_occurred_at", "created_at")
    plain = [f.name for f in T.StructType.fromDDL(ERRORS).fields if f.name not in ("error_id", "occurrence_count", "first_occurred_at", "last_occurred_at")]
    rolled = new.groupBy("error_id").agg(
        F.min_by(F.struct(*plain), order).alias("r"), F.sum(F.coalesce("occurrence_count", F.lit(1))).alias("n"), F.min(at).alias("first"), F.max(last).alias("last")
    )
    known = table.read().select("error_id", table.day().alias("day")).join(rolled.select("error_id"), "error_id", "left_semi")
    days = known.select("day").union(rolled.select(F.to_date("first").alias("day"))).select(F.date_format("day", "yyyy-MM-dd")).distinct()
    days = sorted(NO_DAY if r[0] is None else r[0] for r in days.collect())  # a row a day

    def make(old: DataFrame) -> DataFrame:
        o, b = old.alias("o"), rolled.alias("b")
        j = o.join(b, F.col("o.error_id") == F.col("b.error_id"), "full_outer")
        was = F.col("o.error_id").isNotNull() | F.col("o.id").isNotNull()
        cols = [F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"b.r.{c}")).alias(c) for c in plain]
        hit = F.col("b.error_id").isNotNull()
        return j.select(
            F.coalesce("o.error_id", "b.error_id").alias("error_id"), *cols,
            F.when(was & ~hit, F.col("o.occurrence_count")).otherwise(F.coalesce("o.occurrence_count", F.when(was, 1).otherwise(0)) + F.coalesce("b.n", F.lit(0))).alias("occurrence_count"),
            F.when(was & ~hit, F.col("o.first_occurred_at")).otherwise(F.least(F.coalesce("o.first_occurred_at", "o.created_at"), F.col("b.first"))).alias("first_occurred_at"),
            F.when(was & ~hit, F.col("o.last_occurred_at")).otherwise(F.greatest(F.coalesce("o.last_occurred_at", "o.created_at"), F.col("b.last"))).alias("last_occurred_at"),
        )

    return table.change(days, make)


def request_meta(err: DataFrame) -> Column:
    """The request that an error came from."""
    return F.struct(F.col("request_method").alias("method"), F.col("request_url").alias("url"), F.col("ip_address").alias("ip"), F.col("user_agent").alias("user_agent"))


def read_json_lines(spark: SparkSession, path: str, schema: str = ERRORS) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of JSON lines: rows in ``schema``, and the lines that do not fit it with their file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.length(F.trim("value")) > 0)
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("__bad", T.StringType())])
    read = lines.select("value", "file", F.from_json("value", full, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return read.where(~bad).select("r.*").drop("__bad"), read.where(bad).select("file", F.col("value").alias("line"))
