"""Helpers shared by the training-data operators: tables, shared scratch tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import ensure_checkpoint_dir

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of two 64-bit numbers that may be broadcast (32 MB as they travel); above it a shuffled join is used.
BROADCAST_ROWS = 2_000_000


#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that travel to a Python worker at once; the JVM and the worker each hold so many for every running task.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes that travel to a Python worker at once, where rows are bounded, too; a row alone may be larger.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n: the folds of the held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors once an application, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        # read by the driver alone, which serves it
        path = os.path.join(tempfile.mkdtemp(prefix="faultline-code-"), "faultline_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


class Scratch:
    """Tables that cut lineage, written under the shared ``spark.checkpoint.dir``.

    A lost executor is repaired by rereading them.  ``drop`` deletes a table
    that no later step reads, so a job's peak disk is that of its live tables.
    With ``tidy`` a table's shuffle files are removed as soon as it is written;
    otherwise they stay until the driver's garbage collector finds them unused.
    """

    def __init__(self, spark: SparkSession, op: str, tidy: bool = False):
        ship(spark)
        self.spark, self.tidy = spark, tidy
        self.base = f"{ensure_checkpoint_dir(spark)}/{op}-{uuid.uuid4().hex[:12]}"

    def _run(self, df: DataFrame, act, batch: int | None = None):
        conf = ({CLEANUP: "true"} if self.tidy else {}) | ({BATCH: str(batch), BATCH_BYTES: str(MOST_BYTES)} if batch else {})
        before = {k: self.spark.conf.get(k) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            # the plan of a frame made here is new and takes the settings as they are now
            return act(df.select("*") if conf else df)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def write(self, df: DataFrame, name: str, batch: int | None = None, block: int | None = None) -> DataFrame:
        """The table read back; ``batch`` bounds the rows that its Python functions get at once, ``block`` the bytes that are read at once."""
        # blocks are measured at each row, as a row may be large
        path, options = f"{self.base}/{name}", {"parquet.block.size": str(block), "parquet.page.size.row.check.min": "1"} if block else {}
        self._run(df, lambda x: x.write.mode("overwrite").options(**options).parquet(path), batch)
        return self.spark.read.schema(df.schema).parquet(path)

    def collect(self, df: DataFrame) -> list:
        """Few rows, for the driver."""
        return self._run(df, lambda x: x.collect())

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side of ``rows`` counted rows for broadcast only while it is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, component), the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two joins and
    partial aggregations on (a, b) rows, so a hub with a third of all links is
    split by AQE and never gathered.  Rounds end when the link table repeats.
    Nodes without a link are absent.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen, i = scratch.write(e, f"{name}-0"), None, 0
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == seen:
            break
        seen, i = mark, i + 1
        low = (
            e.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .union(e.select(F.col("b").alias("u"), F.col("b").alias("v")))
            .groupBy("u").agg(F.min("v").alias("m"))
        )
        large = e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hop = large.join(least, large.a == least.u)
        step = hop.select("a", F.col("m").alias("b")).union(hop.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = scratch.write(step.where("a <> b").distinct(), f"{name}-{i}")
        if i > 1:
            scratch.drop(f"{name}-{i - 2}")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
