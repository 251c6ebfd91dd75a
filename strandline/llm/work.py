"""Shared-folder tables: how jobs of this subpackage cut lineage and survive lost executors.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir``, which driver and executors
share. The setting is read from the session and only set where it is unset (tests).
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at once, where the session leaves that open.
BATCH_BYTES = 4 << 20
#: Rows of narrow tables for which one file will do.
ROWS_A_FILE = 500_000


def lean(run):
    """For functions of ``mapInArrow``: at a partition's end the worker, which Spark keeps, gives its free memory back."""

    @functools.wraps(run)
    def trimmed(batches, *args, **options):
        try:
            yield from run(batches, *args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return trimmed


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts do not come ten thousand at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > 1 << 30:
        spark.conf.set(key, str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str, by_link: bool | None = None) -> bool:
    """Writes a small file that is there whole or not at all; False if there is one already.

    The text goes to a file of its own first. On a local or mounted folder that gets its name by a hard link,
    elsewhere by a rename that does not overwrite (atomic on HDFS); of several writers one succeeds.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, fs = _fs(spark, path)
    tmp, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(tmp)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    dst, src = fs.makeQualified(p), fs.makeQualified(tmp)
    try:
        if fs.getUri().getScheme() == "file" if by_link is None else by_link:
            jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(dst.toUri()), jvm.java.nio.file.Paths.get(src.toUri()))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), conf).rename(src, dst, how)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(tmp, False)


class Scratch:
    """A folder of intermediate tables of one operator call.

    ``save`` writes a table and reads it back, so that later stages start from files instead of a long
    lineage. ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{work_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: how many there are at most, if known, so that few rows do not make many files."""
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_A_FILE)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_strandline_path", None)
        if path:
            delete(self.spark, path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, not at some later collection."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """``edges(a, b)`` with those of each part replaced by a star around the smallest node of what they join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = _labels(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], schema=schema)

    return edges.select("a", "b").coalesce(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: within parts first, then by alternating large and small stars.

    Returns ``(node, component)`` for each node of an edge; ``component`` is the smallest node that links
    reach. Null ends and self-links are ignored. A part has ``ROWS_A_FILE`` edges on average, so its task's memory
    is bounded; if there is one part, its stars are the result. Otherwise all steps are joins and partial
    aggregates over the stars; nothing is gathered per component. Each round but the last shortens the longest path.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    every = scratch.save(e.where("a is not null and b is not null and a <> b"), "edges")
    parts = 1 + every.count() // ROWS_A_FILE
    e = scratch.save(_contracted(every, parts), "edges")
    scratch.drop(every)
    if parts == 1:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
    seen, rows = None, e.count()
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        nxt = scratch.save(small.select("s.a", "s.b").where("a <> b").distinct(), "edges", 2 * rows)
        scratch.drop(e)
        e = nxt
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now, rows = (sign["n"], sign["h"]), sign["n"]
        if now == seen:
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        seen = now
