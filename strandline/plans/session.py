"""Shipping the package to executors that cannot import it."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandline/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at once, where the session leaves that open.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts do not come ten thousand at a time."""
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)
    if spark.conf.get(key, unset) == unset:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame, by: str | Sequence[str], rows: int) -> DataFrame:
    """A table whose rows cost much more than their bytes say, dealt to tasks of some ``rows`` rows each.

    Left to the bytes, a narrow table of any number of rows comes in one task or two. The count reads footers only.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows)), *([by] if isinstance(by, str) else by))


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files unless the workers find it anyway (working folder or PYTHONPATH)."""
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    sc = spark.sparkContext
    if str(ROOT) in known or "strandline.zip" in getattr(sc, "_python_includes", []):
        return
    folder = tempfile.mkdtemp()
    sc.addPyFile(shutil.make_archive(f"{folder}/strandline", "zip", ROOT, "strandline"))
