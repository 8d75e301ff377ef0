"""The shared folder of a session: checkpoints and stores of queries."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder within the shared one for tables that nothing needs afterwards; it goes with them."""
    folder = f"{shared_folder(spark)}/quarry-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """A table written to the shared folder, or a folder within it, and read back: cuts lineage with one pass, and survives lost executors."""
    path = f"{folder or f'{shared_folder(rows.sparkSession)}/quarry-{uuid.uuid4().hex}'}/{name}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of at most ``rows`` rows, which bounds the Arrow buffers of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def small_steps(spark: SparkSession, split: int = 32 << 20) -> Iterator[None]:
    """While it lasts, files are read in splits of at most ``split`` bytes, so that a task's sort stays in memory, and a statement's shuffle files go when it ends."""
    want = {"spark.sql.files.maxPartitionBytes": f"{split}b", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    was = {key: spark.conf.get(key) for key in want}
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(was["spark.sql.files.maxPartitionBytes"]) <= split:
        del want["spark.sql.files.maxPartitionBytes"]
    for key, value in want.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in want:
            spark.conf.set(key, was[key])
