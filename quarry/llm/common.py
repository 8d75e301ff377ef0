"""Shared helpers: table access, row identity, scratch tables on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and strip rules (space, tab to carriage return).
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside join keys.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of at most ``rows`` rows, which bounds the Arrow buffers of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a document table whatever else it holds; null text becomes empty."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key_of(doc_id: Column, text: Column) -> list[Column]:
    """Join key of a row: its id and a hash of its text, so that repeated ids do not mix."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_rk")]


def row_key() -> list[Column]:
    return row_key_of(F.col("doc_id"), F.col("text"))


def columns(df: DataFrame) -> list[Column]:
    """Every column, whatever its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(_row, _key): the columns of each row as one struct, and its join key."""
    key = F.struct(*row_key_of(F.col("doc_id"), F.coalesce("text", F.lit("")))).alias("_key")
    return docs.select(F.struct(*columns(docs)).alias("_row"), key)


def plain_rows(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``_row``, some of them changed."""
    return rows.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where a local session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quarry-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to shared scratch, in folders ``by`` columns, and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release() -> None:
    """Gives freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def settle(spark: SparkSession) -> None:
    """Between jobs: the driver drops what nothing refers to, so that Spark's cleaner removes its shuffle files, broadcasts and checkpoints."""
    release()
    spark.sparkContext._jvm.System.gc()


def released(batches):
    """The batches of a task, and then a release; Python workers live on after a task."""
    yield from batches
    release()


def map_texts(docs: DataFrame, judge, schema: str, slice_rows: int = 1000) -> DataFrame:
    """(doc_id, columns of ``schema``) of every row: ``judge`` takes a list of texts and returns a dict of lists."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(f"doc_id bigint, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                columns = judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(columns[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return texts(docs).mapInArrow(lambda batches: released(run(batches)), out)


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, every column as it is, whose text (null: empty) ``keep`` accepts; it maps a list of texts to booleans."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*columns(docs)).alias("_row"))

    def run(batches):
        for batch in batches:
            found = [x or "" for x in batch.column("_row").field("text").to_pylist()]
            yield batch.filter(pa.array(keep(found), pa.bool_()))

    return plain_rows(rows.mapInArrow(lambda batches: released(run(batches)), rows.schema), docs)
