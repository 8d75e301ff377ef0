"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and gets all that the stage before kept.
The first four return the columns of ``documents``; the last returns packed pieces.

Defined cases, the same for every stage: an empty table gives an empty one; columns
other than doc_id and text are carried untouched, whatever their names (n_chars
follows the text in line dedup), and packing ignores them; a null doc_id stays null.
Null, empty and wordless texts fail the quality rules; the later stages keep them
(line dedup leaves a null text null, near duplicates link them with nothing,
decontamination finds nothing in them, packing makes the separator of them). Repeated
rows are kept or dropped together, except that near duplicates name a component by
an id: rows that share the kept id and an equal set of shingles all stay. Texts of
any length are taken whole. Equal ranks go to the smallest id, and to the largest
where line dedup keeps a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, decontam, linededup, neardup, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def settled(stage: Stage) -> Stage:
    """The stage, after the driver has let go of what the stage before left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@settled
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line model keep."""
    return quality.quality_filter(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


@settled
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document repeats; n_chars follows the text."""
    return linededup.drop_lines(docs)


@settled
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component."""
    return neardup.keep_first(docs)


@settled
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


@settled
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The line model, the latent space and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
