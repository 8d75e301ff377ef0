"""Line dedup with levelled sorted runs of line hashes (native DataFrame operations only).

Every batch of documents is reduced to one row a line key (hash pair, number of
documents, largest doc_id) and merge-anti-joined with the runs kept so far. Keys
that no run holds are fresh and become a sorted run of their own, so every key lies
in exactly one run; keys that recur go to that run's log of recurrences. When a
level holds ``fanout`` runs they are merged into one run of the next level, and
their logs are added up. A key's count is that of its run and of the logs. Runs are
tables in the shared scratch folder.

Keys to drop are broadcast up to ``BROADCAST_KEYS``; beyond, lines meet them in a
merge join over two written tables, which adaptive execution can split, so that a
line in every document is no hot task.

Defined cases: null or empty text is one empty line; keys shorter than
``min_chars`` code points never drop; a null doc_id counts as one document that
sorts before all others; repeated rows (same id and text) count as one document
and each gets the same decision; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Keys to drop up to this many (24 bytes each) are broadcast.
BROADCAST_KEYS = 500_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(common.WHITE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(_id, _rk, pos, h1, h2, batch) of every line long enough to be judged."""
    lines = common.texts(docs).select(*common.row_key(), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("_id", "_rk", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return lines.select(
        "_id", "_rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("batch"),
    )


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, max_doc), each key in one run, and the logs of recurring keys beside them."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    @staticmethod
    def united(tables: list[DataFrame]) -> DataFrame | None:
        out = None
        for one in tables:
            out = one if out is None else out.unionByName(one)
        return out

    @staticmethod
    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def tables(self, fresh: bool) -> list[DataFrame]:
        """The runs, or the logs."""
        return [pair[not fresh] for level in self.levels for pair in level]

    @staticmethod
    def summarise(lines: DataFrame) -> DataFrame:
        return lines.groupBy(*KEY).agg(F.countDistinct("_id").alias("n_docs"), F.max("_id").alias("max_doc"))

    def _write(self, run: DataFrame, log: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame]:
        """Run and log as the two folders of one sorted table."""
        rows = run.withColumn("fresh", F.lit(True))
        if log is not None:
            rows = rows.unionByName(log.withColumn("fresh", F.lit(False)))
        rows = common.materialise(rows.sortWithinPartitions("fresh", *KEY), name, "fresh")
        return rows.filter("fresh").drop("fresh"), rows.filter("not fresh").drop("fresh")

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch of summarised keys; returns its run (keys that are new) and its log (keys some run holds)."""
        known = self.united(self.tables(True))
        if known is None:
            pair = self._write(batch, None, "run-0")
        else:
            known = known.select(*KEY).hint("merge")
            pair = self._write(batch.join(known, KEY, "left_anti"), batch.join(known, KEY, "left_semi"), "run-0")
        self.levels[0].append(pair)
        self._compact(0)
        return pair

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        runs, logs = self.united([r for r, _ in self.levels[level]]), self.united([g for _, g in self.levels[level]])
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        spread = runs.repartition(common.shuffle_partitions(self.spark), *KEY)
        self.levels[level + 1].append(self._write(spread, self.added(logs), f"run-{level + 1}"))
        self._compact(level + 1)

    def common_keys(self, min_docs: int) -> DataFrame:
        """(h1, h2, max_doc) of keys in at least ``min_docs`` documents: the count of a key's run and of all logs."""
        again = self.added(self.united(self.tables(False))).withColumnsRenamed({"n_docs": "n_again", "max_doc": "max_again"})
        rows = self.united(self.tables(True)).join(again, KEY, "left")
        rows = rows.filter(F.col("n_docs") + F.coalesce("n_again", F.lit(0)) >= min_docs)
        return rows.select(*KEY, F.greatest("max_doc", "max_again").alias("max_doc"))


def common_drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(_id, _rk, drop): positions of the lines that each row loses."""
    lines = common.materialise(keyed_lines(docs, min_chars, batches), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    for k in range(batches):
        own = lines.filter(F.col("batch") == k).select(*KEY, "_id")
        runs.add(common.materialise(LineRuns.summarise(own), "keys"))
    keys = common.materialise(runs.common_keys(min_docs), "common-keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
    drops = lines.join(keys, KEY).filter(F.col("_id") < F.col("max_doc"))
    return drops.groupBy("_id", "_rk").agg(F.collect_set("pos").alias("drop"))


def kept_text() -> Column:
    """The text without the lines at the positions in ``drop`` (null: none)."""
    lines = split_lines(F.col("text"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    return F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Rows of ``docs`` as (doc_id, text, n_lines, n_dropped, kept_text)."""
    drops = common_drops(docs, min_chars, min_docs, batches, fanout)
    rows = common.texts(docs).select("doc_id", "text", *common.row_key())
    rows = rows.join(drops.hint("shuffle_hash"), ["_id", "_rk"], "left")
    return rows.select(
        "doc_id", "text", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long").alias("n_dropped"),
        kept_text().alias("kept_text"),
    )


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with its own columns: text without the dropped lines (a null stays null), n_chars following it if there is one."""
    drops = common_drops(docs, min_chars, min_docs, batches, fanout)
    drops = drops.select(F.struct("_id", "_rk").alias("_key"), "drop")
    rows = common.keyed_rows(docs).join(drops.hint("shuffle_hash"), "_key", "left")
    rows = rows.select("_row", "drop", F.col("_row.text").alias("text")).select("_row", kept_text().alias("_new"))
    return common.plain_rows(rows, docs, text=F.col("_new"), n_chars=F.length("_new").cast(dict(docs.dtypes).get("n_chars", "long")))
