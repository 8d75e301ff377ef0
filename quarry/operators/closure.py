"""What a set of starting points reaches along links: rounds over a slim link table, each node expanded once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import shared_folder


def reached(start: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level) of all nodes that ``start`` (node) reaches over ``links`` (source, target) in at most ``depth`` steps, with the fewest steps.

    A round joins the newest nodes with the links and keeps what no round has seen, so
    cycles end and no link is followed twice. Rounds are checkpoints; the driver learns
    only whether anything is new.
    """
    shared_folder(start.sparkSession)
    newest = start.select("node").filter("node is not null").distinct().withColumn("level", F.lit(0)).checkpoint()
    links = links.select("source", "target").filter("target is not null").distinct().checkpoint()
    seen, level = newest, 0
    while (depth is None or level < depth) and not newest.isEmpty():
        level += 1
        onward = newest.join(links, newest["node"] == links["source"]).select(F.col("target").alias("node")).distinct()
        newest = onward.join(seen, "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        seen = seen.unionByName(newest)
        if level % 8 == 0:  # a long walk doesn't grow the plan
            seen = seen.checkpoint()
    return seen
