"""Trees of repositories' paths as text, by keys that sort as the tree is read.

An entry's key is the list of (class, lower-case name, name) of its parts. Lists compare
part by part and a beginning comes before what goes on from it, so the order of keys is
that of the tree: a folder, what it holds, its next neighbour. Whether an entry is the
last of its folder is a maximum by folder, and the rails to its left are those of the
folders it lies in, found by an equality join on the paths of its beginnings. No source
is gathered for any of this; only the text of a source, which is one value, is put
together from its sorted lines at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that come first in a directory (fixed values).
IMPORTANT = ["package.json", "pyproject.toml", "cargo.toml", "go.mod", "license", "changelog.md"]
KEY = "array<struct<class: int, low: string, name: string>>"


def _part(name: Column, folder: Column) -> Column:
    """Readme first, then important files, then folders, then the rest; by name among equals."""
    low = F.lower(name)
    kind = F.when(low.startswith("readme"), 0).when(low.isin(IMPORTANT), 1).when(folder, 2).otherwise(3)
    return F.struct(kind.alias("class"), low.alias("low"), name.alias("name"))


def entries(files: DataFrame) -> DataFrame:
    """(source_id, key, is_folder) of every file and every folder above one, each once. Empty parts of paths are skipped."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    parts = F.when(F.size(parts) == 0, F.array("path")).otherwise(parts)
    count = F.size("parts")
    key = lambda size: F.transform(F.slice("parts", 1, size), lambda p, k: _part(p, k < count - 1))
    rows = files.filter("path is not null").select("source_id", parts.alias("parts")).distinct()
    rows = rows.select("source_id", F.explode(F.transform(F.sequence(F.lit(1), count), lambda size: F.struct(key(size).alias("key"), (size < count).alias("is_folder")))).alias("e"))
    return rows.select("source_id", F.col("e.key").cast(KEY).alias("key"), "e.is_folder").distinct()


def tree_lines(files: DataFrame) -> DataFrame:
    """(source_id, key, line) of files (source_id, path): the lines of each source's tree; sorted by key they are the tree."""
    rows = entries(files).withColumn("folder", F.slice("key", 1, F.size("key") - 1))
    last = rows.groupBy("source_id", "folder").agg(F.max(F.element_at("key", -1)).alias("last"), F.max_by("is_folder", F.struct(F.element_at("key", -1), "is_folder")).alias("last_is_folder"))
    rows = rows.join(last, ["source_id", "folder"])
    # of a file and a folder with one key the folder comes last
    rows = rows.withColumn("is_last", (F.element_at("key", -1) == F.col("last")) & (F.col("is_folder") == F.col("last_is_folder"))).select("source_id", "key", "is_folder", "is_last")
    rails = rows.filter("is_folder").select("source_id", F.col("key").alias("above"), F.when(F.col("is_last"), "    ").otherwise("│   ").alias("rail"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("key") - 1, F.lit(1))), lambda size: F.slice("key", 1, size))
    inner = rows.filter(F.size("key") > 1).select("source_id", "key", "is_folder", F.explode(steps).alias("above")).join(rails, ["source_id", "above"])
    left = inner.groupBy("source_id", "key", "is_folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.size("above").alias("at"), "rail"))), lambda r: r["rail"]), "").alias("indent"))
    rows = rows.join(left, ["source_id", "key", "is_folder"], "left")
    name = F.concat(F.element_at("key", -1)["name"], F.when(F.col("is_folder"), "/").otherwise(""))
    line = F.concat(F.coalesce("indent", F.lit("")), F.when(F.col("is_last"), "└── ").otherwise("├── "), name)
    return rows.select("source_id", "key", "is_folder", line.alias("line"))


def repo_trees(files: DataFrame) -> DataFrame:
    """(source_id, tree) of files (source_id, path)."""
    lines = tree_lines(files).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("key", "is_folder", "line"))).alias("lines"))
    return lines.select("source_id", F.array_join(F.transform("lines", lambda r: r["line"]), "\n").alias("tree"))
