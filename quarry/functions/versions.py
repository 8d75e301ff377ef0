"""Version labels: majors, series, prereleases, latest tags, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a prerelease tag anywhere in it, and whole names that are none (fixed values).
PRERELEASE_PARTS = ["-alpha", "-beta", "-rc", "-canary", "-dev", "-nightly", "-preview", "-pre", "-next", "-snapshot", "-unstable"]
PRERELEASE_NAMES = ["canary", "next", "nightly", "latest", "dev", "master", "main"]
#: Parts of platform package names (fixed values).
PLATFORM_WORDS = ["darwin", "linux", "win32", "windows"]
PLATFORM_SUFFIXES = ["-x64", "-arm64", "-amd64"]


def major_label(tag: Column) -> Column:
    """'N.x' of the first number before a dot; null without one."""
    n = F.regexp_extract(tag, r"(\d+)\.", 1)
    return F.when(n != "", F.concat(n, F.lit(".x")))


def suggested_label(version: Column) -> Column:
    """'N.x' of the first number before a dot, else of the first number."""
    dotted, plain = F.regexp_extract(version, r"(\d+)\.", 1), F.regexp_extract(version, r"(\d+)", 1)
    return F.when(dotted != "", F.concat(dotted, F.lit(".x"))).when(plain != "", F.concat(plain, F.lit(".x")))


def series(label: Column) -> Column:
    """Major number of a series label such as '16.x' or 'v17.x'; null for others."""
    return F.regexp_extract(F.btrim(label), r"(?i)\Av?(\d+)\.x\z", 1).try_cast("int")


def semver(tag: Column) -> Column:
    """(major, minor, patch) of the first dotted triple or pair; null without one."""
    pattern = r"(\d+)\.(\d+)(?:\.(\d+))?"
    part = lambda k: F.coalesce(F.regexp_extract(tag, pattern, k).try_cast("long"), F.lit(0))
    return F.when(tag.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def is_prerelease(tag: Column) -> Column:
    low = F.lower(tag)
    out = low.isin(PRERELEASE_NAMES)
    for part in PRERELEASE_PARTS:
        out = out | low.contains(part)
    return out


def is_platform_package(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for part in [*PLATFORM_WORDS, *PLATFORM_SUFFIXES]:
        out = out | low.contains(part)
    return out


def latest_by_major(tags: DataFrame) -> DataFrame:
    """(source_id, label, tag) of the greatest version of each major; of equals the first listed. Input: source_id, pos, tag."""
    v = tags.withColumn("v", semver(F.col("tag"))).filter("v is not null")
    best = v.groupBy("source_id", F.col("v.major").alias("major")).agg(F.max_by("tag", F.struct(F.col("v"), -F.col("pos"))).alias("tag"))
    return best.select("source_id", F.concat(F.col("major").cast("string"), F.lit(".x")).alias("label"), "tag")


def latest_of_series(tags: DataFrame, label: str) -> DataFrame:
    return latest_by_major(tags).filter(F.col("label") == F.concat(series(F.lit(label)).cast("string"), F.lit(".x")))


def default_version(tags: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, ref, label): first listed tag and its major, else the default branch. Sources: source_id, default_branch."""
    first = tags.groupBy("source_id").agg(F.min_by("tag", "pos").alias("tag"))
    ref = F.coalesce("tag", "default_branch")
    return sources.join(first, "source_id", "left").select("source_id", ref.alias("ref"), F.coalesce(major_label(F.col("tag")), ref).alias("label"))


def version_plan(tags: DataFrame, sources: DataFrame, recorded: DataFrame, top: int = 3) -> DataFrame:
    """(source_id, label, ref) to ingest: recorded labels, the source's own, and the newest ``top`` majors.

    The ref of a label is the recorded one, else the latest tag of its series, else
    the source's own ref, else its default branch. Sources: source_id, version_label, ref, default_branch.
    """
    latest = latest_by_major(tags)
    rank = F.row_number().over(_by_major())
    newest = latest.withColumn("n", rank).filter(F.col("n") <= top).select("source_id", "label")
    labels = recorded.select("source_id", F.col("version_label").alias("label")).unionByName(sources.select("source_id", F.col("version_label").alias("label"))).unionByName(newest)
    labels = labels.dropna().distinct()
    out = labels.join(recorded.select("source_id", F.col("version_label").alias("label"), F.col("ref").alias("r0")), ["source_id", "label"], "left")
    out = out.join(latest.withColumnRenamed("tag", "r1"), ["source_id", "label"], "left").join(sources.select("source_id", F.col("ref").alias("r2"), "default_branch"), "source_id", "left")
    return out.select("source_id", "label", F.coalesce("r0", "r1", "r2", "default_branch").alias("ref"))


def _by_major():
    from pyspark.sql import Window

    return Window.partitionBy("source_id").orderBy(F.desc(series(F.col("label"))), "label")


def label_order() -> list[Column]:
    """Sort keys of version labels: series from new to old, then the others by name."""
    n = series(F.col("label"))
    return [n.isNull(), n.desc(), F.col("label")]
