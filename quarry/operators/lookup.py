"""Document and library lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text, versions


def by_path_or_uri(documents: DataFrame, blobs: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The active document with this path or uri; of several the newest series, then the smallest id."""
    found = documents.filter(F.col("active") & ((F.col("uri") == key) | (F.col("path") == key)))
    if version:
        found = found.filter(F.col("version_label") == version)
    found = found.orderBy(F.desc_nulls_last(versions.series(F.col("version_label"))), "document_id").limit(1)
    return found.join(blobs, "hash")


def by_id(documents: DataFrame, blobs: DataFrame, document_id: int) -> DataFrame:
    return documents.filter(F.col("active") & (F.col("document_id") == document_id)).limit(1).join(blobs, "hash")


def sliced(found: DataFrame, spec: str | None) -> DataFrame:
    """Adds payload and error for a slice 'a:b' of the content; no slice gives it whole."""
    if spec is None:
        return found.withColumn("payload", F.col("content")).withColumn("error", F.lit(None).cast("string"))
    a, b = F.split(F.lit(spec), ":")[0].try_cast("int"), F.get(F.split(F.lit(spec), ":"), F.lit(1)).try_cast("int")
    error = text.slice_error(F.col("content"), F.lit(spec))
    return found.withColumn("error", error).withColumn("payload", F.when(error.isNull(), text.line_slice(F.col("content"), a, b)))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def match_score(name: Column, query: str) -> Column:
    """100 equal, 95 equal without punctuation, 80 or 70 less the place where the query is found, at most 20; else 0."""
    q = F.lower(F.btrim(F.lit(query)))
    low, at = F.lower(name), F.instr(F.lower(name), query.strip().lower())
    bare, bare_at = _plain(name), F.locate(_plain_literal(query), _plain(name))
    known = F.lit(_plain_literal(query) != "")
    return (
        F.when(low == q, 100)
        .when(known & (bare == F.lit(_plain_literal(query))), 95)
        .when(at > 0, 80 - F.least(F.lit(20), at - 1))
        .when(known & (bare_at > 0), 70 - F.least(F.lit(20), bare_at - 1))
        .otherwise(0)
    )


def _plain_literal(query: str) -> str:
    return "".join(c for c in query.lower() if c.isascii() and c.isalnum())


def resolve_library(sources: DataFrame, query: str) -> DataFrame:
    """Sources that a text names: by id if it is a number, by exact name, else those of the best score; several rows: ambiguous."""
    if query.strip().isdigit():
        return sources.filter(F.col("id") == int(query)).withColumn("score", F.lit(100))
    full = F.concat_ws("/", "owner", "repo")
    scored = sources.withColumn("score", F.greatest(match_score(F.col("name"), query), match_score(F.coalesce(full, F.lit("")), query)))
    best = F.max("score").over(Window.partitionBy())
    return scored.filter("score > 0").withColumn("_best", best).filter("score = _best").drop("_best")


def search_libraries(sources: DataFrame, source_versions: DataFrame, query: str, version: str | None = None, limit: int = 20) -> DataFrame:
    """(id, name, score, versions) by score and name; versions hold the source's own label first, each once."""
    listed = source_versions.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("synced_at"), F.col("version_label")))), lambda x: x.version_label).alias("v"))
    full = F.concat_ws("/", "owner", "repo")
    rows = sources.join(listed, sources.id == listed.source_id, "left")
    labels = F.array_distinct(F.array_compact(F.concat(F.array("version_label"), F.coalesce(F.reverse("v"), F.array().cast("array<string>")))))
    rows = rows.select("id", "name", F.greatest(match_score(F.col("name"), query), match_score(full, query)).alias("score"), labels.alias("versions")).filter("score > 0")
    if version:
        rows = rows.filter(F.array_contains("versions", version))
    return rows.orderBy(F.desc("score"), "name").limit(limit)


def fallback_label(version: str) -> str | None:
    """'16.x' for '16.2.1'."""
    import re

    m = re.match(r"v?(\d+)\.", version)
    return f"{m[1]}.x" if m and not re.fullmatch(r"v?\d+\.x", version) else None


def infer_library(sources: DataFrame, path_or_uri: str) -> DataFrame:
    """Sources a repository or page address lies in; the longest root first."""
    repo = F.concat(F.lit("gh://"), F.col("owner"), F.lit("/"), F.col("repo"))
    inside = F.lit(path_or_uri).startswith(F.concat(repo, F.lit("@"))) | F.lit(path_or_uri).startswith(F.col("root_url"))
    return sources.filter(F.coalesce(inside, F.lit(False))).orderBy(F.desc(F.length("root_url")), "id")
