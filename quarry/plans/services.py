"""Services around the store: adding sources, syncing archives, library search, formatting, seed export, legacy import."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls, versions
from quarry.operators import lookup
from quarry.sources import files

SOURCES = (
    "id bigint, kind string, name string, owner string, repo string, ref string, docs_path string, ingest_mode string, version_label string, root_url string, "
    "allowed_paths string, denied_paths string, max_depth int, max_pages int, last_sync_at timestamp, last_commit string, last_etag string, last_error string"
)
VERSIONS = "source_id bigint, version_label string, ref string, commit_sha string, tree_hash string, etag string, synced_at timestamp"


@dataclass
class Config:
    """Settings of a YAML file; a missing or unreadable file gives the defaults."""

    models: dict[str, str] = field(default_factory=dict)
    strong_score: float = 0.85
    strong_gap: float = 0.15
    proxy: str | None = None

    @classmethod
    def read(cls, path: str | None = None) -> Config:
        import yaml

        try:
            with open(path or os.path.expanduser("~/.config/quarry.yml")) as f:
                raw = yaml.safe_load(f)
        except (OSError, yaml.YAMLError):
            return cls()
        raw = raw if isinstance(raw, dict) else {}
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


# Adding sources.


def source_row(spark: SparkSession, address: str, **flags) -> DataFrame:
    """One source row of an address: owner/repo, a repository url, or a web root.

    The ref is the flag's, else the url's, else the tag's; the label the flag's, else
    the ref's major. A web source is named by its host and allows its root path.
    """
    one = spark.createDataFrame([(address,)], "a string")
    short = F.regexp_extract("a", r"^([\w.-]+)/([\w.-]+)$", 0) != ""
    url = F.when(short, F.concat(F.lit("https://github.com/"), F.col("a"))).otherwise(F.col("a"))
    flag = lambda k, kind="string": F.lit(flags.get(k)).cast(kind)
    repo = urls.repo_parts(url)
    ref = F.coalesce(flag("ref"), F.col("r.ref"), flag("tag"))
    rows = one.select(url.alias("url"), repo.alias("r"))
    git = F.col("r").isNotNull()
    return rows.filter(git | F.col("url").rlike(r"(?i)^https?://")).select(
        F.when(git, "github").otherwise("web").alias("kind"),
        F.coalesce(flag("name"), F.when(git, F.concat_ws("/", "r.owner", "r.repo")).otherwise(urls.host(F.col("url")))).alias("name"),
        F.col("r.owner").alias("owner"), F.col("r.repo").alias("repo"), ref.alias("ref"),
        F.coalesce(urls.docs_path(flag("docs")), F.col("r.docs_path")).alias("docs_path"), F.coalesce(flag("mode"), F.lit("docs")).alias("ingest_mode"),
        F.coalesce(flag("label"), versions.major_label(ref)).alias("version_label"),
        F.when(~git, F.col("url")).alias("root_url"),
        F.when(~git, F.to_json(_csv(flag("allow"), urls.path(F.col("url"))))).alias("allowed_paths"), F.when(~git, F.to_json(_csv(flag("deny")))).alias("denied_paths"),
        F.coalesce(flag("depth", "int"), F.lit(3)).alias("max_depth"), F.coalesce(flag("pages", "int"), F.lit(500)).alias("max_pages"),
    )


def _csv(text: Column, default: Column | None = None) -> Column:
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda x: x != "")
    return items if default is None else F.when(F.size(items) > 0, items).otherwise(F.array(default))


def unsynced(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("last_sync_at").isNull())


def list_versions(source_versions: DataFrame, source_id: int) -> DataFrame:
    return source_versions.filter(F.col("source_id") == source_id).orderBy(F.desc("synced_at"), "version_label")


# Sync.


def sync_files(archives: DataFrame, doc_path: str | None = None, docs_only: bool = True, **filters) -> DataFrame:
    """Documents of archive members (archive, path, size, content): path, title, content, content_type, hash, reason.

    Members are filtered by path; with ``docs_only`` documentation files alone pass,
    and files without code fall out with a reason, before anything is stored.
    """
    from quarry.functions import text

    rows = archives if not doc_path else archives.filter(F.col("path").startswith(doc_path.strip("/") + "/"))
    rows = files.text_files(rows, **filters)
    reason = F.when(F.col("reason").isNotNull(), F.col("reason"))
    if docs_only:
        reason = reason.when(~text.is_doc(F.col("path")), "no_document")
    reason = reason.when(text.is_doc(F.col("path")) & ~text.has_code(F.col("content")), "no_code")
    kind = F.when(text.is_doc(F.col("path")), "text/markdown").otherwise("text/plain")
    title = F.coalesce(text.document_title(F.col("content")), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    return rows.select("path", title.alias("title"), "content", kind.alias("content_type"), "hash", reason.alias("reason"))


def tree_hash(rows: DataFrame, leaf_rows: int = 256) -> DataFrame:
    """(tree_hash) of a version's files (path, hash); one row.

    A hash tree over the files' digests: leaves are the digests that share their first
    hexadecimal digits, as many as leave some ``leaf_rows`` to a leaf, and each level
    above hashes sixteen nodes into one. So no row holds more than a leaf, however many
    files a version or a folder has, and the same files give the same hash in any order.
    """
    depth, count = 0, rows.count()
    while count > leaf_rows * 16**depth:
        depth += 1
    nodes = rows.select(F.sha2(F.concat_ws(" ", "path", "hash"), 256).alias("node")).withColumn("at", F.substring("node", 1, depth))
    listed = F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256)
    for level in range(depth, 0, -1):
        nodes = nodes.groupBy("at").agg(listed.alias("node"))
        nodes = nodes.select(F.concat_ws(" ", "at", "node").alias("node"), F.substring("at", 1, level - 1).alias("at"))
    return nodes.agg(listed.alias("tree_hash"))


def ingest_summary(changes: DataFrame, skipped: DataFrame) -> DataFrame:
    """(updated, unchanged, skipped) of a run."""
    done = changes.agg(F.count_if(F.col("change_type").isin("new", "changed")).alias("updated"), F.count_if(F.col("change_type") == "same").alias("unchanged"))
    return done.crossJoin(skipped.agg(F.count("*").alias("skipped")))  # one row each


# Library search.


def library_lookup(sources: DataFrame, source_versions: DataFrame, query: str, version: str | None = None) -> DataFrame:
    """Libraries for a query; a version nobody has is tried again as its series."""
    found = lookup.search_libraries(sources, source_versions, query, version)
    label = lookup.fallback_label(version) if version else None
    if label and found.isEmpty():
        return lookup.search_libraries(sources, source_versions, query, label)
    return found


def available_labels(source_versions: DataFrame, limit: int = 10) -> DataFrame:
    labels = source_versions.select(F.col("version_label").alias("label")).dropna().distinct()
    return labels.orderBy(*versions.label_order()).limit(limit)


def result_lines(rows: DataFrame) -> DataFrame:
    """(line) of results: confidence of two decimals, title, address, preview."""
    name = F.coalesce(F.col("title"), F.col("doc_title"), F.lit("untitled"))
    return rows.select(F.format_string("%.2f  %s  %s\n%s", "confidence", name, F.coalesce("doc_uri", "doc_path"), "preview").alias("line"))


# Seeds and legacy layout.


def seed_yaml(sources: DataFrame) -> str:
    """Sources as a YAML seed list, each key once, by name. The list of sources is small by its nature."""
    import yaml

    git = F.col("kind") == "github"
    url = F.when(git, F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo")).otherwise(F.col("root_url"))
    rows = sources.select(
        F.monotonically_increasing_id().alias("pos"), "name", F.col("kind").alias("type"), url.alias("url"), F.col("docs_path").alias("docs"), "ref",
        F.col("version_label").alias("version"), F.col("ingest_mode").alias("mode"), F.from_json("allowed_paths", "array<string>").alias("allow"),
        F.from_json("denied_paths", "array<string>").alias("deny"), F.col("max_depth").alias("depth"), F.col("max_pages").alias("pages"),
    )
    keys = sources.sparkSession.createDataFrame([], "key string")
    out = [{k: v for k, v in r.asDict().items() if v is not None and k not in ("pos", "key")} for r in files.new_seeds(rows, keys).orderBy("name").collect()]
    return yaml.safe_dump(out, sort_keys=False)


DOCUMENTS = "source_id bigint, path string, version_label string, uri string, title string, hash string, content_type string, active boolean"


def shaped(rows: DataFrame, kinds: str) -> DataFrame:
    """The columns of a schema; those that the rows lack are null."""
    want = [x.strip().split(" ", 1) for x in kinds.split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in want])


def import_legacy(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of the one-store layout (all sources in one table each) in the layout by source; missing columns are null, unused blobs are left out."""
    rows = shaped(tables["documents"], DOCUMENTS).withColumn("active", F.coalesce("active", F.lit(True)))
    out = {"documents": rows.withColumn("document_id", F.xxhash64("source_id", "path", "version_label"))}
    if "document_id" in tables["documents"].columns:  # chunks refer to the ids there are
        out["documents"] = shaped(tables["documents"], DOCUMENTS + ", document_id bigint").withColumn("active", F.coalesce("active", F.lit(True)))
    out["blobs"] = tables["blobs"].join(rows.select("hash").distinct(), "hash", "left_semi").select("hash", "content").dropDuplicates(["hash"])
    if "sources" in tables:
        out["sources"] = shaped(tables["sources"], SOURCES)
    if "source_versions" in tables:
        out["source_versions"] = shaped(tables["source_versions"], VERSIONS)
    if "chunks" in tables:
        out["chunks"] = tables["chunks"]
        if "vectors" in tables:
            out["vectors"] = tables["vectors"].join(tables["chunks"].select("chunk_id", "source_id"), "chunk_id")
    return out


def slug(source_id: int, name: str) -> str:
    """Folder name of a source."""
    import re

    return f"{re.sub(r'[^a-z0-9]+', '-', name.lower()).strip('-')}-{source_id}"

