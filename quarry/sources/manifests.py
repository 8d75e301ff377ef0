"""Dependencies that manifest files declare.

Line formats are read by one pass: lines are exploded, the section of a line is the
last header above it, and a table of patterns says what a line declares. JSON and
XML manifests have expressions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.versions import is_platform_package, suggested_label

#: File names that are read, and directories that are not entered (fixed values).
FILES = ["package.json", "composer.json", "pyproject.toml", "requirements.txt", "Pipfile", "go.mod", "Cargo.toml", "Gemfile", "pom.xml", "build.gradle", "build.gradle.kts"]
SKIPPED_DIRS = ["node_modules", "vendor", ".git", ".hg", ".svn", ".idea", ".vscode", ".cache", "dist", "build", ".next", ".svelte-kit", ".turbo", "coverage", "tmp"]
MAX_DEPTH = 6

NAME = r"([A-Za-z0-9_.-]+)"
#: file, section (null: any), pattern with the groups name and version, default version. What a line must look like to count is part of the results, so the patterns are fixed values.
LINE_RULES = [
    ("pyproject.toml", "tool.poetry.dependencies", rf'^(?!python\s*=){NAME}\s*=\s*"([^"]+)"', None),
    ("Pipfile", "packages", rf'^{NAME}\s*=\s*"([^"]+)"', None),
    ("requirements.txt", None, rf"^(?!-r|--){NAME}(?:==|>=|<=|~=|>|<)?\s*([^\s;]+)?", "*"),
    ("Cargo.toml", "dependencies", rf'^{NAME}\s*=\s*"([^"]+)"', None),
    ("Cargo.toml", "dependencies", rf'^{NAME}\s*=\s*\{{(?:[^}}]*?version\s*=\s*"([^"]+)")?', "*"),
    ("Gemfile", None, r'^gem\s+"([A-Za-z0-9_.-]+)"\s*(?:,\s*"([^"]+)")?', "*"),
    ("go.mod", "require", r"^(\S+)\s+(\S+)", None),
    ("go.mod", None, r"^require\s+([^(\s]\S*)\s+(\S+)", None),
    ("build.gradle", None, r"""(?:^|\s)(?:implementation|api)\s+['"]([^:'"]+:[^:'"]+):([^'"]+)['"]""", None),
    ("build.gradle.kts", None, r"""(?:^|\s)(?:implementation|api)\s+['"]([^:'"]+:[^:'"]+):([^'"]+)['"]""", None),
]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_manifest(path: Column) -> Column:
    """A manifest within the depth limit, outside hidden and skipped directories; ``path`` is relative."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return base_name(path).isin(FILES) & (F.size(dirs) <= MAX_DEPTH) & ~F.exists(dirs, lambda x: x.startswith(".") | x.isin(SKIPPED_DIRS))


def _json(files: DataFrame) -> DataFrame:
    deps = F.from_json("content", "dependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>, require map<string,string>")
    rows = files.filter(base_name(F.col("path")).isin("package.json", "composer.json")).select("path", base_name(F.col("path")).alias("file"), deps.alias("d"))
    none = F.create_map().cast("map<string,string>")
    entries = lambda c: F.map_entries(F.coalesce(F.col(f"d.{c}"), none))
    listed = F.when(F.col("file") == "composer.json", entries("require")).otherwise(F.concat(entries("dependencies"), entries("optionalDependencies"), entries("peerDependencies")))
    rows = rows.select("path", F.posexplode(listed).alias("pos", "e"))
    return rows.select("path", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def _pom(files: DataFrame) -> DataFrame:
    # the patterns of blocks and tags are fixed values: what counts is part of the results
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    rows = files.filter(base_name(F.col("path")) == "pom.xml").select("path", F.posexplode(blocks).alias("pos", "b"))
    tag = lambda t: F.btrim(F.regexp_extract("b", rf"<{t}>\s*([^<]+)\s*</{t}>", 1), F.lit(" \t\n\r"))
    rows = rows.filter((tag("scope") != "test") & (tag("groupId") != "") & (tag("artifactId") != ""))
    return rows.select("path", "pos", F.concat(tag("groupId"), F.lit(":"), tag("artifactId")).alias("name"), F.coalesce(F.nullif(tag("version"), F.lit("")), F.lit("*")).alias("version"))


def _lines(files: DataFrame) -> DataFrame:
    rows = files.filter(base_name(F.col("path")).isin([r[0] for r in LINE_RULES]))
    rows = rows.select("path", base_name(F.col("path")).alias("file"), F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "raw"))
    line = F.btrim(F.col("raw"), F.lit(" \t"))
    header = F.regexp_extract(line, r"^\[(.+)\]$", 1)
    mark = F.when(header != "", header).when((F.col("file") == "go.mod") & line.startswith("require ("), "require").when((F.col("file") == "go.mod") & (line == ")"), "")
    above = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("path", "file", "pos", line.alias("line"), mark.alias("mark")).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(above), F.lit("")))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("//") & F.col("mark").isNull())
    found = F.lit(None).cast("struct<name:string,version:string>")
    for file, section, pattern, default in LINE_RULES:
        hit = (F.col("file") == file) & F.col("line").rlike(pattern) & (F.col("section") == section if section else ~((F.col("file") == "go.mod") & (F.col("section") == "require")))
        version = F.coalesce(F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")), F.lit(default))
        found = F.coalesce(found, F.when(hit, F.struct(F.regexp_extract("line", pattern, 1).alias("name"), version.alias("version"))))
    listed = F.when(
        (F.col("file") == "pyproject.toml") & (F.col("section") == "project") & F.col("line").rlike(r"^dependencies\s*=\s*\[(.*)\]\s*$"),
        F.transform(F.split(F.regexp_extract("line", r"^dependencies\s*=\s*\[(.*)\]\s*$", 1), ","), lambda x: F.regexp_replace(F.btrim(x), r'^"|"$', "")),
    ).otherwise(F.array().cast("array<string>"))
    items = F.transform(F.filter(listed, lambda x: x != ""), lambda x: F.struct(F.split(x, r"\s+")[0].alias("name"), F.coalesce(F.nullif(F.btrim(F.regexp_replace(x, r"^\S+", "")), F.lit("")), F.lit("*")).alias("version")))
    rows = rows.select("path", "pos", F.explode(F.when(found.isNotNull(), F.array(found)).otherwise(items)).alias("e"))
    return rows.select("path", "pos", "e.name", "e.version")


def dependencies(files: DataFrame) -> DataFrame:
    """(manifest, name, version) of manifest files (path, content); of a name listed twice the last one counts."""
    files = files.filter(is_manifest(F.col("path")))
    rows = _json(files).unionByName(_pom(files)).unionByName(_lines(files)).filter("name <> '' and version <> ''")
    return rows.groupBy(F.col("path").alias("manifest"), "name").agg(F.max_by("version", "pos").alias("version"))


def detected(files: DataFrame) -> DataFrame:
    """Dependencies without platform packages, with a suggested version label."""
    return dependencies(files).filter(~is_platform_package(F.col("name"))).withColumn("label", suggested_label(F.col("version")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Manifest files (path relative to ``root``, content) below a directory."""
    rows = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root).select(F.expr("_metadata.file_path").alias("p"), F.col("value").alias("content"))
    prefix = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return rows.select(F.regexp_replace(F.substring_index("p", prefix + "/", -1), "^/+", "").alias("path"), "content").filter(is_manifest(F.col("path")))
