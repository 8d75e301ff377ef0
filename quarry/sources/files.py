"""Archives, directories, seeds and discovery files as DataFrames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions import markdown, urls
from quarry.operators import closure
from quarry.plans.shared import shared_folder


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all files below a directory; paths are full."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.col("length").alias("size"), "content")


def read_archives(spark: SparkSession, pattern: str, max_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """(archive, path, size, content) of the members of zip files.

    The common top directory is cut off, names that leave the archive are cleaned,
    and archives over ``max_bytes`` are an error. Python, since nothing built in
    reads zip; one archive is one task's work.
    """
    import io
    import zipfile

    import pyarrow as pa

    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_buffer())) as z:
                    members = [m for m in z.infolist() if not m.is_dir()]
                    clean = ["/".join(p for p in m.filename.replace("\\", "/").split("/") if p not in ("", ".", "..")) for m in members]
                    tops = {c.split("/", 1)[0] for c in clean}
                    cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in c for c in clean) else 0
                    for m, name in zip(members, clean, strict=True):
                        body = z.read(m)
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name[cut:]]), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], schema=schema)

    files = spark.read.format("binaryFile").load(pattern)
    big = F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.raise_error(F.lit("archive is too large")).cast("binary"))
    return files.select("path", big.alias("content")).mapInArrow(run, "archive string, path string, size bigint, content binary")


def text_files(files: DataFrame, **options) -> DataFrame:
    """(path, size, reason, content, hash, lang): files with the reason they are skipped for; content only where they are not."""
    from quarry.functions.text import extension
    from quarry.operators.paths import skip_reason

    reason = skip_reason(F.col("path"), F.col("size"), **options)
    body = F.when(reason.isNull(), F.decode("content", "UTF-8"))
    return files.select("path", "size", reason.alias("reason"), body.alias("content"), F.sha2(body, 256).alias("hash"), F.nullif(extension(F.col("path")), F.lit("")).alias("lang"))


def commit_of(header: Column, top_dir: Column, url: Column, previous: Column) -> Column:
    """First commit hash among a header, the end of the top directory's name, the end of the url, and the one before."""
    sha = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    return F.coalesce(sha(header, r"^([0-9a-f]{7,40})$"), sha(top_dir, r"-([0-9a-f]{7,40})$"), sha(url, r"/([0-9a-f]{7,40})(?:\.zip)?$"), previous)


MAX_ARCHIVE = 500 * 1024 * 1024


def encoded(text: Column, keep: str = "") -> Column:
    """Percent-encoded, but for letters, digits, -_.!~*'() and the characters of ``keep``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for ch in "!~'()" + keep:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def archive_urls(sources: DataFrame) -> DataFrame:
    """(source_id, pos, url): where a repository archive (source_id, owner, repo, ref) may be, in the order to try."""
    repo = F.concat(encoded(F.col("owner")), F.lit("/"), encoded(F.col("repo")))
    api, web = F.concat(F.lit("https://api.github.com/repos/"), repo, F.lit("/zipball/")), F.concat(F.lit("https://github.com/"), repo, F.lit("/archive/"))
    ref, path = encoded(F.col("ref")), encoded(F.col("ref"), ";,/?:@&=+$#")
    head = F.array(F.concat(api, F.lit("HEAD")), F.concat(web, F.lit("HEAD.zip")))
    named = F.array(
        F.concat(api, ref), F.when(F.col("ref").rlike(r"(?i)\A[0-9a-f]{4,40}\z"), F.concat(web, ref, F.lit(".zip"))),
        F.concat(web, F.lit("refs/heads/"), path, F.lit(".zip")), F.concat(web, F.lit("refs/tags/"), path, F.lit(".zip")),
    )
    return sources.select("source_id", F.posexplode(F.when(F.coalesce("ref", F.lit("")) == "", head).otherwise(F.array_compact(named))).alias("pos", "url"))


def download_outcomes(responses: DataFrame, max_bytes: int = MAX_ARCHIVE) -> DataFrame:
    """Responses (source_id, pos, code, size, etag, sha, sent_etag, with_token) with their outcome, tag and error."""
    code = F.col("code")
    error = (
        F.when(code == 401, "token invalid or expired").when((code == 403) & F.col("with_token"), "access denied: the token lacks scope or hit a rate limit")
        .when(code == 403, "access denied or rate limited: a token may help").when(code == 404, "repository or reference not found")
        .when((code == 429) | code.between(500, 599), F.concat(code.cast("string"), F.lit(": may be tried again"))).when(~code.between(200, 299) & (code != 304), F.concat(F.lit("error "), code.cast("string")))
        .when(F.col("size") > max_bytes, F.concat(F.lit("archive of "), F.format_number(F.col("size") / 1048576, 1), F.lit(" MB exceeds the limit")))
    )
    outcome = F.when(code == 304, "not-modified").when(error.isNotNull(), "error").otherwise("ok")
    tag = F.when(code == 304, F.col("sent_etag")).otherwise(F.nullif(F.regexp_replace(F.btrim("etag"), "^W/", ""), F.lit("")))
    return responses.withColumns({"outcome": outcome, "tag": tag, "error": error})


def landed_archives(outcomes: DataFrame) -> DataFrame:
    """(source_id, pos, outcome, tag, sha, error) of each source: its first attempt without an error, else its last."""
    good = F.min(F.when(F.col("outcome") != "error", F.struct("pos", "outcome", "tag", "sha", "error"))).alias("good")
    last = F.max(F.struct("pos", "outcome", "tag", "sha", "error")).alias("last")
    return outcomes.groupBy("source_id").agg(good, last).select("source_id", F.coalesce("good", "last").alias("a")).select("source_id", "a.*")


def changed_archives(landing: DataFrame, synced: DataFrame) -> DataFrame:
    """Archives (source_id, etag, commit_sha, ...) whose tag or commit differs from the last sync's; weak tags compare as strong."""
    tag = lambda c: F.regexp_replace(c, r'^W/', "")
    s = synced.select("source_id", tag(F.col("etag")).alias("_etag"), F.col("commit_sha").alias("_sha"))
    both = landing.join(s, "source_id", "left")
    same = F.coalesce(tag(F.col("etag")) == F.col("_etag"), F.lit(False)) | F.coalesce(F.col("commit_sha") == F.col("_sha"), F.lit(False))
    return both.filter(~same).drop("_etag", "_sha")


# Discovery.


def manifest_links(manifests: DataFrame) -> DataFrame:
    """(source_id, pos, url) of llms.txt files (source_id, rank, content): the first of a source that lists anything."""
    lines = manifests.select("source_id", "rank", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "raw")).withColumn("line", F.btrim("raw"))
    item, bare = F.regexp_extract("line", r"^[-*]?\s*\[[^\]]*\]\((https?://[^)\s]+)\)", 1), F.regexp_extract("line", r"^(?:[-*]\s+)?(https?://\S+)$", 1)
    url = F.when(item != "", item).otherwise(bare)
    rows = lines.filter(~F.col("line").startswith("#") & ~F.col("line").startswith("|")).withColumn("url", url).filter((F.col("url") != "") & (F.length("url") <= urls.MAX_URL))
    first = rows.groupBy("source_id").agg(F.min("rank").alias("rank"))
    return rows.join(first, ["source_id", "rank"]).select("source_id", "pos", "url")


@F.pandas_udf(ArrayType(StringType()))
def manifest_targets(content: pd.Series, url: pd.Series) -> pd.Series:
    """Targets of the list items of an llms.txt page, absolute, in order: the item's link, or the item where it is one word."""
    out = []
    for text, base in zip(content, url, strict=True):
        found = []
        for line in map(str.strip, (text or "").splitlines()):
            if line.startswith("-") and "|" not in line:
                item = line[1:].strip()
                link = re.match(r"\[.*?\]\((https?://[^\s)]+)\)", item)
                if link or (item and not re.search(r"\s", item)):
                    found.append(link[1] if link else item)
        out.append(urls.absolute(base, found))
    return pd.Series(out)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(source_id, pos, url) of the sitemap lines of robots.txt files (source_id, root, content), made absolute."""
    lines = robots.select("source_id", "root", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "line"))
    found = F.btrim(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1))
    scheme, host = F.regexp_extract("root", r"^(https?):", 1), F.regexp_extract("root", r"^https?://([^/]+)", 1)
    url = (
        F.when(found.rlike(r"(?i)^https?://"), found).when(found.startswith("//"), F.concat(scheme, F.lit(":"), found))
        .when(found.startswith("/"), F.concat(scheme, F.lit("://"), host, found)).otherwise(F.concat(scheme, F.lit("://"), found))
    )
    return lines.filter(found != "").select("source_id", "pos", url.alias("url"))


def is_sitemap(xml: Column) -> Column:
    return xml.contains("<urlset") | xml.contains("<sitemapindex")


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(url, nested, pos, location) of sitemap files (url, content); nested ones are indexes of sitemaps."""
    found = F.regexp_extract_all("content", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    # The content ends here: a column of it beside the explode would be copied into every location's row.
    rows = sitemaps.filter(is_sitemap(F.col("content"))).select("url", F.col("content").contains("<sitemapindex").alias("nested"), found.alias("found"))
    rows = rows.select("url", "nested", F.posexplode_outer("found").alias("pos", "raw")).filter("raw is not null")
    return rows.select("url", "nested", "pos", markdown.decode_entities(F.col("raw")).alias("location"))


def read_sitemaps(start: DataFrame, content: DataFrame, depth: int | None = 3) -> DataFrame:
    """(url) of all pages that sitemaps (url) reach through indexes of at most ``depth`` levels; None: of any. ``content``: (url, content).

    Every file is read once, for its locations; which of them count is a walk over these.
    """
    shared_folder(content.sparkSession)
    found = sitemap_locations(content).checkpoint()
    links = found.filter("nested").select(F.col("url").alias("source"), F.col("location").alias("target"))
    known = closure.reached(start.select(F.col("url").alias("node")), links, depth)
    pages = found.filter(~F.col("nested")).join(known.select(F.col("node").alias("url")), "url", "left_semi")
    return pages.select(F.col("location").alias("url")).distinct()


def discovered(lists: DataFrame, root: str) -> DataFrame:
    """(url, pos) of listed urls (list, pos, url) on the root's host and under its path, the first of equals."""
    root_path = F.regexp_replace(urls.path(F.lit(root)), "/$", "")
    inside = (urls.host(F.col("url")) == urls.host(F.lit(root))) & urls.path(F.col("url")).startswith(root_path)
    return lists.filter(inside).groupBy("url").agg(F.min(F.struct("list", "pos")).alias("pos"))


# Seeds.


def seed_key(seeds: DataFrame) -> Column:
    """Key of a seed: repository and docs path, or the root address."""
    repo = urls.repo_parts(F.col("url"))
    git = F.concat_ws("|", F.lit("github"), F.lower(repo.owner), F.lower(repo.repo), F.coalesce(urls.docs_path(F.col("docs")), F.lit("")))
    return F.when(F.coalesce(F.col("type"), F.lit("")) == "web", F.concat_ws("|", F.lit("web"), urls.normalize(F.col("url")))).otherwise(git)


def new_seeds(seeds: DataFrame, existing_keys: DataFrame) -> DataFrame:
    """Valid seeds whose key is neither known (key) nor listed before. Seeds have a pos."""
    rows = seeds.withColumn("key", seed_key(seeds)).filter("name <> '' and url <> '' and key is not null")
    first = rows.groupBy("key").agg(F.min("pos").alias("pos"))
    return rows.join(first, ["key", "pos"], "left_semi").join(existing_keys, "key", "left_anti")


def read_seeds(spark: SparkSession, text: str) -> DataFrame:
    """Seed table of a YAML list."""
    import yaml

    entries = yaml.safe_load(text)
    if not isinstance(entries, list):
        raise ValueError("a seed file must hold a list")
    schema = "pos int, name string, type string, url string, docs string, ref string, version string, mode string, allow array<string>, deny array<string>, depth int, pages int"
    fields = [f.split()[0] for f in schema.split(", ")[1:]]
    return spark.createDataFrame([(k, *[e.get(f) for f in fields]) for k, e in enumerate(entries) if isinstance(e, dict)], schema)


def crawl_config(sources: DataFrame) -> DataFrame:
    """Sources with their crawl settings: defaults where nothing, or no readable list, is given."""
    listed = lambda c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))
    root = urls.path(F.col("root_url"))
    return sources.select(
        "*", F.when(F.size(listed("allowed_paths")) > 0, listed("allowed_paths")).otherwise(F.array(root)).alias("allow"), listed("denied_paths").alias("deny"),
        F.coalesce("max_depth", F.lit(3)).alias("depth"), F.coalesce("max_pages", F.lit(500)).alias("pages"), F.lit(200).alias("min_body"),
    )


def refs_listed(refs: DataFrame, pattern: str | None = None, limit: int = 20) -> DataFrame:
    """(name, kind, more): refs (name, kind, pos, is_default), the default branch first; more: how many of all are not shown."""
    total = refs.count()
    shown = refs.filter(F.lower("name").contains(pattern.lower())) if pattern else refs
    return shown.orderBy(F.desc(F.coalesce("is_default", F.lit(False))), "pos").limit(limit).select("name", "kind", F.lit(max(0, total - limit)).alias("more"))
