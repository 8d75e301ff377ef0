"""Versioned document store as snapshot tables: upsert, soft delete, chunk replacement, garbage collection.

Every operation takes snapshots and gives the next one; keys are joined, nothing is
collected. Keys of a document: (source_id, path, version_label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "path", "version_label"]


def new_blobs(incoming: DataFrame, blobs: DataFrame) -> DataFrame:
    """(hash, content) that the blob table lacks, each hash once."""
    fresh = incoming.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    return fresh.join(blobs.select("hash"), "hash", "left_anti")


def to_land(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """(KEY, hash, document_id, uri, title, fresh, holds) of the documents whose content a commit needs: ``fresh`` ones are cut into chunks, and one that ``holds`` brings a hash that the blob table lacks. No content is read."""
    came = documents.filter(F.col("change_type") != "kept")
    known = came.join(blobs.select("hash", F.lit(True).alias("_stored")), "hash", "left")
    first = F.row_number().over(Window.partitionBy("hash").orderBy(*KEY)) == 1
    rows = known.select(*KEY, "hash", "document_id", "uri", "title", F.col("change_type").isin("new", "changed").alias("fresh"), (F.col("_stored").isNull() & first).alias("holds"))
    return rows.filter("fresh or holds")


def insert_blobs(blobs: DataFrame, incoming: DataFrame) -> DataFrame:
    return blobs.select("hash", "content").unionByName(new_blobs(incoming, blobs))


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next snapshot with change_type: new, same, changed, or kept where nothing came in.

    Same content refreshes title and uri and re-activates; other content also takes
    the hash. Columns: KEY, document_id, uri, title, hash, content_type, active.
    Document ids are hashes of the key, so replays give the same ids.
    """
    fields = ["uri", "title", "hash", "content_type"]
    i = incoming.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in fields])
    both = current.select(*KEY, "document_id", *fields, "active").join(i, KEY, "full_outer")
    came, was = F.col("new_hash").isNotNull(), F.col("hash").isNotNull()
    change = F.when(came & ~was, "new").when(came & (F.col("new_hash") == F.col("hash")), "same").when(came, "changed").otherwise("kept")
    kind = F.when(came & (change != "same"), F.col("new_content_type")).otherwise(F.col("content_type"))
    return both.select(
        *KEY,
        F.coalesce("document_id", F.xxhash64(*KEY)).alias("document_id"),
        F.coalesce("new_uri", "uri").alias("uri"),
        F.coalesce("new_title", "title").alias("title"),
        F.coalesce("new_hash", "hash").alias("hash"),
        kind.alias("content_type"),
        (came | F.coalesce("active", F.lit(False))).alias("active"),
        change.alias("change_type"),
    )


def deactivate_missing(documents: DataFrame, source_id: int, version: str, keep: DataFrame) -> DataFrame:
    """Documents of a source and version whose path is not in ``keep`` (path) become inactive; an empty keep list means all."""
    scope = (F.col("source_id") == source_id) & F.col("version_label").eqNullSafe(version)
    marked = documents.join(keep.select("path", F.lit(True).alias("_kept")).distinct(), "path", "left")
    active = F.when(scope & F.col("_kept").isNull(), F.lit(False)).otherwise(F.col("active"))
    return marked.withColumn("active", active).select(*documents.columns)


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of documents that come in again are replaced as a whole."""
    return chunks.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def keep_latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of every key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_vectors(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors by (chunk_id, model); fresh ones win. A dimension other than the table's is an error, nothing is dropped."""
    return vectors.join(fresh.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").unionByName(fresh)


def check_dimensions(vectors: DataFrame, dims: int) -> DataFrame:
    ok = F.size("embedding") == dims
    return vectors.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors of another dimension"))))


def update_token_counts(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    joined = chunks.join(counts.select("chunk_id", F.col("token_count").alias("_t")), "chunk_id", "left")
    return joined.withColumn("token_count", F.coalesce("_t", "token_count")).select(*chunks.columns)


def collect_garbage(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, blobs: DataFrame) -> dict[str, DataFrame]:
    """Snapshots without inactive documents, their chunks and vectors, and blobs no document needs."""
    live = documents.filter("active")
    kept = chunks.join(live.select("document_id"), "document_id", "left_semi")
    return {
        "documents": live,
        "chunks": kept,
        "vectors": vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi"),
        "blobs": blobs.join(live.select("hash"), "hash", "left_semi"),
    }


def garbage_counts(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, blobs: DataFrame) -> DataFrame:
    """(documents, chunks, vectors, blobs) that ``collect_garbage`` removes; one row."""
    dead = documents.filter(~F.col("active"))
    lost = chunks.join(dead.select("document_id"), "document_id", "left_semi")
    live = documents.filter("active").select("hash")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    gone = [one(dead, "documents"), one(lost, "chunks"), one(vectors.join(lost.select("chunk_id"), "chunk_id", "left_semi"), "vectors"), one(blobs.join(live, "hash", "left_anti"), "blobs")]
    out = gone[0]
    for df in gone[1:]:
        out = out.crossJoin(df)  # four rows of one column each
    return out


def record_version(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Source versions by (source_id, version_label); a null commit or tree hash keeps the one before."""
    old = versions.select("source_id", "version_label", *[F.col(c).alias(f"old_{c}") for c in ("ref", "commit_sha", "tree_hash", "etag", "synced_at")])
    both = old.join(fresh, ["source_id", "version_label"], "full_outer")
    return both.select("source_id", "version_label", *[F.coalesce(c, f"old_{c}").alias(c) for c in ("ref", "commit_sha", "tree_hash", "etag", "synced_at")])


def record_sync(sources: DataFrame, sync: DataFrame) -> DataFrame:
    """Sync columns of sources; nulls keep the value before, but an error is cleared by a run without one."""
    s = sync.select("id", F.lit(True).alias("_ran"), *[F.col(c).alias(f"new_{c}") for c in ("last_sync_at", "last_commit", "last_etag", "last_error")])
    both = sources.join(s, "id", "left")
    for c in ("last_sync_at", "last_commit", "last_etag"):
        both = both.withColumn(c, F.coalesce(f"new_{c}", c))
    return both.withColumn("last_error", F.when(F.col("_ran"), F.col("new_last_error")).otherwise(F.col("last_error"))).select(*sources.columns)


def add_source(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """New sources with default depth 3 and 500 pages, and ids after the greatest."""
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    n = F.row_number().over(Window.orderBy("name", "kind"))
    rows = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + n)  # one row on the right
    rows = rows.withColumn("max_depth", F.coalesce("max_depth", F.lit(3))).withColumn("max_pages", F.coalesce("max_pages", F.lit(500)))
    return sources.unionByName(rows.drop("_top"), allowMissingColumns=True)


def remove_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """All tables without a source's rows."""
    return {name: df.filter(F.col("id" if name == "sources" else "source_id") != source_id) for name, df in tables.items()}


def store_counts(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_id, documents, chunks, embedded): one grouped pass for each table, joined by source."""
    d = documents.filter("active").groupBy("source_id").agg(F.count("*").alias("documents"))
    c = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    e = vectors.select("chunk_id").distinct().join(chunks.select("chunk_id", "source_id"), "chunk_id").groupBy("source_id").agg(F.count("*").alias("embedded"))
    out = d.join(c, "source_id", "full_outer").join(e, "source_id", "full_outer")
    return out.select("source_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("documents", "chunks", "embedded")])
