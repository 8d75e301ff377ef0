"""The engine: search in three modes, document and library lookup, status, cleanup, ingest of documents.

A search is one lazy plan: keyword lists, vector lists and alternates are unioned,
fused and boosted; only the rows of the lists (20 each) meet in the fusion.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import chunking, lookup, prefixes, search, store
from quarry.plans import services
from quarry.plans.shared import scratch, shared_folder, small_steps, written
from quarry.sources import manifests, pages

#: Rows a list holds, rows returned, and weights of lists (fixed values).
CANDIDATES, RESULTS = 20, 8
KEYWORD_WEIGHT, RELAXED_WEIGHT, VECTOR_WEIGHT = 2.0, 1.2, 2.0
ALT_KEYWORD_WEIGHT, ALT_RELAXED_WEIGHT, ALT_VECTOR_WEIGHT = 1.0, 0.7, 1.0
MODES = {"hybrid": "hybrid", "mix": "hybrid", "combined": "hybrid", "word": "word", "fts": "word", "bm25": "word", "vector": "vector", "vec": "vector", "meaning": "vector"}


@dataclass
class Library:
    """Tables of a collection: chunks (chunk_id, document_id, source_id, texts), documents, vectors, and the text index."""

    chunks: DataFrame
    documents: DataFrame
    index: search.TextIndex
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    strong_score: float = search.STRONG_SCORE
    strong_gap: float = search.STRONG_GAP
    probes: dict[str, list[float]] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        return self.chunks.join(self.documents.select("document_id", "active", "version_label"), "document_id")

    def probe(self, text: str) -> list[float]:
        """The vector of a query; a text is embedded once."""
        prompt = search.query_prompt(search.normalize_query(text))
        if prompt not in self.probes:
            self.probes[prompt] = list(self.embed(prompt))
        return self.probes[prompt]


def keyword_list(lib: Library, query: str, number: int, weights: tuple[float, float], version: str | None) -> DataFrame:
    """A ranked list of an alternate query; the relaxed rows where there are no strict ones."""
    found = search.keyword_search(lib.index, lib.rows(), query, CANDIDATES, version)
    order = [F.col("bm25"), F.col("chunk_id")]
    rank = F.row_number().over(Window.orderBy(*order))  # a list of at most CANDIDATES rows
    weight = F.when(F.col("used_relaxed"), weights[1]).otherwise(weights[0])
    return found.select(F.lit(number).alias("list_idx"), weight.alias("weight"), rank.alias("rank"), "chunk_id")


def vector_list(lib: Library, text: str, number: int, weight: float, version: str | None) -> DataFrame:
    keep = search.active(lib.rows(), version)
    near = search.knn(lib.vectors, lib.probe(text), CANDIDATES, keep)
    return search.ranked_list(near, [F.col("distance"), F.col("chunk_id")], number, weight)


def first_list(lib: Library, query: str, version: str | None) -> tuple[DataFrame, bool, bool]:
    """(the query's own keyword rows, whether they are relaxed, whether the first stands out); at most CANDIDATES rows, kept by the checkpoint."""
    strict = search.strict_search(lib.index, lib.rows(), query, CANDIDATES, version).select("chunk_id", "bm25", "score", "used_relaxed").checkpoint()
    top = strict.orderBy("bm25", "chunk_id").limit(1).collect()
    if top or not search.search_terms(query):
        return strict, False, bool(top) and search.strong_signal(strict, lib.strong_score, lib.strong_gap).first().strong
    relaxed = search.relaxed_search(lib.index, lib.rows(), query, CANDIDATES, version)
    return relaxed.select("chunk_id", "bm25", "score", "used_relaxed"), True, False


def hybrid_search(lib: Library, query: str, alternates: list[str] | Callable[[str], list[str]] | None = None, version: str | None = None) -> DataFrame:
    """Fused keyword and vector results with boosts and confidence, best first.

    ``alternates`` (or what it returns for the query) are searched too, unless the
    first row of the strict keyword list stands out.
    """
    own, loose, strong = first_list(lib, query, version)
    lists = [search.ranked_list(own, [F.col("bm25"), F.col("chunk_id")], 0, RELAXED_WEIGHT if loose else KEYWORD_WEIGHT)]
    vectors = lib.vectors is not None and lib.embed is not None
    if vectors:
        lists.append(vector_list(lib, query, 1, VECTOR_WEIGHT, version))
    more = [] if strong else alternates(query) if callable(alternates) else alternates or []
    for k, text in enumerate(search.clean_expansions(more, query)):
        lists.append(keyword_list(lib, text, 2 + 2 * k, (ALT_KEYWORD_WEIGHT, ALT_RELAXED_WEIGHT), version))
        if vectors:
            lists.append(vector_list(lib, text, 3 + 2 * k, ALT_VECTOR_WEIGHT, version))
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    rows = F.broadcast(search.fuse(every, RESULTS)).join(lib.rows(), "chunk_id")
    return search.with_confidence(search.boosted(rows, search.search_terms(query)))


def word_search(lib: Library, query: str, version: str | None = None) -> DataFrame:
    return search.with_confidence(search.strict_search(lib.index, lib.rows(), query, RESULTS, version))


def vector_search(lib: Library, query: str, version: str | None = None) -> DataFrame:
    if lib.vectors is None or lib.embed is None:
        raise ValueError("vectors are not ready")
    near = search.knn(lib.vectors, lib.probe(query), RESULTS, search.active(lib.rows(), version))
    return search.with_confidence(near.join(lib.rows(), "chunk_id"))


def run_search(lib: Library, query: str, mode: str = "hybrid", **options) -> DataFrame:
    kind = MODES.get(mode.strip().lower())
    if not query.strip():
        raise ValueError("the query is empty")
    if kind is None:
        raise ValueError(f"unknown search mode: {mode}")
    return {"hybrid": hybrid_search, "word": word_search, "vector": vector_search}[kind](lib, query, **options)


def result_items(rows: DataFrame) -> DataFrame:
    """(json) of results, with slice label and confidence of two decimals."""
    label = search.slice_label(F.col("line_start"), F.col("line_end"))
    item = F.struct("document_id", "chunk_id", "title", F.col("doc_path").alias("path"), F.col("doc_uri").alias("uri"), "preview", label.alias("slice"), F.round("confidence", 2).alias("confidence"))
    return rows.select(F.to_json(item).alias("json"))


class Engine:
    """A store under a folder, read through the session.

    A table is a set of parquet folders by part (the source, or all). A commit writes
    folders for the parts that change, new ones beside the old or instead of them, and
    then one file that lists the folders of every table: readers see whole snapshots,
    and of two writers with the same number the second fails.

    The text index is stored: postings are appended, sorted by term, so that a query
    reads the pages of its terms; lengths are kept by source. Chunks are appended as
    well: a row counts if lengths list its chunk with no later commit than its folder's.
    """

    TABLES = {
        "documents": "source_id bigint, path string, version_label string, document_id bigint, uri string, title string, hash string, content_type string, active boolean",
        "blobs": "hash string, content string",
        "chunks": f"{chunking.SCHEMA}, chunk_id bigint, source_id bigint, doc_path string, doc_uri string, doc_title string",
        "vectors": "source_id bigint, chunk_id bigint, model string, embedding array<float>",
        "postings": "source_id bigint, chunk_id bigint, gen bigint, term string, tf double",
        "lengths": "source_id bigint, chunk_id bigint, gen bigint, n bigint",
        "sources": services.SOURCES,
        "source_versions": services.VERSIONS,
    }
    #: Tables that are not kept by source.
    WHOLE = {"blobs", "sources", "source_versions"}
    #: Folders of postings, and of chunks, a source may have before they are merged.
    SEGMENTS = 8
    #: What chunks take over from their document, by its columns.
    NAMES = {"source_id": "source_id", "doc_path": "path", "doc_uri": "uri", "doc_title": "title"}

    def __init__(self, spark: SparkSession, root: str, config: services.Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or services.Config()
        shared_folder(spark)

    def _state(self) -> tuple[int, dict[str, dict[str, list[str]]]]:
        """(number of the last commit, folders by table and part)."""
        with contextlib.suppress(AnalysisException):
            last = self.spark.read.text(f"{self.root}/_commits").orderBy(F.desc("n")).limit(1).collect()
            if last:
                return int(last[0].n), json.loads(last[0].value)
        return 0, {}

    def table(self, name: str, source_id: int | None = None) -> DataFrame:
        """A table of the last commit, or its part of one source."""
        parts = {part: own for part, own in self._state()[1].get(name, {}).items() if source_id is None or name in self.WHOLE or part == str(source_id)}
        folders = [f for own in parts.values() for f in own]
        if not folders:
            return self.spark.createDataFrame([], self.TABLES[name])
        rows = self._read(name, *folders)
        if name != "chunks" or all(len(own) == 1 for own in parts.values()):
            return rows
        live = self.table("lengths", source_id).select("source_id", "chunk_id", "gen")
        rows = rows.withColumn("_n", F.regexp_extract("_metadata.file_path", r".*/v=(\d+)/part=", 1).cast("long"))
        return rows.join(live.withColumnRenamed("gen", "_gen"), ["source_id", "chunk_id"]).filter("_gen <= _n").select(*rows.drop("_n").columns)

    def _read(self, name: str, *folders: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def _write(self, name: str, part: str, rows: DataFrame) -> str:
        """The folder of a part's rows for the next commit."""
        folder = f"{name}/v={self._state()[0] + 1}/part={part}"
        columns = self.spark.createDataFrame([], self.TABLES[name]).columns
        kind = search.STORED_AS if name == "postings" else {}
        rows.select(*columns).write.mode("overwrite").options(compression="zstd", **kind).parquet(f"{self.root}/{folder}")
        return folder

    def _commit(self, changes: dict[tuple[str, str], DataFrame | str], added: frozenset[str] | set[str] = frozenset()) -> None:
        """Writes the changed (table, part)s, unless they are folders already; tables ``added`` to keep their folders, others are replaced. Empty results leave no folder."""
        n, state = self._state()
        for (name, part), rows in changes.items():
            folder = rows if isinstance(rows, str) else self._write(name, part, rows)
            own = state.setdefault(name, {})
            own[part] = [*(own.get(part, []) if name in added else []), folder]
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("error").text(f"{self.root}/_commits/n={n + 1}")

    def _parts(self, name: str, rows: DataFrame) -> dict[tuple[str, str], DataFrame]:
        """A table by its parts; sources that it no longer holds get empty ones."""
        if name in self.WHOLE:
            return {(name, "all"): rows}
        return {(name, part): rows.filter(F.col("source_id") == int(part)) for part in self._state()[1].get(name, {})}

    def ingest(self, incoming: DataFrame, source_id: int, version: str, prefix: list[str], complete: bool = True, latest: str = "hash") -> None:
        """Upserts (path, uri, title, content, content_type) of a source version; ``complete``: other paths become inactive.

        Of several rows of a path the one with the greatest ``latest`` counts.
        """
        with small_steps(self.spark), scratch(self.spark) as folder:
            self._ingest(incoming, source_id, version, prefix, complete, latest, folder)
        if len(self._state()[1]["postings"][str(source_id)]) > self.SEGMENTS:
            self.merge_postings(source_id)

    def _ingest(self, incoming: DataFrame, source_id: int, version: str, prefix: list[str], complete: bool, latest: str, scratch_: str) -> None:
        """Keys and hashes decide what is new; only then do contents move, once, and what is made of them is read from the folder of the step before."""
        gen, part = self._state()[0] + 1, str(source_id)
        rows = incoming.withColumns({"source_id": F.lit(source_id).cast("long"), "version_label": F.lit(version), "hash": F.sha2("content", 256)})
        names = written(store.keep_latest(rows.drop("content"), store.KEY, latest).select(*store.KEY, "uri", "title", "hash", "content_type"), "names", scratch_)
        documents = written(store.upsert_documents(self.table("documents", source_id), names), "documents", scratch_)
        wanted = store.to_land(documents, self.table("blobs"))
        landed = rows.select(*store.KEY, "hash", "content").join(wanted, [*store.KEY, "hash"]).dropDuplicates([*store.KEY, "hash"])
        landed = written(landed, "landed", scratch_)
        code = chunking.holds_code(documents.filter(F.col("change_type").isin("new", "changed")))
        fresh = landed.filter("fresh").withColumns({"prefix": F.array(*[F.lit(p) for p in prefix]), **{c: F.col(own) for c, own in self.NAMES.items()}})
        folder = self._write("chunks", part, chunking.with_chunk_ids(chunking.chunk_documents(fresh, *self.NAMES, code=code)))
        made = self._read("chunks", folder)
        replaced = documents.filter(F.col("change_type").isin("new", "changed")).select("document_id")
        old = self.table("chunks", source_id).join(replaced, "document_id", "left_semi").select("chunk_id")
        plain = documents.drop("change_type")
        if complete:
            plain = store.deactivate_missing(plain, source_id, version, names.select("path"))
        own_gen = F.lit(gen).cast("long").alias("gen")
        lengths = search.row_lengths(indexed_texts(made))
        postings = search.by_term_within(search.row_postings(indexed_texts(made)).drop("source_id"))
        changes = {
            ("documents", part): plain,
            ("chunks", part): folder,
            ("lengths", part): self.table("lengths", source_id).join(old, "chunk_id", "left_anti").unionByName(lengths.select("source_id", "chunk_id", own_gen, "n")),
            ("blobs", "all"): landed.filter("holds"),
            ("postings", part): postings.select(F.lit(source_id).cast("long").alias("source_id"), "chunk_id", own_gen, "term", "tf"),
        }
        if self._state()[1].get("vectors", {}).get(part):
            changes["vectors", part] = self.table("vectors", source_id).join(old, "chunk_id", "left_anti")
        self._commit(changes, {"blobs", "chunks", "postings"})

    def merge_postings(self, source_id: int) -> None:
        """One sorted folder of a source's postings, and one of its chunks, without those of replaced rows."""
        live = self.table("lengths", source_id).select("source_id", "chunk_id", "gen")
        rows = self.table("postings", source_id).join(live, ["source_id", "chunk_id", "gen"], "left_semi")
        self._commit({("postings", str(source_id)): search.by_term(rows), ("chunks", str(source_id)): self.table("chunks", source_id)})

    def embed(self, model: str, embed: Callable, source_id: int | None = None, force: bool = False, most_tokens: int = 2048, count_tokens: Callable | None = None) -> None:
        """Vectors for active chunks without one (``force``: for all of them), of one source or all.

        ``embed`` is a pandas UDF from text to array<float>; contents are cut to
        ``most_tokens`` (approximate) tokens. The first vector's dimension, or that of
        the stored ones, is required of all. ``count_tokens`` (Column to Column) gives
        token counts that replace the approximate ones of the embedded chunks.
        """
        changes: dict[tuple[str, str], DataFrame] = {}
        for part in [p for p in self._state()[1].get("chunks", {}) if source_id is None or p == str(source_id)]:
            own = int(part)
            chunks = self.table("chunks", own).join(self.table("documents", own).select("document_id", "active"), "document_id")
            vectors = self.table("vectors", own)
            todo = search.needs_embedding(chunks, vectors.limit(0) if force else vectors, model)
            prompt = search.document_prompt(F.col("doc_title"), text.clamp(F.col("content"), 4 * most_tokens))
            fresh = todo.select("source_id", "chunk_id", F.lit(model).alias("model"), embed(prompt).cast("array<float>").alias("embedding")).checkpoint()
            known = self.table("vectors").unionByName(fresh).filter(F.col("model") == model).select(F.size("embedding").alias("d")).limit(1).collect()
            if not known:
                continue
            changes["vectors", part] = store.upsert_vectors(vectors, store.check_dimensions(fresh, known[0].d))
            if count_tokens is not None:
                counts = todo.select("chunk_id", count_tokens(F.col("content")).cast("int").alias("token_count"))
                changes["chunks", part] = store.update_token_counts(self.table("chunks", own), counts)
        if changes:
            self._commit(changes)

    def library(self, source_id: int | None = None, embed: Callable[[str], list[float]] | None = None) -> Library:
        chunks, lengths = self.table("chunks", source_id), self.table("lengths", source_id)
        index = search.TextIndex(self.table("postings", source_id), lengths, search.statistics(lengths))
        vectors = self.table("vectors", source_id).drop("source_id")
        return Library(chunks.withColumn("path", F.col("doc_path")), self.table("documents", source_id), index, vectors, embed, self.config.strong_score, self.config.strong_gap)

    def search(self, query: str, mode: str = "hybrid", source_id: int | None = None, embed: Callable | None = None, **options) -> DataFrame:
        return run_search(self.library(source_id, embed), query, mode, **options)

    def get(self, key: str | int, slice_: str | None = None, version: str | None = None, library: str | None = None) -> DataFrame:
        """A document by id, path or uri: of the library named, else of the one its address lies in, else of any.

        A library that is not found, or is one of several, is an error.
        """
        sources = self.table("sources")
        source_id = None
        if library is not None:
            found = lookup.resolve_library(sources, library).select("id", "name").orderBy("name").limit(6).collect()
            if len(found) != 1:
                raise ValueError(f"no library {library}" if not found else f"several libraries {library}: {', '.join(r.name for r in found)}")
            source_id = found[0].id
        elif isinstance(key, str):
            near = lookup.infer_library(sources, key).select("id").limit(1).collect()
            source_id = near[0].id if near else None
        documents, blobs = self.table("documents", source_id), self.table("blobs")
        found = lookup.by_id(documents, blobs, key) if isinstance(key, int) else lookup.by_path_or_uri(documents, blobs, key, version)
        return lookup.sliced(found, slice_)

    def locate(self, addresses: DataFrame, address: str = "address") -> DataFrame:
        """(address, root, id, n_matches): the source that each of many addresses lies in."""
        return prefixes.infer_libraries(addresses, self.table("sources"), address)

    def status(self) -> DataFrame:
        return store.store_counts(self.table("documents"), self.table("chunks"), self.table("vectors"))

    def cleanup(self) -> DataFrame:
        """Removes inactive documents and what hangs on them; returns the counts."""
        tables = {k: self.table(k) for k in ("documents", "chunks", "vectors", "blobs")}
        counts = store.garbage_counts(**tables).checkpoint()
        kept = {k: v.checkpoint() for k, v in store.collect_garbage(**tables).items()}
        kept["lengths"] = self.table("lengths").join(kept["chunks"].select("chunk_id"), "chunk_id", "left_semi")
        self._commit({k: v for name, rows in kept.items() for k, v in self._parts(name, rows).items()})
        return counts

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last ``keep`` commits lists; returns how many."""
        n, _ = self._state()
        lists = self.spark.read.text(f"{self.root}/_commits").filter(F.col("n") > n - max(1, keep)).collect()
        used = {f for row in lists for parts in json.loads(row.value).values() for own in parts.values() for f in own}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for name in self.TABLES:
            for status in fs.globStatus(path(f"{self.root}/{name}/v=*/part=*")) or []:
                folder = "/".join(str(status.getPath().toString()).rstrip("/").split("/")[-3:])
                if folder not in used:
                    gone += bool(fs.delete(status.getPath(), True))
        return gone

    def add_source(self, address: str, **flags) -> int:
        """Adds a repository (owner/repo or url) or a web root and returns its id; flags: ref, tag, label, docs, mode, name, allow, deny, depth, pages."""
        row = services.source_row(self.spark, address, **flags)
        if row.isEmpty():
            raise ValueError(f"no repository or web address: {address}")
        added = store.add_source(self.table("sources"), row).select(*self.table("sources").columns).checkpoint()
        self._commit({("sources", "all"): added})
        return added.agg(F.max("id")).first()[0]

    def remove_source(self, source_id: int) -> None:
        """All of a source goes; blobs stay until the next cleanup."""
        _, state = self._state()
        changes = {("sources", "all"): self.table("sources").filter(F.col("id") != source_id), ("source_versions", "all"): self.table("source_versions").filter(F.col("source_id") != source_id)}
        for name in set(self.TABLES) - self.WHOLE:
            if str(source_id) in state.get(name, {}):
                changes[name, str(source_id)] = self.table(name, source_id).limit(0)
        self._commit(changes)

    def record_sync(self, versions: DataFrame, sync: DataFrame) -> None:
        """Version rows and sync columns after a run."""
        self._commit({("source_versions", "all"): store.record_version(self.table("source_versions"), versions), ("sources", "all"): store.record_sync(self.table("sources"), sync)})

    def sync_archive(self, source_id: int, members: DataFrame, version: str, commit: str, etag: str | None = None, ref: str | None = None, **filters) -> DataFrame:
        """A repository archive into the store: compare, filter, load, tree hash, version record; returns (updated, unchanged, skipped).

        ``members``: (archive, path, size, content). A commit that is recorded already
        changes nothing. A failure is recorded with the source and raised.
        """
        now = F.current_timestamp()
        versions = self.table("source_versions").filter((F.col("source_id") == source_id) & (F.col("version_label") == version))
        if versions.filter(F.col("commit_sha") == commit).limit(1).collect():
            return self.spark.createDataFrame([(0, self.table("documents", source_id).filter("active").count(), 0)], "updated bigint, unchanged bigint, skipped bigint")
        source = self.table("sources").filter(F.col("id") == source_id).limit(1).collect()
        if not source:
            raise ValueError(f"no source {source_id}")
        own, key = source[0], self.spark.range(1)
        name = f"{own.owner}/{own.repo}"
        sync = key.select(F.lit(source_id).cast("long").alias("id"), now.alias("last_sync_at"), F.lit(commit).alias("last_commit"), F.lit(etag).cast("string").alias("last_etag"), F.lit(None).cast("string").alias("last_error"))
        try:
            files_ = services.sync_files(members, own.docs_path, (own.ingest_mode or "docs") == "docs", **filters).checkpoint()
            good = files_.filter("reason is null").withColumn("uri", text.repo_uri(F.lit(own.owner), F.lit(own.repo), F.lit(ref or own.ref or commit), F.col("path")))
            before = self.table("documents", source_id).select("path", "version_label", "hash", "active").checkpoint()
            tree = services.tree_hash(good)
            self.ingest(good.select("path", "uri", "title", "content", "content_type"), source_id, version, repository_prefix(name, version))
            fresh = tree.select(F.lit(source_id).cast("long").alias("source_id"), F.lit(version).alias("version_label"), F.lit(ref or own.ref).cast("string").alias("ref"), F.lit(commit).alias("commit_sha"), "tree_hash", F.lit(etag).cast("string").alias("etag"), now.alias("synced_at"))
            self.record_sync(fresh, sync)
        except Exception as error:
            self.record_sync(versions.limit(0), sync.withColumn("last_error", F.lit(str(error)[:500])).withColumn("last_commit", F.lit(None).cast("string")).withColumn("last_etag", F.lit(None).cast("string")))
            raise
        was = before.filter(F.col("version_label") == version).select("path", F.col("hash").alias("old"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "same").otherwise("changed").alias("change_type")
        return services.ingest_summary(good.join(was, "path", "left").select(change), files_.filter("reason is not null"))

    def ingest_pages(self, pages_: DataFrame, source_id: int, version: str = "latest", min_body: int = 200, need_code: bool = True) -> DataFrame:
        """Fetched pages (page_id, url, html, and markdown or null) of a web source into the store; returns (page_id, url, reason).

        A page with a markdown body of its own takes that; others are extracted. Pages
        out of scope, too small or without code get a reason and are left out.
        """
        source = self.table("sources").filter(F.col("id") == source_id).limit(1).collect()
        if not source:
            raise ValueError(f"no source {source_id}")
        scope = {"allowed": json.loads(source[0].allowed_paths or "[]"), "denied": json.loads(source[0].denied_paths or "[]")}
        read = pages.page_documents(pages.read_pages(pages_), source[0].root_url, min_body, need_code, **scope).checkpoint()
        good = read.filter("reason is null").select("path", "uri", "title", "content", F.lit("text/markdown").alias("content_type"))
        self.ingest(good, source_id, version, [(urlsplit(source[0].root_url or "").hostname or source[0].name)])
        return read.select("page_id", "url", "reason")

    def import_legacy(self, tables: dict[str, DataFrame]) -> None:
        """Tables of the one-store layout (documents, blobs, and optionally chunks, vectors, sources, source_versions) into this empty store.

        Chunks need a source_id; postings are made of them. All is one commit, so a
        failure leaves the store as it was.
        """
        if self._state()[0]:
            raise ValueError("the store is not empty")
        found = services.import_legacy(tables)
        if "chunks" in found:
            index = search.build_index(indexed_texts(found["chunks"]))
            gen = F.lit(1).cast("long").alias("gen")
            found["postings"] = index.postings.select("source_id", "chunk_id", gen, "term", "tf")
            found["lengths"] = index.lengths.select("source_id", "chunk_id", gen, "n")
        changes: dict[tuple[str, str], DataFrame] = {}
        for name, rows in found.items():
            if name in self.WHOLE:
                changes[name, "all"] = rows
                continue
            for row in rows.select("source_id").distinct().orderBy("source_id").collect():  # sources are few
                own = rows.filter(F.col("source_id") == row.source_id)
                changes[name, str(row.source_id)] = search.by_term(own) if name == "postings" else own
        self._commit(changes)

    def clear_embeddings(self) -> None:
        """No vectors; only the list of folders is written."""
        self._commit({("vectors", part): self.table("vectors").limit(0) for part in self._state()[1].get("vectors", {})})

    def libraries(self, query: str, version: str | None = None) -> DataFrame:
        return services.library_lookup(self.table("sources"), self.table("source_versions"), query, version)

    def detect(self, root: str) -> DataFrame:
        """Dependencies of a project's manifests with suggested version labels."""
        return manifests.detected(manifests.scan(self.spark, root))

    def reset(self) -> None:
        """An empty snapshot after the current one; ``vacuum`` deletes what came before."""
        self._commit({(name, part): self.table(name).limit(0) for name, parts in self._state()[1].items() for part in parts})


def repository_prefix(name: str, version: str | None) -> list[str]:
    """Breadcrumb of a repository's documents: its name, and its version unless that is the head."""
    return [name, *([version] if version and version != "HEAD" else [])]


def indexed_texts(chunks: DataFrame) -> DataFrame:
    """The weighted text columns of chunks."""
    return chunks.select("source_id", "chunk_id", "content", F.col("doc_title").alias("title"), F.col("doc_path").alias("path"), "context_path", F.col("doc_uri").alias("uri"))
