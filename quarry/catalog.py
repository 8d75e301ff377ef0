"""Registered queries of the engine, by name, with DuckDB SQL where SQL can express them.

``documents`` stands for chunks (content: text, title: source), ``pages`` for
fetched pages, ``embeddings`` for vectors. Inputs of other kinds (paths, tags,
manifests, sitemaps) are made of the keys and names of the tables, one or more a row,
so that each kind occurs at every scale; the SQL says what has to come out.
"""

from __future__ import annotations

import dataclasses
import dataclasses
import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import markdown, text, urls, versions
from quarry.operators import chunking, containment, frontier, lookup, paths, prefixes, search, store, symbols, tree
from quarry.plans import engine, services, shared
from quarry.sources import files, manifests, pages
from quarry.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_case(key: str, cases: list[str]) -> str:
    """SQL, the same in both engines: one of the expressions by the remainder of a key."""
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


# Full-text search.

FIELDS = {"content": 10.0, "title": 5.0}
AND_WORDS, ANY_WORDS = ["that", "hain", "the"], ["thanedb", "erin", "queelle"]


def document_chunks(spark: SparkSession, sf_dir: str, per_source: bool = False) -> DataFrame:
    source = F.xxhash64("source") if per_source else F.lit(1).cast("long")
    return table(spark, sf_dir, "documents").select(source.alias("source_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("title"))


def _bm25_sql(condition: list[str], match_all: bool) -> str:
    phrases = " UNION ALL ".join(f"SELECT {k} AS phrase, chunk_id, tf FROM postings WHERE {c}" for k, c in enumerate(condition))
    return f"""
WITH words AS (
    SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS term, 10.0::DOUBLE AS w FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')), 5.0::DOUBLE FROM documents
), postings AS (SELECT chunk_id, term, sum(w) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT d.doc_id AS chunk_id, count(w.term) AS n FROM documents d LEFT JOIN words w ON w.chunk_id = d.doc_id GROUP BY d.doc_id),
stats AS (SELECT count(*) AS n_rows, avg(n) AS avg_len FROM lengths),
hits AS (SELECT phrase, chunk_id, sum(tf) AS f FROM ({phrases}) GROUP BY ALL),
freq AS (SELECT phrase, CASE WHEN ln((n_rows - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n_rows - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf
         FROM hits, stats GROUP BY phrase, n_rows),
scored AS (SELECT chunk_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avg_len))) AS bm25, count(*) AS matched
           FROM hits JOIN freq USING (phrase) JOIN lengths USING (chunk_id), stats GROUP BY chunk_id)
SELECT chunk_id, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS score FROM scored {f"WHERE matched = {len(condition)}" if match_all else ""} ORDER BY scored.bm25, chunk_id LIMIT 8
"""


def _top8(found: DataFrame) -> DataFrame:
    top = found.orderBy("bm25", "chunk_id").limit(8)
    return top.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.round(search.reader_score(F.col("bm25")), 6).alias("score"))


@query(_bm25_sql([f"term = '{w}'" for w in AND_WORDS], True))
def bm25_word_top8(spark, sf_dir):
    index = search.build_index(document_chunks(spark, sf_dir), FIELDS, stemmed=False)
    return _top8(search.bm25(index, AND_WORDS))


@query(_bm25_sql([f"starts_with(term, '{w}')" for w in ANY_WORDS], False))
def bm25_relaxed_prefix(spark, sf_dir):
    index = search.build_index(document_chunks(spark, sf_dir), FIELDS, stemmed=False)
    return _top8(search.bm25(index, ANY_WORDS, prefix=True, match_all=False))


def _library(spark, sf_dir, vectors: bool = False) -> engine.Library:
    """Documents as chunks and as documents of their own, every third inactive, with an index of plain words."""
    docs = table(spark, sf_dir, "documents")
    chunks = document_chunks(spark, sf_dir)
    rows = chunks.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("path"), F.lit("").alias("context_path"), F.substring("text", 1, 220).alias("preview")), "chunk_id")
    documents = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 3 != 0).alias("active"), F.col("lang").alias("version_label"))
    index = dataclasses.replace(search.build_index(chunks, FIELDS, stemmed=False), digits=6)
    embeddings = _vectors(spark, sf_dir).drop("label") if vectors else None
    probe = (lambda text: _probe(spark, sf_dir, 1)) if vectors else None
    shared.shared_folder(spark)
    return engine.Library(rows, documents, index, embeddings, probe)


def _live(sql: str, condition: str = "TRUE") -> str:
    """The best rows of a BM25 query among active documents, 20 of them."""
    best = sql.rstrip().removesuffix("ORDER BY scored.bm25, chunk_id LIMIT 8")
    return f"SELECT chunk_id, bm25, score FROM ({best}) WHERE chunk_id % 3 <> 0 AND {condition} ORDER BY bm25, chunk_id LIMIT 20"


STRICT_SQL = _live(_bm25_sql([f"term = '{w}'" for w in AND_WORDS], True))
RELAXED_QUERY = "how to use the Thanedb; erin or queelle?"
RELAXED_SQL = _live(_bm25_sql([f"starts_with(term, '{w}')" for w in ("use", "thanedb", "erin", "queelle")], False))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query(STRICT_SQL)
def keyword_search_strict(spark, sf_dir):
    lib = _library(spark, sf_dir)
    return _found(search.keyword_search(lib.index, lib.rows(), " ".join(AND_WORDS)))


@query(RELAXED_SQL)
def keyword_search_relaxed(spark, sf_dir):
    lib = _library(spark, sf_dir)
    return _found(search.keyword_search(lib.index, lib.rows(), RELAXED_QUERY))


@query(_live(_bm25_sql([f"term = '{w}'" for w in AND_WORDS], True), "chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')").replace("LIMIT 20", "LIMIT 8"))
def engine_search_word(spark, sf_dir):
    return _found(engine.run_search(_library(spark, sf_dir), " ".join(AND_WORDS), "word", version="en"))


@query(f"""
WITH near AS (SELECT vec_id, list_cosine_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS d FROM embeddings e ORDER BY d, vec_id LIMIT 8)
SELECT vec_id AS chunk_id, round(1 / (1 + d), 6) AS score FROM near WHERE vec_id % 3 <> 0 AND vec_id IN (SELECT doc_id FROM documents)
""")
def engine_search_vector(spark, sf_dir):
    return engine.run_search(_library(spark, sf_dir, True), "anything", "meaning").select("chunk_id", F.round("score", 6).alias("score"))


HYBRID_TERMS = ["use", "thanedb", "erin", "queelle"]
HYBRID_SQL = f"""
WITH words AS ({RELAXED_SQL}), near AS (
    SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY d, vec_id) AS r
    FROM (SELECT vec_id, list_cosine_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS d FROM embeddings e ORDER BY d, vec_id LIMIT 20) WHERE vec_id % 3 <> 0 AND vec_id IN (SELECT doc_id FROM documents)
), lists AS (SELECT 0 AS list_idx, 1.2::DOUBLE AS weight, row_number() OVER (ORDER BY bm25, chunk_id) AS rank, chunk_id FROM words UNION ALL SELECT 1, 2.0, r, chunk_id FROM near),
sums AS (SELECT chunk_id, sum(weight / (60 + rank)) AS base, min(rank) AS best, min(list_idx * 1000 + rank) AS first FROM lists GROUP BY chunk_id),
fused AS (SELECT chunk_id, base + CASE WHEN best = 1 THEN 0.05::DOUBLE WHEN best <= 3 THEN 0.02::DOUBLE ELSE 0 END AS score, first FROM sums ORDER BY score DESC, first LIMIT 8)
SELECT chunk_id, round(f.score + least(0.08, {" + ".join(f"CASE WHEN contains(lower(d.source), '{t}') THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN contains(lower(d.lang), '{t}') THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN contains(lower(left(d.text, 220)), '{t}') THEN 0.005::DOUBLE ELSE 0 END" for t in HYBRID_TERMS)}), 6) AS score
FROM fused f JOIN documents d ON d.doc_id = f.chunk_id
"""


@query(HYBRID_SQL)
def engine_search_hybrid(spark, sf_dir):
    """No row holds all words, so the relaxed list of its search terms and the vector list are fused and boosted."""
    return engine.run_search(_library(spark, sf_dir, True), RELAXED_QUERY, "hybrid").select("chunk_id", F.round("score", 6).alias("score"))


def _stored(spark, sf_dir, stemmed: bool) -> search.TextIndex:
    """The index of the documents, written once a session and table folder."""
    name = hashlib.sha1(f"{spark.sparkContext.applicationId} {sf_dir} {stemmed}".encode()).hexdigest()[:16]
    folder = f"{shared.shared_folder(spark)}/quarry-index-{name}"
    try:
        return search.read_index(spark, folder, stemmed)
    except AnalysisException:
        search.write_index(search.build_index(document_chunks(spark, sf_dir), FIELDS, stemmed), folder)
        return search.read_index(spark, folder, stemmed)


@query(_bm25_sql([f"term = '{w}'" for w in AND_WORDS], True))
def stored_index_word_top8(spark, sf_dir):
    return _top8(search.bm25(_stored(spark, sf_dir, False), AND_WORDS))


@query(_bm25_sql([f"starts_with(term, '{w}')" for w in ANY_WORDS], False))
def stored_index_relaxed_prefix(spark, sf_dir):
    return _top8(search.bm25(_stored(spark, sf_dir, False), ANY_WORDS, prefix=True, match_all=False))


@query()
def bm25_stemmed_top8(spark, sf_dir):
    index = search.build_index(document_chunks(spark, sf_dir), FIELDS)
    return _top8(search.bm25(index, ["relationing", "that"], match_all=False))


@query("""
WITH words AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS term FROM documents)
SELECT source, term, count(*) AS df FROM words GROUP BY ALL
""")
def term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return search.term_statistics(docs, "content").withColumnRenamed("source_id", "source")


@query("""
SELECT source, count(*) AS n_rows, round(avg(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+'))), 6) AS avg_len FROM documents GROUP BY source
""")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    stats = search.build_index(docs, {"content": 1.0}, stemmed=False).stats
    return stats.select(F.col("source_id").alias("source"), "n_rows", F.round("avg_len", 6).alias("avg_len"))


# Vectors and fusion.


def _probe(spark, sf_dir, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


DISTANCE_SQL = "list_cosine_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}))"


@query(f"""
SELECT vec_id AS chunk_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score
FROM (SELECT vec_id, {DISTANCE_SQL.format(0)} AS d FROM embeddings e) ORDER BY d, vec_id LIMIT 20
""")
def knn_cosine_top20(spark, sf_dir):
    near = search.knn(_vectors(spark, sf_dir), _probe(spark, sf_dir, 0), 20)
    return near.select("chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""
SELECT vec_id AS chunk_id, round(d, 6) AS distance
FROM (SELECT vec_id, label, {DISTANCE_SQL.format(0)} AS d FROM embeddings e ORDER BY d, vec_id LIMIT 20) WHERE label < 5
""")
def knn_post_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.knn(v, _probe(spark, sf_dir, 0), 20, v.filter("label < 5")).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(f"""
SELECT vec_id AS chunk_id, round(d, 6) AS distance
FROM (SELECT vec_id, label, {DISTANCE_SQL.format(0)} AS d FROM embeddings e WHERE label < 5 ORDER BY d, vec_id LIMIT 20)
""")
def knn_prefilter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.knn(v, _probe(spark, sf_dir, 0), 20, v.filter("label < 5"), prefilter=True).select("chunk_id", F.round("distance", 6).alias("distance"))


def _lists(spark, sf_dir) -> DataFrame:
    out = None
    for k, weight in ((0, 2.0), (1, 1.0), (2, 0.7)):
        near = search.knn(_vectors(spark, sf_dir), _probe(spark, sf_dir, k), 20)
        own = search.ranked_list(near, [F.col("distance"), F.col("chunk_id")], k, weight)
        out = own if out is None else out.unionByName(own)
    return out


LISTS_SQL = " UNION ALL ".join(
    f"SELECT {k} AS list_idx, {w} AS weight, row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id AS chunk_id FROM (SELECT vec_id, {DISTANCE_SQL.format(k)} AS d FROM embeddings e ORDER BY d, vec_id LIMIT 20)"
    for k, w in ((0, 2.0), (1, 1.0), (2, 0.7))
)
FUSED_SQL = f"""
WITH lists AS ({LISTS_SQL}),
sums AS (SELECT chunk_id, sum(weight::DOUBLE / (60 + rank)) AS base, min(rank) AS best, min(list_idx * 1000 + rank) AS first FROM lists GROUP BY chunk_id),
fused AS (SELECT chunk_id, base + CASE WHEN best = 1 THEN 0.05::DOUBLE WHEN best <= 3 THEN 0.02::DOUBLE ELSE 0 END AS score, best, first FROM sums ORDER BY score DESC, first LIMIT 8)
"""


@query(FUSED_SQL + "SELECT chunk_id, round(score, 6) AS score, best::INT AS best_rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return search.fuse(_lists(spark, sf_dir)).select("chunk_id", F.round("score", 6).alias("score"), "best_rank")


BOOST_TERMS = ["the", "que", "src1"]
BOOST_SQL = " + ".join(
    f"CASE WHEN contains(lower(d.source), '{t}') THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN contains(lower(d.lang), '{t}') THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN contains(lower(left(d.text, 220)), '{t}') THEN 0.005::DOUBLE ELSE 0 END"
    for t in BOOST_TERMS
)


def _boosted(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("path"), F.lit("").alias("context_path"), F.substring("text", 1, 220).alias("preview"))
    return search.boosted(F.broadcast(search.fuse(_lists(spark, sf_dir))).join(docs, "chunk_id"), BOOST_TERMS)


@query(FUSED_SQL + f"SELECT chunk_id, round(f.score + least(0.08, {BOOST_SQL}), 6) AS score FROM fused f JOIN documents d ON d.doc_id = f.chunk_id")
def rrf_keyword_boost(spark, sf_dir):
    return _boosted(spark, sf_dir).select("chunk_id", F.round("score", 6).alias("score"))


@query(FUSED_SQL + f""", b AS (SELECT chunk_id, f.score + least(0.08, {BOOST_SQL}) AS s FROM fused f JOIN documents d ON d.doc_id = f.chunk_id)
SELECT chunk_id, round(s / (SELECT max(s) FROM b), 6) AS confidence FROM b""")
def search_confidence(spark, sf_dir):
    return search.with_confidence(_boosted(spark, sf_dir)).select("chunk_id", F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id AS chunk_id, 'title: ' || coalesce(nullif(source, ''), 'none') || ' | text: ' || text AS prompt FROM documents")
def embedding_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), search.document_prompt(F.col("source"), F.col("text")).alias("prompt"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def needs_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(True).alias("active"))
    ledger = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"))
    return search.needs_embedding(docs, ledger, "m").select("chunk_id")


# Document store. Snapshots derive from documents: the first holds ids not divisible by 7, the second all but those divisible by 5, with other text where 11 divides.


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    base = docs.select(F.lit(1).cast("long").alias("source_id"), path.alias("path"), F.lit("1.x").alias("version_label"), "doc_id", F.col("source").alias("uri"), F.col("lang").alias("title"), "text", F.lit("text/markdown").alias("content_type"))
    old = base.filter("doc_id % 7 <> 0").select("source_id", "path", "version_label", F.col("doc_id").alias("document_id"), "uri", "title", F.sha2("text", 256).alias("hash"), "content_type", (F.col("doc_id") % 3 != 0).alias("active"))
    content = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = base.filter("doc_id % 5 <> 0").withColumn("content", content).withColumn("hash", F.sha2("content", 256))
    return old, new


UPSERT_SQL = """
WITH o AS (SELECT doc_id, sha256(text) AS hash, doc_id % 3 <> 0 AS active FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 5 <> 0),
u AS (SELECT 'docs/' || coalesce(n.doc_id, o.doc_id) || '.md' AS path, coalesce(n.hash, o.hash) AS hash, (n.hash IS NOT NULL OR coalesce(o.active, FALSE)) AS active,
      CASE WHEN n.hash IS NULL THEN 'kept' WHEN o.hash IS NULL THEN 'new' WHEN n.hash = o.hash THEN 'same' ELSE 'changed' END AS change_type, n.hash IS NOT NULL AS came
      FROM o FULL JOIN n USING (doc_id))
"""


@query(UPSERT_SQL + "SELECT path, hash, active, change_type FROM u")
def upsert_change_type(spark, sf_dir):
    return store.upsert_documents(*_snapshots(spark, sf_dir)).select("path", "hash", "active", "change_type")


@query(UPSERT_SQL + "SELECT path, active AND came AS active FROM u")
def soft_delete_missing(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return store.deactivate_missing(store.upsert_documents(old, new), 1, "1.x", new.select("path")).select("path", "active")


@query("SELECT sha256(text) AS hash, min(length(text))::INT AS n FROM documents GROUP BY sha256(text)")
def doc_hash_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return store.new_blobs(docs, spark.createDataFrame([], "hash string")).select("hash", F.length("content").alias("n"))


@query(UPSERT_SQL + """, dead AS (SELECT count(*) AS documents FROM u WHERE NOT active),
b AS (SELECT DISTINCT hash FROM u), g AS (SELECT count(*) AS blobs FROM b WHERE hash NOT IN (SELECT hash FROM u WHERE active))
SELECT documents, documents AS chunks, documents AS vectors, blobs FROM dead, g""")
def gc_counts(spark, sf_dir):
    docs = store.upsert_documents(*_snapshots(spark, sf_dir))
    chunks = docs.select("document_id", F.col("document_id").alias("chunk_id"))
    return store.garbage_counts(docs, chunks, chunks.select("chunk_id"), docs.select("hash").distinct())


@query(UPSERT_SQL + "SELECT DISTINCT hash FROM u WHERE active")
def gc_live_blobs(spark, sf_dir):
    docs = store.upsert_documents(*_snapshots(spark, sf_dir))
    chunks = docs.select("document_id", F.col("document_id").alias("chunk_id"))
    return store.collect_garbage(docs, chunks, chunks.select("chunk_id"), docs.select("hash").distinct())["blobs"]


@query("""
SELECT d.source, count(*) AS documents, count(*) AS chunks, count(e.vec_id) AS embedded FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source
""")
def status_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"), F.lit(True).alias("active"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return store.store_counts(docs, docs, vectors).withColumnRenamed("source_id", "source")


@query("""
SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 50 ELSE n_chars END AS token_count FROM documents
""")
def token_count_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("token_count"))
    return store.update_token_counts(docs, docs.filter("chunk_id % 4 = 0").select("chunk_id", (F.col("chunk_id") % 50).alias("token_count")))


@query("""
WITH fresh AS (SELECT doc_id % 100 AS d, doc_id FROM documents WHERE doc_id % 100 % 3 = 0 AND doc_id % 2 = 0)
SELECT doc_id % 100 AS document_id, doc_id AS chunk_id, 'old' AS content FROM documents WHERE doc_id % 100 NOT IN (SELECT d FROM fresh) UNION ALL SELECT d, doc_id, 'new' FROM fresh
""")
def chunk_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("document_id"), F.col("doc_id").alias("chunk_id"))
    fresh = docs.filter("document_id % 3 = 0 and chunk_id % 2 = 0").withColumn("content", F.lit("new"))
    return store.replace_chunks(docs.withColumn("content", F.lit("old")), fresh)


@query("""
SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'b' ELSE 'a' END AS model, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE len(embedding) END::INT AS n FROM embeddings
""")
def vector_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 5 == 0, "b").otherwise("a").alias("model"), "embedding")
    fresh = rows.filter("chunk_id % 4 = 0").withColumn("embedding", F.slice("embedding", 1, 1))
    return store.upsert_vectors(rows, fresh).select("chunk_id", "model", F.size("embedding").alias("n"))


@query("""
SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN 'new' WHEN s_suppkey % 3 = 0 THEN 'new2' ELSE 'old' END AS commit_sha, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 't2' ELSE 't' END AS tree_hash FROM supplier
""".replace("'new2'", "'old'"))
def version_record(spark, sf_dir):
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.lit("1.x").alias("version_label"), F.lit("r").alias("ref"), F.lit("old").alias("commit_sha"), F.lit("t").alias("tree_hash"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("timestamp").alias("synced_at"))
    odd = F.col("source_id") % 2 == 1
    fresh = own.filter("source_id % 3 = 0").withColumn("commit_sha", F.when(odd, "new")).withColumn("tree_hash", F.when(~odd, "t2"))
    return store.record_version(own, fresh).select("source_id", "commit_sha", "tree_hash")


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'c2' ELSE 'c1' END ELSE 'c1' END AS last_commit, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'bad' END ELSE 'was' END AS last_error FROM supplier
""")
def sync_record(spark, sf_dir):
    no = F.lit(None).cast("string")
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("timestamp").alias("last_sync_at"), F.lit("c1").alias("last_commit"), no.alias("last_etag"), F.lit("was").alias("last_error"))
    good = F.col("id") % 4 == 0
    ran = own.filter("id % 2 = 0").withColumn("last_commit", F.when(good, "c2")).withColumn("last_error", F.when(~good, "bad"))
    return store.record_sync(own, ran).select("id", "last_commit", "last_error")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 1")
def unsynced_sources(spark, sf_dir):
    return services.unsynced(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 1, F.current_timestamp()).alias("last_sync_at"))).select("id")


@query("""
WITH old AS (SELECT s_suppkey AS id, s_name AS name, 7 AS max_depth, 70 AS max_pages FROM supplier WHERE s_suppkey % 2 = 0),
new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 9 ELSE 3 END AS max_depth, 500 AS max_pages FROM supplier WHERE s_suppkey % 2 = 1)
SELECT id::BIGINT AS id, name, max_depth, max_pages FROM old UNION ALL SELECT id::BIGINT, name, max_depth, max_pages FROM new
""")
def source_add(spark, sf_dir):
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier")
    old = own.filter("s_suppkey % 2 = 0").select(k.alias("id"), F.col("s_name").alias("name"), F.lit("web").alias("kind"), F.lit(7).alias("max_depth"), F.lit(70).alias("max_pages"))
    new = own.filter("s_suppkey % 2 = 1").select(F.col("s_name").alias("name"), F.lit("web").alias("kind"), F.when(k % 3 == 0, 9).alias("max_depth"), F.lit(None).cast("int").alias("max_pages"))
    return store.add_source(old, new).select("id", "name", "max_depth", "max_pages")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 1000000 + o_orderkey FROM orders WHERE o_custkey <> 3")
def source_remove(spark, sf_dir):
    tables = {"sources": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "source_versions": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), (1000000 + F.col("o_orderkey")).alias("id"))}
    kept = store.remove_source(tables, 3)
    return kept["sources"].unionByName(kept["source_versions"].select("id"))


@query("SELECT coalesce(d.source, '') AS source_id, count(*) AS n FROM documents d GROUP BY d.source ORDER BY n DESC, source_id LIMIT 5")
def largest_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"), F.lit(True).alias("active"))
    return store.store_counts(docs, docs, docs.limit(0)).orderBy(F.desc("documents"), "source_id").limit(5).select("source_id", F.col("documents").alias("n"))


@query("""
WITH h AS (SELECT sha256(CASE WHEN doc_id % 3 = 0 THEN 'docs/api/' WHEN doc_id % 3 = 1 THEN 'docs/' ELSE '' END || doc_id || '.md ' || sha256(text)) AS node FROM documents),
d AS (SELECT greatest(0, ceil(log2(count(*) / 256.0) / 4))::INT AS depth FROM h),
l5 AS (SELECT node[1:5] AS pre, node FROM h), l4 AS (SELECT pre[1:4] AS pre, pre || ' ' || sha256(string_agg(node, chr(10) ORDER BY node)) AS node FROM l5 WHERE (SELECT depth >= 5 FROM d) GROUP BY l5.pre UNION ALL SELECT pre[1:4], node FROM l5 WHERE (SELECT depth < 5 FROM d)),
l3 AS (SELECT pre[1:3] AS pre, pre || ' ' || sha256(string_agg(node, chr(10) ORDER BY node)) AS node FROM l4 WHERE (SELECT depth >= 4 FROM d) GROUP BY l4.pre UNION ALL SELECT pre[1:3], node FROM l4 WHERE (SELECT depth < 4 FROM d)),
l2 AS (SELECT pre[1:2] AS pre, pre || ' ' || sha256(string_agg(node, chr(10) ORDER BY node)) AS node FROM l3 WHERE (SELECT depth >= 3 FROM d) GROUP BY l3.pre UNION ALL SELECT pre[1:2], node FROM l3 WHERE (SELECT depth < 3 FROM d)),
l1 AS (SELECT pre[1:1] AS pre, pre || ' ' || sha256(string_agg(node, chr(10) ORDER BY node)) AS node FROM l2 WHERE (SELECT depth >= 2 FROM d) GROUP BY l2.pre UNION ALL SELECT pre[1:1], node FROM l2 WHERE (SELECT depth < 2 FROM d)),
l0 AS (SELECT pre || ' ' || sha256(string_agg(node, chr(10) ORDER BY node)) AS node FROM l1 WHERE (SELECT depth >= 1 FROM d) GROUP BY l1.pre UNION ALL SELECT node FROM l1 WHERE (SELECT depth < 1 FROM d))
SELECT sha256(string_agg(node, chr(10) ORDER BY node)) AS tree_hash FROM l0
""")
def tree_hash(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 3 == 0, "docs/api/").when(F.col("doc_id") % 3 == 1, "docs/").otherwise("")
    return services.tree_hash(table(spark, sf_dir, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash")))


@query("""
WITH one AS (SELECT doc_id, text FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE doc_id % 3 <> 0))
SELECT doc_id AS document_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS payload FROM one
""")
def document_get(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = docs.filter("doc_id % 3 <> 0").agg(F.max("doc_id")).first()[0]
    rows = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("u").alias("uri"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3 != 0).alias("active"), F.lit("1.x").alias("version_label"))
    blobs = docs.select(F.sha2("text", 256).alias("hash"), F.col("text").alias("content")).dropDuplicates(["hash"])
    return lookup.sliced(lookup.by_path_or_uri(rows, blobs, f"docs/{top}.md", "1.x"), "1:2").select("document_id", "payload")


# Text expressions.


@query("""
WITH p AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 220 THEN flat ELSE left(flat, 217) || '...' END AS preview, greatest(1, ceil(length(text) / 4))::INT AS tokens, sha256(text) AS hash FROM p
""")
def preview_tokens(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(c).alias("preview"), text.approx_tokens(c).alias("tokens"), text.content_hash(c).alias("hash"))


GATED = by_case("page_id", [
    "html", "concat(html, chr(10), '```', chr(10), 'x', chr(10), '```')", "concat('a `b` c', page_id)", "concat('x', chr(10), '    indented ', page_id)", "concat('<PRE >', page_id, '</PRE>')", "concat('~~~ open ', page_id)", "concat('---', chr(10), 'k: v', chr(10), '---', chr(10), 'body ', page_id)",
])


@query(f"""
SELECT page_id, page_id % 7 IN (1, 3, 4, 5) AS has_code, page_id % 7 IN (1, 2) AS has_snippets,
       CASE WHEN page_id % 7 = 6 THEN 4 + length(page_id::VARCHAR) ELSE length(regexp_replace({GATED}, '\\s+', '', 'g')) END AS n FROM pages
""")
def code_gate(spark, sf_dir):
    """Pages with fences, inline code, indented lines, tags, open fences and front matter."""
    c = F.col("body")
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(GATED).alias("body"))
    return rows.select("page_id", text.has_code(c).alias("has_code"), text.has_snippets(c).alias("has_snippets"), text.body_length(c).alias("n"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS payload FROM documents")
def line_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("payload"))


@query("""
SELECT p_partkey, concat_ws(' > ', p_brand, CASE WHEN trim(p_type) <> p_brand THEN trim(p_type) END, CASE WHEN trim(p_name) <> trim(p_type) THEN trim(p_name) END) AS crumb FROM part
""")
def breadcrumb(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.breadcrumb(F.array("p_brand", F.lit(" "), "p_type", F.lit(None).cast("string"), "p_name", "p_name")).alias("crumb"))


KIND_PATHS = by_case("doc_id", ["concat(source, '/', doc_id, '.ts')", "concat('docs/', doc_id, '.md')", "concat(source, '/Dockerfile')", "concat('m/', doc_id, '.PY')", "concat(source, '/Makefile')", "concat('a.b/', doc_id, '.tar.gz')"])


@query(f"""
SELECT doc_id, {KIND_PATHS} AS path, {by_case("doc_id", ["'ts'", "'md'", "'dockerfile'", "'py'", "''", "'gz'"])} AS ext,
       {by_case("doc_id", ["'typescript'", "'md'", "'dockerfile'", "'python'", "NULL", "'gz'"])} AS language, doc_id % 6 = 1 AS is_doc FROM documents
""")
def file_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(KIND_PATHS).alias("path"))
    return rows.select("doc_id", "path", text.extension(F.col("path")).alias("ext"), text.language(F.col("path")).alias("language"), text.is_doc(F.col("path")).alias("is_doc"))


SLICES = by_case("doc_id", ["'1:2'", "'2'", "'a:b'", "'3:1'", "'1:500'", "'99999:100000'", "'1:400'"])


@query(f"""
WITH d AS (SELECT doc_id, strlen(array_to_string((string_split(text, chr(10)))[1 : CASE WHEN doc_id % 7 = 6 THEN 400 ELSE 2 END], chr(10))) > 4096 AS long FROM documents)
SELECT doc_id, CASE WHEN long AND doc_id % 7 IN (0, 6) THEN 'slice holds too many bytes' ELSE {by_case("doc_id", ["''", "'slice must be start:end'", "'slice bounds must be numbers'", "'slice end lies before its start'", "'slice spans too many lines'", "'slice starts after the last line'", "''"])} END AS error,
       long FROM d
""")
def slice_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(SLICES).alias("spec"))
    cut = F.octet_length(text.line_slice(F.col("text"), F.lit(1), F.when(F.col("doc_id") % 7 == 6, 400).otherwise(2)))
    return rows.select("doc_id", F.coalesce(text.slice_error(F.col("text"), F.col("spec")), F.lit("")).alias("error"), (cut > 4096).alias("long"))


@query("""
SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE rtrim(left(p_name, 8)) END AS clamped, concat('```', CASE WHEN p_partkey % 2 = 0 THEN 'py' ELSE '' END, chr(10), p_name, chr(10), '```') AS fence,
       CASE WHEN p_partkey % 3 = 0 THEN p_name END AS title, concat('gh://', p_brand, '/r@', p_size, '/', p_name) AS repo_uri, concat('web://h/', p_name) AS web_uri FROM part
""")
def text_forms(spark, sf_dir):
    c, key = F.col("p_name"), F.col("p_partkey")
    content = F.when(key % 3 == 0, F.concat(F.lit("\n \n# "), c, F.lit("  \nmore"))).otherwise(F.concat(F.lit("words\n# "), c))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.clamp(c, 8).alias("clamped"), text.code_fence(F.concat(c, F.lit(" \n")), F.when(key % 2 == 0, "py")).alias("fence"), text.document_title(content).alias("title"),
        text.repo_uri(F.col("p_brand"), F.lit("r"), F.col("p_size").cast("string"), c).alias("repo_uri"), text.web_uri(F.lit("h"), F.concat(F.lit("/"), c)).alias("web_uri"),
    )


SNIFFED = by_case("doc_id", ["concat('# Head ', doc_id)", "concat('<!DOCTYPE html># no ', doc_id)", "concat('see [a](b) ', doc_id)", "concat('plain words ', doc_id)", "concat('x', chr(10), '- item ', doc_id)", "''"])


@query(f"SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS sniffed FROM documents")
def markdown_sniff(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_markdown(F.expr(SNIFFED)).alias("sniffed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN (doc_id % 9) || ':' || n_chars END AS label FROM documents WHERE doc_id % 9 > 0")
def slice_labels(spark, sf_dir):
    start = F.when(F.col("doc_id") % 2 == 1, (F.col("doc_id") % 9).cast("int"))
    return table(spark, sf_dir, "documents").filter("doc_id % 9 > 0").select("doc_id", search.slice_label(start, F.col("n_chars")).alias("label"))


ERRORS = by_case("doc_id", ["'HTTP 403 Forbidden'", "'Too Many Requests'", "'timeout'", "'HTTP 404'", "'document too small'", "'secondary rate limit hit'", "'gone 410'"])


@query("SELECT doc_id, doc_id % 7 IN (0, 1, 5) AS limited, doc_id % 7 IN (3, 4, 6) AS skippable, least(120.0::DOUBLE, 15 * pow(2, doc_id % 5))::DOUBLE AS wait FROM documents")
def fetch_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(ERRORS).alias("e"))
    return rows.select("doc_id", frontier.is_rate_limited(F.col("e")).alias("limited"), frontier.is_skippable(F.col("e")).alias("skippable"), frontier.backoff_seconds(F.col("doc_id") % 5).alias("wait"))


# Pages and URLs.

URL_SQL = "regexp_replace(lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '(?i)\\.md$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1), '/$', '')"


@query(f"SELECT page_id, {URL_SQL} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query("""
SELECT page_id, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(^|\\.)example\\.com$') AND regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '^/(en|fr)') AND NOT starts_with(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '/en/1') AS inside FROM pages
""")
def url_scope(spark, sf_dir):
    inside = urls.in_scope(F.col("url"), "https://example.com/", ["/en", "/fr"], ["/en/1"], subdomains=True)
    return table(spark, sf_dir, "pages").select("page_id", inside.alias("inside"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/', ''), '/$', '') AS p FROM pages)
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN p = '' THEN 'index' ELSE p END, '(?i)\\.html?$', ''), '(?i)\\.md$', '') || '.md' AS path FROM p
""")
def relative_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.relative_path(F.col("url")).alias("path"))


@query("""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS l FROM pages)
SELECT page_id, len(l) AS n, (SELECT min(root || x) FROM (SELECT unnest(l) AS x)) AS least FROM a
""")
def link_extract(spark, sf_dir):
    links = urls.html_links(F.col("html"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.array_min("l").alias("least"))


def _replace_each_sql(source: str, column: str, pattern: str, change) -> str:
    """A CTE body in which every match of a pattern is replaced by an expression of its first group."""
    p = pattern.replace("'", "''")
    return f"""SELECT page_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN i = 1 THEN o[1] ELSE {change("g[i - 1]", "h[i - 1]")} || o[i] END), '') AS {column}
    FROM (SELECT page_id, string_split_regex({column}, '{p}') AS o, regexp_extract_all({column}, '{p}', 1) AS g, regexp_extract_all({column}, '{p}', {2 if "href" in p else 1}) AS h FROM {source})"""


def _simple_markdown_sql() -> str:
    inner = lambda x: f"trim(regexp_replace({x}, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
    marked = lambda before, after: lambda g, h: f"'{before}' || {inner(g)} || '{after}'"
    steps = [(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", marked(f"\n{'#' * n} ", "\n")) for n in range(6, 0, -1)]
    steps += [(r"(?is)<p[^>]*>(.*?)</p>", marked("\n", "\n")), (r"(?is)<li[^>]*>(.*?)</li>", marked("- ", "\n")), (r"(?is)<code[^>]*>(.*?)</code>", marked("`", "`"))]
    steps.append((r'(?is)<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', lambda g, h: f"CASE WHEN {inner(h)} <> '' THEN '[' || {inner(h)} || '](' || {g} || ')' ELSE {g} END"))
    ctes = ["s0 AS (SELECT page_id, html AS t FROM pages)"] + [f"s{k + 1} AS ({_replace_each_sql(f's{k}', 't', p, c)})" for k, (p, c) in enumerate(steps)]
    plain = "regexp_replace(t, '<[^>]+>', '', 'g')"
    for entity, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        plain = f"replace({plain}, '{entity}', '{ch}')"
    plain = f"regexp_replace(replace(replace({plain}, chr(13), ''), chr(9), '  '), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"WITH {', '.join(ctes)} SELECT page_id, trim({plain}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) AS markdown FROM s{len(steps)}"


@query(_simple_markdown_sql())
def html_simple_markdown(spark, sf_dir):
    return markdown.simple_markdown(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "markdown").drop("html")


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') AS html FROM pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markdown.decode_entities(F.col("html")).alias("html"))


#: Markdown on which every cleaning step fires, and what it becomes; {i} is the id.
UNCLEAN = (
    "<a name='top'></a>Title {i}\n=====\n\n## Table of Contents\n- [One](#one)\n  - [Two](#two)\n\nText [link](http://x/{i}) ![img](i.png) a<wbr>b <a href='/p'>page</a>\n- [gone](#gone)\n\n\n\n"
    "Code `a\\_b` and c\\_d\n<style>p{}</style>end\nSub\n---\nItâs"
)
CLEAN = "# Title {i}\n\nText link (http://x/{i}) img ab page\n\nCode `a_b` and c\\_d\nend\n## Sub\nIt’s"


def _of_id(template: str, cast: str) -> str:
    return "replace('" + template.replace("'", "''") + f"', '{{i}}', CAST(doc_id AS {cast}))"


@query(f"SELECT doc_id, {_of_id(CLEAN, 'VARCHAR')} AS text FROM documents")
def sanitize_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.lit(UNCLEAN), F.lit("{i}"), F.col("doc_id").cast("string")).alias("text"))
    return rows.select("doc_id", markdown.sanitize(F.col("text")).alias("text"))


@query(f"""
WITH p AS (SELECT page_id, page_id % 18 AS m, CASE WHEN page_id % 19 = 5 THEN 'short' ELSE html END AS body, CASE WHEN page_id % 23 = 7 THEN 2 ELSE 9 END AS n FROM pages)
SELECT page_id, CASE WHEN length(regexp_replace(body, '\\s+', '', 'g')) < 400 THEN 'short body' WHEN n < 3 THEN 'few links'
       ELSE {by_case("page_id", [*["'mark: " + (next(x for x in markdown.SPA_MARKS if x in m)).replace("'", "''") + "'" for m in markdown.SPA_MARKS], "NULL"])} END AS reason FROM p
""")
def headless_decision(spark, sf_dir):
    """Pages with every mark of a scripted page, short ones, and ones with few links."""
    mark = F.lit("")
    for k, m in enumerate(markdown.SPA_MARKS):
        mark = F.when(F.col("page_id") % (len(markdown.SPA_MARKS) + 1) == k, F.lit(m.upper())).otherwise(mark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("html", mark).alias("html"), F.when(F.col("page_id") % 19 == 5, "short").otherwise(F.col("html")).alias("body"), F.when(F.col("page_id") % 23 == 7, 2).otherwise(9).alias("n"))
    return rows.select("page_id", markdown.needs_rendering(F.col("html"), F.col("body"), F.col("n")).alias("reason"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?s)<article><h1>([^<]*)</h1>', 1) AS head, string_split(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>')[2:] AS ps, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
b AS (SELECT *, list_transform(ps, lambda x: replace(replace(replace(x, '<br>', ''), '</p>', ''), '<b>', '')) AS plain, list_transform(ps, lambda x: starts_with(x, '<b>')) AS bold FROM p),
m AS (SELECT *, '# ' || trim(head) || list_reduce([''] || list_transform(range(1, len(plain) + 1), lambda k: CASE WHEN trim(plain[k]) = '' THEN '' WHEN bold[k] THEN chr(10) || chr(10) || '**' || trim(plain[k]) || '**' ELSE chr(10) || chr(10) || trim(plain[k]) END), lambda a, x: a || x) AS md FROM b),
d AS (SELECT page_id, url, regexp_replace(trim(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')), '(?s)^(.+?)( - | [|] | · | — ).*$', '\1') AS title, replace(replace(replace(replace(replace(md, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS markdown, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, hrefs FROM m)
SELECT page_id, url, trim(title) AS title, NULL::VARCHAR AS description, markdown, length(regexp_replace(markdown, '\s+', '', 'g')) < 400 AS is_sparse, len(list_distinct(hrefs))::INT AS n_links,
       (SELECT list(l ORDER BY k) FROM (SELECT l, min(k) AS k FROM (SELECT unnest(list_transform(hrefs, lambda h: site || replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'))) AS l, unnest(range(len(hrefs))) AS k) GROUP BY l)) AS links FROM d
""")
def page_extract(spark, sf_dir):
    return pages.extract_pages(table(spark, sf_dir, "pages"))


@query()
def page_documents(spark, sf_dir):
    return pages.page_documents(pages.extract_pages(table(spark, sf_dir, "pages")), "https://example.com/", need_code=False)


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)
SELECT page_id, root || '/a/' || page_id || ' https://o.org/x' AS links FROM p
""")
def markdown_link_targets(spark, sf_dir):
    body = F.concat(F.lit("[a](/a/"), F.col("page_id").cast("string"), F.lit(") [b](#top) ![i](https://o.org/x) [m](mailto:x@y) [again](/a/"), F.col("page_id").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.markdown_links(body, F.col("url")), " ").alias("links"))


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)
SELECT page_id, 'Guide ' || page_id AS title, 2 AS n_links, root || '/a' AS first FROM p
""")
def markdown_pages(spark, sf_dir):
    """Pages whose server sends markdown instead of html."""
    body = F.concat(F.lit("# Guide "), F.col("page_id").cast("string"), F.lit("\n\nSee [a](/a), [b](https://o.org/b) and [c](#top).\n\n```\nx\n```"))
    out = pages.read_pages(table(spark, sf_dir, "pages").withColumn("markdown", body))
    return out.select("page_id", "title", "n_links", F.get("links", F.lit(0)).alias("first"))


# Frontier.


def _frontier(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 5 == 0, "done").when(F.col("page_id") % 5 == 1, "failed").when(F.col("page_id") % 7 == 2, "skipped").otherwise("pending")
    return p.select(F.lit(1).cast("long").alias("source_id"), "url", urls.normalize(F.col("url")).alias("normalized_url"), (F.col("page_id") % 4).cast("int").alias("depth"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), (F.col("page_id") % 6).cast("int").alias("attempts"))


FRONTIER_SQL = f"WITH f AS (SELECT {URL_SQL} AS normalized_url, (page_id % 4)::INT AS depth, CASE WHEN page_id % 5 = 0 THEN 'done' WHEN page_id % 5 = 1 THEN 'failed' WHEN page_id % 7 = 2 THEN 'skipped' ELSE 'pending' END AS status, page_id % 6 AS attempts FROM pages) "


@query(FRONTIER_SQL + "SELECT count(*) AS total, " + ", ".join(f"sum((status = '{s}')::INT)::BIGINT AS {s}" for s in ("pending", "done", "failed", "skipped")) + " FROM f")
def frontier_counts(spark, sf_dir):
    return frontier.status_counts(_frontier(spark, sf_dir))


@query(FRONTIER_SQL + "SELECT normalized_url, depth FROM f WHERE status IN ('pending', 'failed') AND attempts < 3 ORDER BY depth, normalized_url LIMIT 50")
def frontier_batch(spark, sf_dir):
    return frontier.eligible(_frontier(spark, sf_dir), 50).select("normalized_url", "depth")


@query(FRONTIER_SQL + "SELECT DISTINCT normalized_url FROM f WHERE depth <> 0 AND normalized_url NOT IN (SELECT normalized_url FROM f WHERE depth = 0)")
def frontier_insert(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    known = f.filter("depth = 0")
    return frontier.insert_new(known, f.filter("depth <> 0").select("source_id", "url", "depth")).join(known, ["source_id", "normalized_url"], "left_anti").select("normalized_url")


@query(FRONTIER_SQL + """
SELECT normalized_url, CASE WHEN depth = 2 THEN 'done' WHEN depth = 3 AND attempts % 2 = 0 THEN 'skipped' WHEN depth = 3 THEN 'failed' ELSE status END AS status, (attempts + (depth >= 2)::INT)::INT AS attempts FROM f
QUALIFY count(*) OVER (PARTITION BY normalized_url) = 1
""")
def frontier_results(spark, sf_dir):
    """Results without an error, with one that skips the page, and with another."""
    f = _frontier(spark, sf_dir)
    once = f.join(f.groupBy("normalized_url").count().filter("count = 1").select("normalized_url"), "normalized_url", "left_semi").select(*f.columns)
    error = F.when(F.col("depth") == 3, F.when(F.col("attempts") % 2 == 0, "HTTP 404").otherwise("timeout"))
    return frontier.apply_results(once, once.filter("depth >= 2").withColumn("error", error)).select("normalized_url", "status", "attempts")


# Libraries and versions.


@query("""
WITH n AS (SELECT s_suppkey, s_name, lower(s_name) AS l, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS b FROM supplier)
SELECT s_suppkey, CASE WHEN l = 'supplier#1' THEN 100 WHEN b = 'supplier1' THEN 95 WHEN instr(l, 'supplier#1') > 0 THEN 80 - least(20, instr(l, 'supplier#1') - 1) WHEN instr(b, 'supplier1') > 0 THEN 70 - least(20, instr(b, 'supplier1') - 1) ELSE 0 END::INT AS score FROM n
""")
def library_match(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", lookup.match_score(F.col("s_name"), "Supplier#1").cast("int").alias("score"))


TAGS = "concat('v', o_orderkey % 7, '.', o_orderkey % 13, '.', o_orderkey % 5, CASE WHEN o_orderkey % 11 = 0 THEN '-rc.1' ELSE '' END)"


def _tags(spark, sf_dir) -> DataFrame:
    """Tags of the customers' orders: (source_id, pos, tag)."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("pos"), F.expr(TAGS).alias("tag"))


LATEST_SQL = f"""
SELECT o_custkey AS source_id, concat(o_orderkey % 7, '.x') AS label, {TAGS} AS tag FROM orders WHERE o_orderkey % 11 <> 0
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey % 13 DESC, o_orderkey % 5 DESC, o_orderkey) = 1
"""


@query(LATEST_SQL)
def version_latest_by_major(spark, sf_dir):
    return versions.latest_by_major(_tags(spark, sf_dir).filter(~versions.is_prerelease(F.col("tag"))))


@query(f"SELECT source_id, label, tag FROM ({LATEST_SQL}) WHERE label = '3.x'")
def version_latest_of_series(spark, sf_dir):
    return versions.latest_of_series(_tags(spark, sf_dir).filter(~versions.is_prerelease(F.col("tag"))), "v3.x")


@query(f"""
WITH first AS (SELECT o_custkey AS k, min_by({TAGS}, o_orderkey) AS tag, min(o_orderkey) % 7 AS major FROM orders GROUP BY o_custkey)
SELECT c_custkey AS source_id, coalesce(tag, 'main') AS ref, coalesce(concat(major::VARCHAR || '.x'), 'main') AS label FROM customer LEFT JOIN first ON k = c_custkey
""".replace("concat(major::VARCHAR || '.x')", "major::VARCHAR || '.x'"))
def version_default(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("main").alias("default_branch"))
    return versions.default_version(_tags(spark, sf_dir), sources)


@query(f"""
WITH latest AS ({LATEST_SQL}),
newest AS (SELECT source_id, label FROM latest QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY label DESC) <= 3),
labels AS (SELECT source_id, label FROM newest UNION SELECT c_custkey, '1.x' FROM customer WHERE c_custkey % 4 = 0 UNION SELECT c_custkey, 'next' FROM customer WHERE c_custkey % 5 = 0)
SELECT l.source_id, l.label, CASE WHEN l.label = '1.x' AND l.source_id % 4 = 0 THEN 'v1.0.0' ELSE coalesce(t.tag, 'main') END AS ref FROM labels l LEFT JOIN latest t USING (source_id, label)
""")
def version_plan(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    recorded = customers.filter("source_id % 4 = 0").select("source_id", F.lit("1.x").alias("version_label"), F.lit("v1.0.0").alias("ref"))
    own = F.when(F.col("source_id") % 5 == 0, "next")
    sources = customers.select("source_id", own.alias("version_label"), F.lit(None).cast("string").alias("ref"), F.lit("main").alias("default_branch"))
    return versions.version_plan(_tags(spark, sf_dir).filter(~versions.is_prerelease(F.col("tag"))), sources, recorded)


LABELS = by_case("p_partkey", ["concat('^', p_size, '.0.0')", "concat('v', p_size, '.2.3')", "concat('>= 0.', p_size)", "'*'", "concat(p_size, '.x')", "concat('v', p_size, '.x')"])


@query(f"""
SELECT p_partkey, {LABELS} AS v, {by_case("p_partkey", ["concat(p_size, '.x')", "concat(p_size, '.x')", "'0.x'", "NULL", "concat(p_size, '.x')", "concat(p_size, '.x')"])} AS label,
       CASE WHEN p_partkey % 6 >= 4 THEN p_size END AS series FROM part
""")
def version_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(LABELS).alias("v"))
    return rows.select("p_partkey", "v", versions.suggested_label(F.col("v")).alias("label"), versions.series(F.col("v")).alias("series"))


FILE_PATHS = by_case("doc_id", [
    "concat('docs/', doc_id, '.md')", "concat('img/', doc_id, '.png')", "concat('svc', doc_id, '/Dockerfile')", "concat('.github/', doc_id, '.yml')", "concat('js/', doc_id, '.min.js')",
    "concat('src/vendor/', doc_id, '.go')", "concat('a/', doc_id, '.ts')", "concat('x/', doc_id, '.unknown')", "concat('x', doc_id, '/package-lock.json')", "concat('cypress/videos/', doc_id, '.md')",
    "concat('notes/', doc_id)", "concat('docs/draft-', doc_id, '.md')",
])
FILE_REASONS = by_case("doc_id", ["NULL", "'extension'", "NULL", "'directory'", "'path_ending'", "'directory'", "NULL", "'not_listed'", "'file_name'", "'path_part'", "'no_extension'", "NULL"])


@query(f"""
SELECT doc_id, coalesce({FILE_REASONS}, CASE WHEN n_chars * 1000 > 5242880 THEN 'file_too_large' END) AS reason,
       coalesce({FILE_REASONS}, CASE WHEN doc_id % 12 NOT IN (0, 6, 11) THEN 'not_included' WHEN doc_id % 12 = 11 THEN 'excluded' WHEN n_chars * 1000 > 5242880 THEN 'file_too_large' END) AS chosen FROM documents
""")
def path_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(FILE_PATHS).alias("path"), (F.col("n_chars") * 1000).alias("size"))
    chosen = paths.skip_reason(F.col("path"), F.col("size"), include=["docs/**/*.md", "[a-c]/*.{ts,js}"], exclude=["**/draft-*"])
    return rows.select("doc_id", paths.skip_reason(F.col("path"), F.col("size")).alias("reason"), chosen.alias("chosen"))


#: path, content, and the rows that come out, by the remainder of doc_id; {i} is the id and {v} a number of it.
MANIFESTS = [
    ("p{i}/package.json", '{{"dependencies": {{"hono{i}": "^{v}.0.0"}}, "devDependencies": {{"typescript": "5"}}, "peerDependencies": {{"esbuild-linux-x64": "1"}}}}', [("hono{i}", "^{v}.0.0", "{v}.x")]),
    ("p{i}/composer.json", '{{"require": {{"laravel/f{i}": "{v}"}}, "require-dev": {{"phpunit": "1"}}}}', [("laravel/f{i}", "{v}", "{v}.x")]),
    ("p{i}/pyproject.toml", '[tool.poetry.dependencies]\npython = "3.12"\nfast{i} = "0.{v}"\n[project]\ndependencies = ["httpx >= {v}.25"]\n', [("fast{i}", "0.{v}", "0.x"), ("httpx", ">= {v}.25", "{v}.x")]),
    ("p{i}/requirements.txt", "# c\nrequests{i}=={v}.31.0\nflask\n", [("requests{i}", "{v}.31.0", "{v}.x"), ("flask", "*", None)]),
    ("p{i}/go.mod", "module x\nrequire (\n\tgithub.com/pkg/e{i} v{v}.9.1\n)\n", [("github.com/pkg/e{i}", "v{v}.9.1", "{v}.x")]),
    ("p{i}/Cargo.toml", '[dependencies]\nserde{i} = "{v}.0"\nreq = {{ version = "0.{v}", features = ["json"] }}\n[dev-dependencies]\nno = "1"\n', [("serde{i}", "{v}.0", "{v}.x"), ("req", "0.{v}", "0.x")]),
    ("p{i}/Gemfile", 'gem "rails{i}", "{v}.1"\n', [("rails{i}", "{v}.1", "{v}.x")]),
    ("p{i}/pom.xml", "<dependency><groupId>g{i}</groupId><artifactId>a</artifactId><version>{v}.10</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency>", [("g{i}:a", "{v}.10", "{v}.x")]),
    ("p{i}/build.gradle", "dependencies {{\n implementation 'com.s{i}:okhttp:{v}.12.0'\n}}\n", [("com.s{i}:okhttp", "{v}.12.0", "{v}.x")]),
    ("p{i}/Pipfile", '[packages]\nq{i} = "=={v}.2"\n[dev-packages]\nno = "1"\n', [("q{i}", "=={v}.2", "{v}.x")]),
    ("p{i}/node_modules/x/package.json", '{{"dependencies": {{"hidden": "1"}}}}', []),
]


def filled(template: str | None) -> str:
    """SQL of a template."""
    if template is None:
        return "NULL"
    plain = template.replace("{{", "{").replace("}}", "}").replace("'", "''")
    return "replace(replace('" + plain + "', '{i}', CAST(doc_id AS STRING)), '{v}', CAST(n_chars % 90 AS STRING))"


@query(" UNION ALL ".join(
    f"SELECT {filled(path)} AS manifest, {filled(name)} AS name, {filled(version)} AS version, {filled(label)} AS label FROM documents WHERE doc_id % {len(MANIFESTS)} = {k}"
    for k, (path, _, rows) in enumerate(MANIFESTS) for name, version, label in rows
))
def manifest_dependencies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    value = lambda k: F.expr(filled(k))
    kind = F.col("doc_id") % len(MANIFESTS)
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (p, c, _) in enumerate(MANIFESTS):
        path, content = F.when(kind == k, value(p)).otherwise(path), F.when(kind == k, value(c.replace("\n", "\\n").replace("\t", "\\t"))).otherwise(content)
    return manifests.detected(docs.select(path.alias("path"), content.alias("content")))


# Discovery.


@query("SELECT DISTINCT url FROM pages")
def sitemap_pages(spark, sf_dir):
    """Every host's pages in sitemaps of at most 10,000 (the protocol allows 50,000), an index for each 10,000 pages, and an index of these."""
    host, block = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.floor(F.col("page_id") / 10_000)
    entry = F.concat(F.lit("<url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    listed = F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("content")
    own = table(spark, sf_dir, "pages").groupBy(block.alias("block"), F.concat(F.lit("https://"), host, F.lit("/s"), block, F.lit(".xml")).alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("content"))
    blocks = own.groupBy(F.concat(F.lit("https://example.com/sitemap"), "block", F.lit(".xml")).alias("url")).agg(listed)
    index = blocks.agg(F.lit("https://example.com/sitemap.xml").alias("url"), listed)
    own = blocks.unionByName(own.drop("block"))
    return files.read_sitemaps(index.select("url"), index.unionByName(own))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), r(k) AS (
    SELECT 0::BIGINT UNION SELECT unnest([(k * 3 + 1) % n, (k * 7 + 2) % n]) FROM r, n WHERE k % 5 <> 4
)
SELECT DISTINCT url FROM pages JOIN r ON page_id = k WHERE k % 5 = 4
""")
def sitemap_walk(spark, sf_dir):
    """Indexes that list one another in cycles of any length; the fifth ones list a page."""
    pages_ = table(spark, sf_dir, "pages")
    k, n = F.col("page_id"), pages_.count()
    name = lambda of: F.concat(F.lit("https://e.com/s"), of.cast("string"), F.lit(".xml"))
    entry = lambda of: F.concat(F.lit("<sitemap><loc>"), name(of), F.lit("</loc></sitemap>"))
    index = F.concat(F.lit("<sitemapindex>"), entry((k * 3 + 1) % n), entry((k * 7 + 2) % n), F.lit("</sitemapindex>"))
    leaf = F.concat(F.lit("<urlset><url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    content = pages_.select(name(k).alias("url"), F.when(k % 5 == 4, leaf).otherwise(index).alias("content"))
    return files.read_sitemaps(spark.createDataFrame([("https://e.com/s0.xml",)], "url string"), content, None)


@query("""
SELECT page_id AS source_id, unnest(CASE WHEN page_id % 3 = 0 THEN [url, 'https://e.com/docs/' || page_id] WHEN page_id % 3 = 1 THEN ['https://x.org/' || page_id] ELSE [] END) AS url FROM pages
""")
def llms_links(spark, sf_dir):
    """A manifest with a link and a bare address, one whose second file alone lists anything, and one that lists nothing."""
    pages_ = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    full = F.concat(F.lit("# T https://no.example\n- [A]("), "url", F.lit("): x\nhttps://e.com/docs/"), key, F.lit("\n| no |\n- [rel](docs/x)"))
    first = pages_.select(F.col("page_id").alias("source_id"), F.lit(0).alias("rank"), F.when(F.col("page_id") % 3 == 0, full).otherwise("nothing").alias("content"))
    second = pages_.filter("page_id % 3 < 2").select(F.col("page_id").alias("source_id"), F.lit(1).alias("rank"), F.concat(F.lit("- https://x.org/"), key).alias("content"))
    return files.manifest_links(first.unionByName(second)).select("source_id", "url")


@query("""
WITH r AS (SELECT page_id, url, regexp_extract(url, '^(https?):', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id AS source_id, unnest([scheme || '://' || host || '/a.xml', scheme || '://' || host || '/b' || page_id || '.xml', scheme || '://cdn.e.com/c.xml', scheme || '://d.e.com/d.xml']) AS url FROM r
""")
def robots_sitemaps(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    scheme = F.regexp_extract("url", "^(https?):", 1)
    lines = F.concat(F.lit("User-agent: *\nSitemap: "), scheme, F.lit("://"), host, F.lit("/a.xml\n sitemap: /b"), F.col("page_id").cast("string"), F.lit(".xml\nSITEMAP: //cdn.e.com/c.xml\nSitemap:d.e.com/d.xml\nDisallow: /x"))
    return files.robots_sitemaps(table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("root"), lines.alias("content"))).select("source_id", "url")


@query("""
WITH s AS (SELECT s_suppkey AS pos, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'github|o' || s_suppkey % 26 || '|repo|' ELSE 'web|https://h' || s_suppkey % 30 || '.com/docs' END AS key FROM supplier)
SELECT name FROM s WHERE pos % 26 <> 4 OR pos % 2 = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1
""")
def seed_dedupe(spark, sf_dir):
    """Repositories in other spellings and web roots with and without a slash; one repository is known."""
    k = F.col("s_suppkey")
    n = lambda m: (k % m).cast("string")
    repo = F.concat(F.when(k % 3 == 0, "https://github.com/O").otherwise("https://github.com/o"), n(26), F.when(k % 5 == 0, "/Repo/").otherwise("/repo"))
    web = F.concat(F.lit("https://h"), n(30), F.when(k % 4 == 1, ".com/docs/").otherwise(".COM/docs"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("pos"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "github").otherwise("web").alias("type"), F.when(k % 2 == 0, repo).otherwise(web).alias("url"), F.lit(None).cast("string").alias("docs"))
    return files.new_seeds(rows, spark.createDataFrame([("github|o4|repo|",)], "key string")).select("name")


@query("SELECT s_suppkey AS source_id FROM supplier WHERE s_suppkey % 4 = 3 OR (s_suppkey % 4 = 2)")
def changed_archives(spark, sf_dir):
    """Weak and strong tags that agree, commits that agree, others, and sources never synced."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    landing = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.concat(F.lit('W/"'), key, F.lit('"')).alias("etag"), F.concat(F.lit("c"), key).alias("commit_sha"))
    was = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 3").select(k.alias("source_id"), F.when(k % 4 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(F.lit("old")).alias("etag"), F.when(k % 4 == 1, F.concat(F.lit("c"), key)).otherwise(F.lit("b")).alias("commit_sha"))
    return files.changed_archives(landing, was).select("source_id")


REFS = by_case("s_suppkey", ["NULL", "'main'", "concat('abc', s_suppkey, 'def')", "concat('feat/x y', s_suppkey)"])


@query(f"""
WITH s AS (SELECT s_suppkey AS id, {REFS} AS ref, 'https://api.github.com/repos/o%20' || s_nationkey || '/r' || s_suppkey || '/zipball/' AS api, 'https://github.com/o%20' || s_nationkey || '/r' || s_suppkey || '/archive/' AS web FROM supplier),
u AS (SELECT id AS source_id, CASE WHEN ref IS NULL THEN [api || 'HEAD', web || 'HEAD.zip']
      WHEN id % 4 = 2 THEN [api || ref, web || ref || '.zip', web || 'refs/heads/' || ref || '.zip', web || 'refs/tags/' || ref || '.zip']
      ELSE [api || replace(replace(ref, '/', '%2F'), ' ', '%20'), web || 'refs/heads/' || replace(ref, ' ', '%20') || '.zip', web || 'refs/tags/' || replace(ref, ' ', '%20') || '.zip'] END AS l FROM s)
SELECT source_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS url FROM u
""")
def archive_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("o "), F.col("s_nationkey").cast("string")).alias("owner"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repo"), F.expr(REFS).alias("ref"))
    return files.archive_urls(rows)


CODES = "[200, 304, 401, 403, 404, 429, 503, 418, 200]"


@query(f"""
WITH r AS (SELECT o_custkey AS source_id, o_orderkey AS pos, ({CODES})[1 + o_orderkey % 9] AS code, o_orderkey % 9 = 8 AS big, o_orderkey % 2 = 0 AS token FROM orders),
o AS (SELECT *, CASE WHEN code = 304 THEN 'not-modified' WHEN code = 200 AND NOT big THEN 'ok' ELSE 'error' END AS outcome,
      CASE code WHEN 401 THEN 'token invalid or expired' WHEN 403 THEN CASE WHEN token THEN 'access denied: the token lacks scope or hit a rate limit' ELSE 'access denied or rate limited: a token may help' END WHEN 404 THEN 'repository or reference not found'
      WHEN 429 THEN '429: may be tried again' WHEN 503 THEN '503: may be tried again' WHEN 418 THEN 'error 418' WHEN 200 THEN CASE WHEN big THEN 'archive of 600.0 MB exceeds the limit' END END AS error,
      CASE code WHEN 304 THEN 'sent' ELSE 't' || pos END AS tag FROM r)
SELECT source_id, pos, outcome, error, tag FROM o QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY outcome = 'error', CASE WHEN outcome = 'error' THEN -pos ELSE pos END) = 1
""")
def archive_downloads(spark, sf_dir):
    """Attempts of all outcomes, and which one a source takes."""
    k = F.col("o_orderkey")
    codes = F.expr(f"element_at(array({CODES.strip('[]')}), cast(1 + o_orderkey % 9 as int))")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), k.alias("pos"), codes.alias("code"), F.when(k % 9 == 8, 600 * 1048576).otherwise(1000).alias("size"), F.concat(F.lit(" W/t"), k.cast("string")).alias("etag"),
        F.lit("s").alias("sha"), F.lit("sent").alias("sent_etag"), (k % 2 == 0).alias("with_token"),
    )
    return files.landed_archives(files.download_outcomes(rows)).select("source_id", "pos", "outcome", "error", "tag")


@query("""
SELECT url, min(page_id) AS pos FROM pages WHERE lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) = (SELECT min(lower(regexp_extract(url, '^https?://([^/?#]+)', 1))) FROM pages) GROUP BY url
""")
def url_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = p.agg(F.min(F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)))).first()[0]
    lists = p.select(F.lit(0).alias("list"), F.col("page_id").alias("pos"), "url").unionByName(p.select(F.lit(1).alias("list"), F.col("page_id").alias("pos"), "url"))
    return files.discovered(lists, f"https://{host}/").select("url", F.col("pos.pos").alias("pos"))


# Services.


@query("""
SELECT * FROM (VALUES ('vercel/next.js', 'github', 'vercel/next.js', 'next.js', 'v16.2.0', NULL, '16.x'), ('https://github.com/foo/bar/tree/main/docs/', 'github', 'foo/bar', 'bar', 'main', 'docs', NULL),
('https://Example.com/guide', 'web', 'example.com', NULL, NULL, NULL, NULL)) t(address, kind, name, repo, ref, docs_path, version_label)
""")
def source_rows(spark, sf_dir):
    out = None
    for address, flags in (("vercel/next.js", {"tag": "v16.2.0"}), ("https://github.com/foo/bar/tree/main/docs/", {}), ("https://Example.com/guide", {})):
        row = services.source_row(spark, address, **flags).select(F.lit(address).alias("address"), "kind", "name", "repo", "ref", "docs_path", "version_label")
        out = row if out is None else out.unionByName(row)
    return out


def _libraries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers as sources; their versions from orders of the same number."""
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("own"), F.col("s_nationkey").cast("string")).alias("owner"), F.concat(F.lit("repo"), k.cast("string")).alias("repo"), F.when(k % 3 == 0, "5.x").alias("version_label"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".x")).alias("version_label"), F.col("o_orderdate").alias("synced_at"))
    return sources, found


LIBRARIES_SQL = """
WITH src AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '5.x' END AS own FROM supplier),
v AS (SELECT o_custkey AS id, concat(o_orderkey % 4, '.x') AS label, max(o_orderdate) AS seen FROM orders GROUP BY ALL),
lists AS (SELECT id, list(label ORDER BY seen DESC, label DESC) AS l FROM v GROUP BY id),
lib AS (SELECT src.id, name, CASE WHEN instr(lower(name), 'supplier#0000000') > 0 THEN 80 ELSE 0 END AS score,
        list_concat(CASE WHEN own IS NULL THEN [] ELSE [own] END, coalesce(l, [])) AS versions FROM src LEFT JOIN lists USING (id))
"""


@query(LIBRARIES_SQL + "SELECT id, name, score, versions FROM lib WHERE score > 0 ORDER BY score DESC, name LIMIT 20")
def library_search(spark, sf_dir):
    return services.library_lookup(*_libraries(spark, sf_dir), "supplier#0000000")


@query(LIBRARIES_SQL + "SELECT id, name FROM lib WHERE score > 0 AND list_contains(versions, '3.x') ORDER BY score DESC, name LIMIT 20")
def library_version_fallback(spark, sf_dir):
    return services.library_lookup(*_libraries(spark, sf_dir), "supplier#0000000", "3.2.1").select("id", "name")


@query("SELECT s_suppkey AS id FROM supplier WHERE starts_with('https://h3.com/docs/x', 'https://h' || s_suppkey || '.com')")
def library_of_address(spark, sf_dir):
    roots = _libraries(spark, sf_dir)[0].withColumn("root_url", F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".com")))
    return lookup.infer_library(roots, "https://h3.com/docs/x").select("id")


ROOTS_SQL = """
WITH roots AS (
    SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN regexp_extract(url, '^https?://[^/]+') WHEN 1 THEN regexp_extract(url, '^https?://[^/]+/[a-z]+/')
        WHEN 2 THEN url[1 : length(url) * 7 // 10] ELSE url[1 : length(url) - 1] END AS root FROM supplier JOIN pages ON page_id = s_suppkey
    UNION ALL SELECT s_suppkey, concat('gh://own', s_nationkey, '/repo', s_suppkey % 30, '@') FROM supplier
), addresses AS (
    SELECT url AS address FROM pages UNION SELECT concat('gh://own', s_nationkey, '/repo', s_suppkey % 30, '@main/docs/', s_name, '.md') FROM supplier
)
"""


def _roots(spark, sf_dir) -> DataFrame:
    """Sources whose roots are hosts, folders or cut addresses of the first pages."""
    k, url = F.col("s_suppkey"), F.col("url")
    root = F.when(k % 4 == 0, F.regexp_extract(url, "^https?://[^/]+", 0)).when(k % 4 == 1, F.regexp_extract(url, "^https?://[^/]+/[a-z]+/", 0))
    root = root.when(k % 4 == 2, F.substr(url, F.lit(1), F.floor(F.length(url) * 7 / 10).cast("int"))).otherwise(F.substr(url, F.lit(1), F.length(url) - 1))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("s_suppkey"), "url"), "s_suppkey", "left")
    return rows.select(k.alias("id"), root.alias("root_url"), F.concat(F.lit("own"), F.col("s_nationkey").cast("string")).alias("owner"), F.concat(F.lit("repo"), (k % 30).cast("string")).alias("repo"), "s_name")


@query(ROOTS_SQL + """SELECT address, first(id ORDER BY length(root) DESC, id) AS id, first(root ORDER BY length(root) DESC, id) AS root, count(*) AS n_matches
FROM addresses JOIN roots ON starts_with(address, root) AND root <> '' GROUP BY address""")
def libraries_of_addresses(spark, sf_dir):
    sources = _roots(spark, sf_dir)
    repo = F.concat(F.lit("gh://"), "owner", F.lit("/"), "repo", F.lit("@main/docs/"), "s_name", F.lit(".md"))
    addresses = table(spark, sf_dir, "pages").select(F.col("url").alias("address")).unionByName(sources.select(repo.alias("address")))
    return prefixes.infer_libraries(addresses, sources)


@query("""
WITH p AS (SELECT DISTINCT url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM pages),
s AS (SELECT s_suppkey AS scope_id, CASE WHEN s_suppkey % 3 = 0 THEN host ELSE regexp_replace(host, '^(m|www|blog)[.]', '') END AS host,
      CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['/EN', '/de/1'] WHEN 2 THEN ['/fr/', '/es'] ELSE ['/'] END AS allowed,
      CASE s_suppkey % 2 WHEN 0 THEN [] ELSE ['/en/1', '/de/12'] END AS denied, s_suppkey % 5 < 3 AS sub FROM supplier JOIN p0 ON page_id = s_suppkey)
SELECT url, scope_id FROM p JOIN s ON (p.host = s.host OR (sub AND ends_with(p.host, '.' || s.host)))
    AND (len(allowed) = 0 OR len(list_filter(allowed, lambda a: starts_with(path, lower(a)))) > 0) AND len(list_filter(denied, lambda a: starts_with(path, lower(a)))) = 0
""".replace("WITH p AS", "WITH p0 AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages), p AS"))
def scopes_of_pages(spark, sf_dir):
    """Every page against the crawl scope of every source; hosts as they are, or without their first label."""
    k, pages_ = F.col("s_suppkey"), table(spark, sf_dir, "pages")
    host = urls.host(F.col("url"))
    lists = lambda *cases: F.expr(by_case("s_suppkey", [f"array({', '.join(repr(p) for p in c)})" if c else "cast(array() as array<string>)" for c in cases]))
    scopes = table(spark, sf_dir, "supplier").join(pages_.select(F.col("page_id").alias("s_suppkey"), "url"), "s_suppkey").select(
        k.alias("scope_id"), F.when(k % 3 == 0, host).otherwise(F.regexp_replace(host, r"^(m|www|blog)\.", "")).alias("host"),
        lists([], ["/EN", "/de/1"], ["/fr/", "/es"], ["/"]).alias("allowed"), lists([], ["/en/1", "/de/12"]).alias("denied"), (k % 5 < 3).alias("subdomains"),
    )
    return prefixes.in_scopes(pages_, scopes)


@query("""
WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
one AS (SELECT doc_id, unnest(l) AS line, unnest(l[2:] || ['']) AS after, unnest(range(1, len(l) + 1)) AS k, len(l) AS n FROM ls),
c AS (SELECT doc_id, 0 AS position, 1 AS a, len(l) AS z, array_to_string(l, chr(10)) AS code FROM ls
    UNION ALL SELECT doc_id, 2 * k, k, k, CASE WHEN (doc_id + k) % 3 = 0 THEN line || '!' ELSE line END FROM one
    UNION ALL SELECT doc_id, 2 * k + 1, k, least(k + 1, n), line || chr(10) || after FROM one)
SELECT DISTINCT c.doc_id AS document_id, c.position FROM c JOIN c o ON o.doc_id = c.doc_id AND o.position <> c.position AND o.a <= c.a AND o.z >= c.z AND contains(o.code, c.code)
WHERE length(c.code) < 200 AND c.code <> ''
""")
def nested_chunks(spark, sf_dir):
    """Chunks of each text: the whole, its lines (some of them changed), and its pairs of lines."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n", -1).alias("l"))
    chunk = lambda p, a, z, code: F.struct(p.cast("int").alias("position"), a.cast("int").alias("line_start"), z.cast("int").alias("line_end"), code.alias("code"))
    n = F.size("l")
    line = lambda k: F.get("l", k - 1)
    own = F.transform(F.sequence(F.lit(1), n), lambda k: chunk(2 * k, k, k, F.when((F.col("document_id") + k) % 3 == 0, F.concat(line(k), F.lit("!"))).otherwise(line(k))))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda k: chunk(2 * k + 1, k, F.least(k + 1, n), F.concat(line(k), F.lit("\n"), F.coalesce(line(k + 1), F.lit("")))))
    whole = F.array(chunk(F.lit(0), F.lit(1), n, F.array_join("l", "\n")))
    rows = lines.select("document_id", F.explode(F.concat(whole, own, pairs)).alias("c")).select("document_id", "c.*")
    return containment.nested(rows.withColumn("token_count", F.length("code")), 200)


@query("SELECT DISTINCT concat(o_orderkey % 4, '.x') AS label FROM orders")
def version_listing(spark, sf_dir):
    return services.available_labels(_libraries(spark, sf_dir)[1])


@query("SELECT s_suppkey AS id FROM supplier WHERE s_name = 'Supplier#000000007'")
def library_resolve(spark, sf_dir):
    return lookup.resolve_library(_libraries(spark, sf_dir)[0], "supplier#000000007").select("id")


@query("SELECT o_custkey AS source_id, concat(o_orderkey % 4, '.x') AS version_label, o_orderdate AS synced_at FROM orders WHERE o_custkey = 4")
def versions_of_source(spark, sf_dir):
    found = services.list_versions(_libraries(spark, sf_dir)[1], 4)
    return found.select("source_id", "version_label", F.col("synced_at").cast("timestamp_ntz").alias("synced_at"))


@query("SELECT o_orderpriority AS key, min_by(o_orderkey, o_orderkey) AS first FROM orders GROUP BY o_orderpriority")
def first_by_key(spark, sf_dir):
    return store.keep_latest(table(spark, sf_dir, "orders").withColumn("back", -F.col("o_orderkey")), ["o_orderpriority"], "back").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("first"))


@query("SELECT count(*) FILTER (change_type IN ('new', 'changed')) AS updated, count(*) FILTER (change_type = 'same') AS unchanged, (SELECT count(*) FROM pages) AS skipped FROM (" + UPSERT_SQL + " SELECT change_type FROM u)")
def ingest_summary(spark, sf_dir):
    return services.ingest_summary(store.upsert_documents(*_snapshots(spark, sf_dir)), table(spark, sf_dir, "pages"))


# Chunking, events.


@query("""
WITH RECURSIVE docs AS (
    SELECT doc_id, lang || ' > ' || source AS crumb, lang || ' > ' || source || chr(10) || chr(10) || trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, W)), chr(10)), W) AS content, len(string_split(text, chr(10))) AS n_lines
    FROM documents WHERE trim(text, W) <> ''
), long AS (
    SELECT *, string_split(content, chr(10)) AS ls, list_transform(string_split(content, chr(10)), lambda x: length(x)) AS u FROM docs WHERE ceil(length(content) / 4) > 600
), walk(doc_id, k, first, size, a, z) AS (
    SELECT doc_id, 0, 1, -1, NULL::BIGINT, NULL::BIGINT FROM long
    UNION ALL
    SELECT doc_id, k, CASE WHEN cut THEN handed ELSE first END, CASE WHEN cut THEN list_sum(u[handed : k])::BIGINT + (k - handed) ELSE size END, CASE WHEN cut THEN first END, CASE WHEN cut THEN k END
    FROM (SELECT l.doc_id, w.k + 1 AS k, w.first, w.size + u[w.k + 1] + 1 AS size, u, ceil((w.size + u[w.k + 1] + 1) / 4) >= 600 AS cut,
                 coalesce(list_last(list_filter(range(w.first, w.k + 2), lambda j: list_sum(list_transform(u[j : w.k + 1], lambda x: greatest(1, ceil(x / 4)))) >= 60)), w.first) AS handed
          FROM walk w JOIN long l USING (doc_id) WHERE w.k < len(u))
), cuts AS (
    SELECT doc_id, a, z, FALSE AS rest FROM walk WHERE a IS NOT NULL
    UNION ALL SELECT w.doc_id, w.first, len(l.u), TRUE FROM walk w JOIN long l USING (doc_id) WHERE w.k = len(l.u)
), pieces AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rest, z) AS n, c, line_start, line_end
    FROM (SELECT doc_id, z, rest, trim(array_to_string(ls[a : z], chr(10)), W) AS c, CASE WHEN rest THEN n_lines - (z - a) ELSE a END AS line_start, CASE WHEN rest THEN n_lines ELSE z END AS line_end FROM cuts JOIN long USING (doc_id))
    WHERE ceil(length(c) / 4) >= 40
), fold(doc_id, n, c, line_start, line_end, done) AS (
    SELECT doc_id, 1, c, line_start, line_end, NULL::STRUCT(c VARCHAR, a BIGINT, z BIGINT) FROM pieces WHERE n = 1
    UNION ALL
    SELECT f.doc_id, p.n, CASE WHEN fits THEN both_ ELSE p.c END, CASE WHEN fits THEN f.line_start ELSE p.line_start END, p.line_end, CASE WHEN NOT fits THEN {'c': f.c, 'a': f.line_start, 'z': f.line_end} END
    FROM (SELECT *, ceil(length(f0.c) / 4) < 200 AS small FROM fold f0) f JOIN pieces p ON p.doc_id = f.doc_id AND p.n = f.n + 1,
         LATERAL (SELECT trim(f.c || chr(10) || chr(10) || p.c, W) AS both_), LATERAL (SELECT small AND ceil(length(both_) / 4) <= 600 AS fits)
), chunks AS (
    SELECT doc_id, content AS c, 1 AS line_start, n_lines AS line_end FROM docs WHERE ceil(length(content) / 4) <= 600
    UNION ALL SELECT doc_id, done.c, done.a, done.z FROM fold WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, c, line_start, line_end FROM fold QUALIFY n = max(n) OVER (PARTITION BY doc_id)
    UNION ALL SELECT doc_id, rtrim(content[1 : 2400], W), 1, n_lines FROM long WHERE doc_id NOT IN (SELECT doc_id FROM pieces)
)
SELECT doc_id AS document_id, crumb AS context_path, c AS content, greatest(1, ceil(length(c) / 4))::INT AS token_count, line_start::INT AS line_start, line_end::INT AS line_end FROM chunks JOIN docs USING (doc_id)
""".replace("W)", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"))
def markdown_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("title"), F.array(F.col("lang")).alias("prefix"), F.col("text").alias("content"))
    return chunking.chunk_documents(docs).select("document_id", "context_path", "content", "token_count", "line_start", "line_end")


@query("""
WITH chars AS (
    SELECT doc_id, unnest(string_split(c, '')) AS c, unnest(range(length(c))) AS k FROM (SELECT doc_id, translate(text, '.,"''`/', '}{') AS c FROM documents WHERE text <> '')
), b AS (SELECT doc_id, c, k, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM chars WHERE c IN ('{', '}')),
pairs AS (SELECT o.doc_id, o.k AS opened, min(c.k) AS closed, o.after AS depth FROM b o JOIN b c ON c.doc_id = o.doc_id AND c.k > o.k AND c.c = '}' AND c.after = o.after - 1 WHERE o.c = '{' GROUP BY ALL)
SELECT doc_id AS document_id, opened::INT AS opened, closed::INT AS closed, (depth - (SELECT min(after + CASE c WHEN '}' THEN 1 ELSE 0 END) FROM b WHERE b.doc_id = pairs.doc_id AND (c = '}' OR k IN (SELECT opened FROM pairs q WHERE q.doc_id = b.doc_id))) + 1)::INT AS depth FROM pairs
""".replace("(depth - (SELECT min(after + CASE c WHEN '}' THEN 1 ELSE 0 END) FROM b WHERE b.doc_id = pairs.doc_id AND (c = '}' OR k IN (SELECT opened FROM pairs q WHERE q.doc_id = b.doc_id))) + 1)::INT AS depth FROM pairs", "(depth - min(depth) OVER (PARTITION BY doc_id) + 1)::INT AS depth FROM pairs"))
def code_brackets(spark, sf_dir):
    """Pairs of brackets in texts whose commas open and whose full stops close one."""
    code = F.translate("text", ".,\"'`/", "}{")
    return symbols.brackets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), code.alias("content")))


@query("""
WITH l AS (SELECT doc_id, doc_id % 5 AS kind, len(string_split(text, chr(10))) AS n FROM documents),
own AS (SELECT doc_id, kind, n, unnest(range(n)) AS k FROM l)
SELECT doc_id AS document_id, 'D' || doc_id AS symbol_name, CASE kind WHEN 0 THEN 'class_declaration' WHEN 1 THEN 'class_definition' ELSE 'class' END AS symbol_type, 0 AS line_start,
       (CASE kind WHEN 0 THEN 4 * n + 1 WHEN 1 THEN 3 * n ELSE 4 * n + 1 END)::INT AS line_end FROM l WHERE kind < 3
UNION ALL SELECT doc_id, 'f' || k, CASE kind WHEN 0 THEN 'method_definition' WHEN 1 THEN 'function_definition' ELSE 'method' END, (1 + k * CASE kind WHEN 1 THEN 3 ELSE 4 END)::INT,
       (CASE kind WHEN 1 THEN 3 + 3 * k ELSE 4 + 4 * k END)::INT FROM own WHERE kind < 3
""")
def code_symbols(spark, sf_dir):
    """Symbols of programs that hold the lines of a text as comments: one class of one function a line, by language."""
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.col("doc_id") % 5)
    name, ident = F.concat(F.lit("D"), F.col("doc_id").cast("string")), lambda k: F.concat(F.lit("f"), k.cast("string"))
    blocks = lambda make: F.array_join(F.transform(F.split("text", "\n", -1), make), "\n")
    code = F.when(F.col("kind") == 0, F.concat(F.lit("class "), name, F.lit(" {\n"), blocks(lambda x, k: F.concat(F.lit("  "), ident(k), F.lit("(a) {\n    // "), x, F.lit("\n    return a;\n  }"))), F.lit("\n}\n")))
    code = code.when(F.col("kind") == 1, F.concat(F.lit("class "), name, F.lit(":\n"), blocks(lambda x, k: F.concat(F.lit("    def "), ident(k), F.lit("(a):\n        # "), x, F.lit("\n        return a")))))
    code = code.when(F.col("kind") == 2, F.concat(F.lit("class "), name, F.lit("\n"), blocks(lambda x, k: F.concat(F.lit("  def "), ident(k), F.lit("(a)\n    # "), x, F.lit("\n    a\n  end"))), F.lit("\nend\n"))).otherwise(F.col("text"))
    language = F.element_at(F.array(*[F.lit(x) for x in ("typescript", "python", "ruby", "json", "css")]), (F.col("kind") + 1).cast("int"))
    return symbols.symbols(docs.select(F.col("doc_id").alias("document_id"), language.alias("language"), code.alias("content"))).select("document_id", "symbol_name", "symbol_type", "line_start", "line_end")


@query("""
WITH d2 AS (
    SELECT doc_id, 'p' AS lang, source, CASE WHEN doc_id % 5 <> 0 AND doc_id % 11 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0
), c AS (SELECT document_id, count(*) AS n_chunks, sum(token_count) AS n_tokens FROM (CHUNKS) GROUP BY document_id)
SELECT concat('docs/', doc_id, '.md') AS path, doc_id % 5 <> 0 AS active, sha256(text) AS hash, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM d2 LEFT JOIN c ON document_id = doc_id
""".replace("CHUNKS", ORACLES["markdown_chunks"].replace("FROM documents WHERE", "FROM d2 WHERE")))
def engine_two_commits(spark, sf_dir):
    """A store of two ingests: of all documents but every seventh, then of all but every fifth, some of them changed; what the second lacks is inactive."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    row = lambda of, content: of.select(path.alias("path"), path.alias("uri"), F.col("source").alias("title"), content.alias("content"), F.lit("text/markdown").alias("content_type"))
    store_ = engine.Engine(spark, f"{shared.shared_folder(spark)}/quarry-{uuid.uuid4().hex}")
    store_.ingest(row(docs.filter("doc_id % 7 <> 0"), F.col("text")), 1, "1.x", ["p"])
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    store_.ingest(row(docs.filter("doc_id % 5 <> 0"), changed), 1, "1.x", ["p"])
    sizes = store_.table("chunks", 1).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
    rows = store_.table("documents", 1).join(sizes, "document_id", "left")
    return rows.select("path", "active", "hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


HEADED = "concat('# Title', chr(10), chr(10), '## ', source, chr(10), 'Hello ', doc_id, chr(10), chr(10), '## API', chr(10), 'More details')"


@query("""
WITH s AS (
    SELECT doc_id AS document_id, 0 AS position, source AS context_path, concat(source, chr(10), chr(10), '## ', source, chr(10), 'Hello ', doc_id) AS content, 3 AS line_start, 5 AS line_end FROM documents
    UNION ALL SELECT doc_id, 1, 'API', concat('API', chr(10), chr(10), '## API', chr(10), 'More details'), 6, 7 FROM documents
)
SELECT document_id, position, context_path, content, greatest(1, ceil(length(content) / 4))::INT AS token_count, line_start, line_end FROM s
""")
def heading_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("t.md").alias("path"), F.lit("Title").alias("title"), F.array().cast("array<string>").alias("prefix"), F.expr(HEADED).alias("content"))
    return chunking.chunk_documents(docs).select("document_id", "position", "context_path", "content", "token_count", "line_start", "line_end")


@query("""
WITH s AS (
    SELECT doc_id, 0 AS position, 'f' || doc_id AS name, concat('def f', doc_id, '(x):', chr(10), '    return ', n_chars) AS code, 1 AS line_start, 2 AS line_end FROM documents
    UNION ALL SELECT doc_id, 1, 'g' || doc_id, concat('def g', doc_id, '():', chr(10), '    pass'), 5, 6 FROM documents
)
SELECT doc_id AS document_id, position, name AS symbol_name, 'function_definition' AS symbol_type, concat('o/r > m', doc_id, '.py > ', name) AS context_path,
       concat('o/r > m', doc_id, '.py > ', name, chr(10), chr(10), '```python', chr(10), code, chr(10), '```') AS content, line_start, line_end FROM s
""")
def code_chunks(spark, sf_dir):
    code = F.expr("concat('def f', doc_id, '(x):', chr(10), '    return ', n_chars, chr(10), chr(10), chr(10), 'def g', doc_id, '():', chr(10), '    pass', chr(10))")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr("concat('m', doc_id, '.py')").alias("path"), F.lit(None).cast("string").alias("title"), F.array(F.lit("o/r")).alias("prefix"), code.alias("content"))
    return chunking.chunk_documents(docs).select("document_id", "position", "symbol_name", "symbol_type", "context_path", "content", "line_start", "line_end")


@query("""
WITH f AS (SELECT s_nationkey AS source_id, 'f' || s_suppkey || '.md' AS name FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY name) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM f)
SELECT source_id, concat('├── README.md', chr(10), '├── go.mod', chr(10), '├── docs/', chr(10), string_agg(concat('│   ', CASE WHEN k = n THEN '└── ' ELSE '├── ' END, name), chr(10) ORDER BY k), chr(10), '└── a.ts') AS tree FROM n GROUP BY source_id
""")
def repo_tree(spark, sf_dir):
    own = table(spark, sf_dir, "supplier")
    listed = own.select(F.col("s_nationkey").alias("source_id"), F.expr("explode(array(concat('docs/f', s_suppkey, '.md'), 'README.md', 'go.mod', 'a.ts'))").alias("path")).distinct()
    return tree.repo_trees(listed)


@query("""
WITH u AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)/([0-9]+)', 1) AS lang, regexp_extract(url, '^https?://[^/?#]+/([a-z]+)/([0-9]+)', 2) AS num FROM pages),
f AS (SELECT host, lang, d, num, rank() OVER (PARTITION BY host, lang, d ORDER BY num DESC) AS back FROM (SELECT *, 'd' || num[1:1] AS d FROM u)),
d AS (SELECT host, lang, d, rank() OVER (PARTITION BY host, lang ORDER BY d DESC) AS dback FROM (SELECT DISTINCT host, lang, d FROM f)),
l AS (SELECT host, lang, rank() OVER (PARTITION BY host ORDER BY lang DESC) AS lback FROM (SELECT DISTINCT host, lang FROM f)),
lines AS (
    SELECT host, 0 AS k, '' AS lang, '' AS d, '' AS num, '├── README.md' AS line FROM l GROUP BY host
    UNION ALL SELECT host, 1, lang, '', '', CASE lback WHEN 1 THEN '└── ' ELSE '├── ' END || lang || '/' FROM l
    UNION ALL SELECT host, 1, lang, d, '', CASE lback WHEN 1 THEN '    ' ELSE '│   ' END || CASE dback WHEN 1 THEN '└── ' ELSE '├── ' END || d || '/' FROM d JOIN l USING (host, lang)
    UNION ALL SELECT host, 1, lang, d, num, CASE lback WHEN 1 THEN '    ' ELSE '│   ' END || CASE dback WHEN 1 THEN '    ' ELSE '│   ' END || CASE back WHEN 1 THEN '└── ' ELSE '├── ' END || num FROM f JOIN d USING (host, lang, d) JOIN l USING (host, lang)
)
SELECT host AS source_id, string_agg(line, chr(10) ORDER BY k, lang, d, num) AS tree FROM lines GROUP BY host
""")
def page_tree(spark, sf_dir):
    """Hosts as sources, their pages as files in folders of folders."""
    part = lambda k: F.regexp_extract("url", "^https?://([^/?#]+)/([a-z]+)/([0-9]+)", k)
    path = F.concat(part(2), F.lit("/d"), F.substring(part(3), 1, 1), F.lit("/"), part(3))
    return tree.repo_trees(table(spark, sf_dir, "pages").select(part(1).alias("source_id"), F.explode(F.array(path, F.lit("README.md"))).alias("path")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    found = incremental.event_counts(table(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))
