"""What may not grow faster than the input: pairs formed by joins, rows carried and shuffled, partitions of one term."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import stem
from quarry.operators import containment, prefixes, search
from quarry.sources import files
from quarry.sources import pages as page_sources


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k.replace("__", ".")) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k.replace("__", "."), v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def matched(monkeypatch):
    """Numbers of rows that prefix_matches gives."""
    sizes, whole = [], prefixes.prefix_matches

    def counting(*args):
        out = whole(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(prefixes, "prefix_matches", counting)
    return sizes


def test_equal_roots_meet_an_address_once(spark, matched):
    addresses = spark.createDataFrame([(f"https://a.org/{k}",) for k in range(30)], "address string")
    roots = spark.createDataFrame([("https://a.org/", k) for k in range(40, 90)], "root string, id bigint")
    rows = prefixes.longest_prefix(addresses, "address", roots, "root", "id").collect()
    assert matched == [30]
    assert len(rows) == 30 and {(r.root, r.id, r.n_matches) for r in rows} == {("https://a.org/", 40, 50)}


def test_scopes_of_equal_rules_are_matched_as_one(spark, matched):
    pages = spark.createDataFrame([(f"https://a.org/docs/{k}",) for k in range(20)], "url string")
    scopes = spark.createDataFrame([(k, "A.org" if k % 2 else "a.org", ["/Docs"], ["/docs/1"], False) for k in range(50)], "scope_id bigint, host string, allowed array<string>, denied array<string>, subdomains boolean")
    rows = prefixes.in_scopes(pages, scopes).collect()
    assert matched == [20 + 11]  # the allowed rule and the denied one
    assert len(rows) == len(set(rows)) == 9 * 50


def test_locations_do_not_carry_the_sitemap(spark):
    found = files.sitemap_locations(spark.createDataFrame([("u", "<urlset><loc> a </loc><loc>b</loc></urlset>")], "url string, content string"))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lines[next(k for k, x in enumerate(lines) if "Generate" in x) + 1]
    assert "AS found" in below
    assert [(r.pos, r.location) for r in found.orderBy("pos").collect()] == [(0, "a"), (1, "b")]


def test_nested_chunks_shuffle_a_code_twice(spark):
    rows = spark.createDataFrame([(1, 0, 1, 3, "a\nb\nc", 900), (1, 1, 1, 1, "a", 1), (1, 2, 2, 2, "x", 1), (1, 3, 3, 3, "c", 1), (1, 4, 3, 3, "c", 1), (1, 5, 7, 7, "d", 1)], "document_id bigint, position int, line_start int, line_end int, code string, token_count int")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = containment.nested(rows, 200)
        assert plan(found).count("Exchange hashpartitioning") == 2
        assert sorted(r.position for r in found.collect()) == [1, 3, 4]
def test_rows_of_equal_rounded_bm25_rank_by_id(spark, tmp_path):
    import duckdb

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("that hain the"), F.repeat(F.lit(" pad"), (F.lit(12) - F.col("id") % 12).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("engine_search_word", "keyword_search_strict"):
        want = con.execute(catalog.ORACLES[name]).fetchall()
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(want) == sorted(got)


def test_term_statistics_shuffle_terms_alone(spark):
    docs = spark.createDataFrame([("s", 1, "a b a", "a"), ("s", 2, "a", "c"), ("t", 3, None, "")], "source_id string, chunk_id bigint, content string, title string")
    found = search.term_statistics(docs, "content", "title")
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {("s", "a", 2), ("s", "b", 1), ("s", "c", 1)}


def test_stems_of_a_query_are_counted_alone(spark):
    docs = spark.createDataFrame([(1, 1, "running runs that"), (1, 2, "ran"), (1, 3, "run")], "source_id bigint, chunk_id bigint, content string")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = search.bm25(search.build_index(docs), ["runs", "that"], match_all=False)
        assert re.search(r"BroadcastHashJoin \[word", plan(found)) and not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[word", plan(found))
        assert sorted(r.chunk_id for r in found.collect()) == [1, 3]


def test_a_frequent_term_is_stored_in_several_parts(spark):
    postings = spark.range(20_000).select(F.lit(1).alias("source_id"), F.col("id").alias("chunk_id"), F.lit("the").alias("term"), F.lit(1.0).alias("tf"))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        parts = search.by_term(postings).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000


def test_pages_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with settings(spark, **{key.replace(".", "__"): "10000"}):
        rows = spark.createDataFrame([(1, "https://a.org/b", "T", "text " * 80)], "page_id bigint, url string, title string, markdown string")
        assert page_sources.page_documents(rows, "https://a.org/", need_code=False).first().path == "b.md"
        assert int(spark.conf.get(key)) <= 1000


def test_postings_of_rows_are_those_of_the_index_without_a_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chunks = docs.select((F.col("doc_id") % 3).alias("source_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat(F.lit("Élan running "), "source").alias("title"), F.lit(None).cast("string").alias("uri"))
    rows = search.row_postings(chunks)
    want = {tuple(r) for r in search.build_index(chunks).postings.select("source_id", "chunk_id", "term", "tf").collect()}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) > 1000 and set(got) == want
    assert "Exchange" not in rows._jdf.queryExecution().toString()


def test_words_in_arrow_are_those_of_columns(spark):
    import pyarrow as pa

    texts = ["", "  ", "a", "Élan_vital  x\u0301y 3½ ٣", "don't—stop\n\tNow", "東京 2020年", "i\u0307stanbul", "_", "a\x00b", "😀 ok"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(1, 99, None)], "source_id bigint, chunk_id bigint, content string")
    want = {r.chunk_id: r.w for r in rows.select("chunk_id", stem.raw_tokens(F.col("content")).alias("w")).collect()}
    assert stem.arrow_tokens(pa.array([t.lower() for t in texts])).to_pylist() == [want[k] for k in range(len(texts))]
    assert {r.chunk_id: r.n for r in search.row_lengths(rows).collect()} == {k: len(w) for k, w in want.items()} == {r.chunk_id: r.n for r in search.build_index(rows).lengths.collect()}
    assert {tuple(r) for r in search.row_postings(rows).collect()} == {tuple(r) for r in search.build_index(rows).postings.select("source_id", "chunk_id", "term", "tf").collect()}


def test_ids_of_a_segment_are_stored_as_a_dictionary(spark, tmp_path):
    from quarry.plans.engine import Engine

    rows = spark.range(180_000).select(F.lit(1).alias("source_id"), F.xxhash64(F.col("id") % 18_000).alias("chunk_id"), F.lit(1).alias("gen"), F.concat(F.lit("t"), F.floor(F.col("id") / 18_000)).alias("term"), F.lit(1.0).alias("tf"))
    e = Engine(spark, str(tmp_path / "store"))
    folder = tmp_path / "store" / e._write("postings", "1", search.by_term_within(rows.coalesce(1)))
    size = sum(f.stat().st_size for f in folder.glob("*.parquet"))
    assert e._read("postings", str(folder.relative_to(tmp_path / "store"))).count() == 180_000 and size < 4 * 180_000
