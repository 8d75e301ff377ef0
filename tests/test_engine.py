"""Functions, operators, sources and services of the engine."""

import io
import os
import sqlite3
import zipfile

import chunk_oracle
import page_oracle
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import markdown, stem, text, urls, versions
from quarry.operators import frontier, lookup, search, store, symbols, tree
from quarry.plans import engine as plans
from quarry.sources import files, manifests, pages


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, data, compare, name):
    got, want = compare(catalog.QUERIES[name](spark, data), catalog.ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("url", "want"), [
    ("https://example.com/", "https://example.com"), ("https://example.com", "https://example.com"), ("https://example.com/path/", "https://example.com/path"),
    ("https://example.com/docs/readme.md", "https://example.com/docs/readme"), ("https://example.com/search?q=test", "https://example.com/search?q=test"),
    ("https://Example.COM/Path", "https://example.com/Path"), ("https://e.com:443//a//b#f", "https://e.com/a/b"), ("ftp://example.com", None), ("javascript:void(0)", None),
])
def test_normalize(spark, url, want):
    assert one(spark, url, urls.normalize) == want


def test_scope_and_repositories(spark):
    inside = lambda u, **k: one(spark, u, lambda c: urls.in_scope(c, "https://example.com/docs", **k))
    allow = {"allowed": ["/docs", "/api"], "denied": ["/docs/internal"]}
    assert inside("https://example.com/docs/guide", **allow) and inside("https://example.com/api/reference", **allow)
    assert not inside("https://example.com/blog", **allow) and not inside("https://example.com/docs/internal/secret", **allow)
    assert not inside("https://docs.example.com/docs") and inside("https://docs.example.com/docs", subdomains=True) and not inside("https://other.com/docs")
    repo = one(spark, "https://github.com/foo/bar/tree/main/docs/", urls.repo_parts)
    assert tuple(repo) == ("foo", "bar", "main", "docs") and one(spark, "https://e.com/x", urls.repo_parts) is None
    assert one(spark, "https://e.com/docs/llms.txt", urls.is_llms_manifest) and not one(spark, "https://e.com/readme.txt", urls.is_llms_manifest)


def test_text_expressions(spark):
    assert one(spark, "\n# A title\nx", text.document_title) == "A title" and one(spark, "x\n# A", text.document_title) is None
    assert one(spark, "---\na: b\n---\n hello  world ", text.body_length) == 10
    assert one(spark, "a\n    code", text.has_code) and not one(spark, "plain", text.has_code) and one(spark, "x `y`", text.has_snippets)
    slices = {"2": "slice must be start:end", "a:b": "slice bounds must be numbers", "3:2": "slice end lies before its start", "1:401": "slice spans too many lines", "9:10": "slice starts after the last line", "0:2": None}
    for spec, error in slices.items():
        df = spark.createDataFrame([("line1\r\nline2\nline3\nline4",)], "content string")
        row = lookup.sliced(df, spec).first()
        assert row.error == error
        if error is None:
            assert row.payload == "line1\nline2"


def test_markdown_steps(spark):
    src = "# T\n\n## Contents\n- [a](#a)\n\n## Next\nText [x](http://y) ![img](z)\nTitle\n===\n`a\\_b` <wbr>\n```\nc\\_d <style>k</style>\n```\n<style>p{}</style>\n\n\n\nend\\nline"
    out = one(spark, src, markdown.sanitize)
    assert out == "# T\n\n## Next\nText x (http://y) img\n# Title\n`a_b` \n```\nc_d <style>k</style>\n```\n\n\nend\nline".replace("\n\n\n", "\n\n")
    assert one(spark, "\n[a](b)\nSign in\n# H\nx\nlog in here\ny", markdown.post_process) == "# H\nx\ny"
    assert one(spark, "Intro - Site | More", markdown.page_title) == "Intro" and one(spark, "https://x.y", markdown.page_title) is None
    df = spark.createDataFrame([('<h2>A <b>b</b></h2><p> x <a href="/u">t</a></p><li>i</li><pre><code class="language-ts">let a &lt; b;</code></pre><a href="/v"><i>w</i></a>',)], "h string")
    assert markdown.simple_markdown(df, "h", "m").first().m == "## A b\n\nx t\n- i\n\n```ts\nlet a < b;\n```\n[w](/v)"


def test_stems_match_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    for word in "running generically ponies ties hopping filing skies relational conditional electricity agreed plastered naïve Élan middlewares x1y2 as".split():
        con.execute("delete from t")
        con.execute("insert into t values (?)", (word,))
        assert [r[0] for r in con.execute("select term from v")] == [stem.term(word)]


CORPUS = [
    (1, "middleware runs running before requests", "Guide", "docs/mw.md", "a > Guide", "gh://x"), (2, "hello world middleware middleware", "Intro", "docs/intro.md", None, "gh://y"),
    (3, "unrelated text here", "Other", "docs/o.md", "a > O", "gh://z"), (4, "Élan vital next.js 15 router", "Next", "docs/n.md", "q", "gh://n"), (5, "some more plain words", "P", "p.md", "q", "gh://p"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id bigint, content string, title string, path string, context_path string, uri string").withColumn("source_id", F.lit(1).cast("long"))


@pytest.mark.parametrize(("words", "options", "want"), [
    (["middleware"], {}, [(2, -0.701998477), (1, -0.653556668)]), (["run"], {}, [(1, -2.266633448)]), (["elan"], {}, [(4, -2.133921639)]),
    (["next", "js", "15"], {}, [(4, -6.488442584)]), (["mid", "hel"], {"prefix": True, "match_all": False}, [(2, -2.881495092), (1, -0.653556668)]), (["absent"], {}, []), ([], {}, []),
])
def test_bm25_values(corpus, words, options, want):
    got = search.bm25(search.build_index(corpus), words, **options).orderBy("bm25", "chunk_id").collect()
    assert [(r.chunk_id, round(r.bm25, 9)) for r in got] == want


def test_keyword_search_relaxes_only_when_empty(corpus):
    docs = corpus.withColumn("active", F.col("chunk_id") != 5).withColumn("version_label", F.lit("1.x"))
    index = search.build_index(corpus)
    assert [r.chunk_id for r in search.keyword_search(index, docs, "middleware").collect()] == [2, 1]
    loose = search.keyword_search(index, docs, "middle unheard").collect()
    assert {r.chunk_id for r in loose} == {1, 2} and all(r.used_relaxed for r in loose)
    assert search.keyword_search(index, docs, "plain words").count() == 0 and search.keyword_search(index, docs, "middle unheard", relaxed=False).count() == 0


def test_fusion_values(spark):
    lists = spark.createDataFrame([(0, 2.0, 1, 1), (0, 2.0, 2, 2), (1, 1.0, 1, 2), (1, 1.0, 2, 3)], "list_idx int, weight double, rank int, chunk_id bigint")
    got = [(r.chunk_id, round(r.score, 10)) for r in search.fuse(lists).collect()]
    assert got == [(2, 0.0986515071), (1, 0.0827868852), (3, 0.0361290323)]
    boosts = spark.createDataFrame([("Next", "docs/next", "next", "next"), ("a", "b", None, "c")], "title string, path string, context_path string, preview string")
    assert [round(r.b, 6) for r in boosts.select(search.keyword_boost(["next"]).alias("b")).collect()] == [0.065, 0.0]
    assert round(boosts.select(search.keyword_boost(["next", "ext"]).alias("b")).first().b, 6) == 0.08


def test_signal_and_confidence(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id bigint, bm25 double, score double, used_relaxed boolean")
    assert search.strong_signal(rows((1, -0.1, 1 / 1.1, False))).first().strong
    assert not search.strong_signal(rows((1, -0.2, 1 / 1.2, False), (2, -0.1, 1 / 1.1, False))).first().strong
    assert not search.strong_signal(rows((1, -0.1, 1 / 1.1, True))).first().strong
    assert [r.confidence for r in search.with_confidence(rows((1, 0.0, 0.2, False), (2, 0.0, 0.4, False))).orderBy("chunk_id").collect()] == [0.5, 1.0]


def test_query_texts():
    assert search.normalize_query(" a\x01b \n c ") == "a b c" and search.query_tokens("next.js AND 15!") == ["next", "js", "AND", "15"]
    assert search.search_terms("How to use the Router in next.js router") == ["use", "router", "next"]
    assert search.clean_expansions(["<think>x", "y</think>", "- no", "alpha beta", "ALPHA beta", "q"], "q") == ["alpha beta"]


def test_knn_dimension_error(spark):
    v = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "chunk_id bigint, embedding array<float>")
    assert round(search.knn(v, [0.3, 0.2, 0.1], 1).first().distance, 6) == 0.285714
    with pytest.raises(Exception, match="dimension"):
        search.knn(v, [1.0], 1).collect()


def test_upsert_transitions(spark):
    cur = spark.createDataFrame([(1, "a", "1.x", 11, "u", "t", "h1", "k", True), (1, "b", "1.x", 12, "u", "t", "h1", "k", False), (1, "c", "1.x", 13, "u", "t", "h1", "k", True)],
                                "source_id bigint, path string, version_label string, document_id bigint, uri string, title string, hash string, content_type string, active boolean")
    new = spark.createDataFrame([(1, "a", "1.x", "u2", "t2", "h1", "k2"), (1, "b", "1.x", "u", "t", "h1", "k"), (1, "c", "1.x", "u", "t", "h2", "k2"), (1, "d", "1.x", "u", "t", "h9", "k")],
                                "source_id bigint, path string, version_label string, uri string, title string, hash string, content_type string")
    out = {r.path: r for r in store.upsert_documents(cur, new).collect()}
    assert {p: r.change_type for p, r in out.items()} == {"a": "same", "b": "same", "c": "changed", "d": "new"}
    assert out["b"].active and out["a"].uri == "u2" and out["a"].content_type == "k" and out["c"].content_type == "k2" and out["c"].document_id == 13
    gone = store.deactivate_missing(cur, 1, "1.x", spark.createDataFrame([], "path string"))
    assert gone.filter("active").count() == 0


def test_markdown_chunk_limits():
    long = "\n".join(f"line {k} " + "x" * 50 for k in range(120))
    chunks = chunk_oracle.markdown_chunks(long, "T", ["o/r"])
    assert len(chunks) > 2 and all(c.token_count <= 640 for c in chunks) and chunks[0].content.startswith("o/r > T\n\n")
    assert chunks[1].content.split("\n")[0] in chunks[0].content  # overlap
    assert chunk_oracle.markdown_chunks("") == []
    assert len(chunk_oracle.markdown_chunks("x" * 9000)) == 2  # Q16: what is left is overlap alone and comes out again
    one_ = chunk_oracle.markdown_chunks("# T\n```\ncode\n```", "T")
    assert len(one_) == 1 and one_[0].line_end == 4


def test_code_chunks():
    ts = "export function load(id: string) {\n  return fetch(id);\n}\n\nexport class User {\n  greet() {\n    return `hi`;\n  }\n}\n"
    got = chunk_oracle.code_chunks(ts, "src/user.ts", "typescript")
    assert {c.symbol_name for c in got} == {"load", "User"} and all("```typescript" in c.content and "src/user.ts" in c.context_path for c in got)
    py = chunk_oracle.code_chunks("class A:\n" + "\n".join(f"    def f{k}(self):\n        return {'1 + ' * 200}1" for k in range(5)), "m.py", "python")
    assert {c.symbol_type for c in py} == {"class_definition", "function_definition"}
    assert chunk_oracle.code_chunks("a = 1\n" * 900, "x.zig", "zig")[0].line_start == 1 and chunk_oracle.code_chunks("", "e.py", "python")[0].line_start is None


def test_archive_scan(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in (("repo-1/README.md", "# Hi"), ("repo-1/../evil.md", "x"), ("repo-1/a.png", "p")):
            z.writestr(name, body)
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    rows = {r.path: r for r in files.text_files(files.read_archives(spark, str(tmp_path / "*.zip"))).collect()}
    assert rows["README.md"].content == "# Hi" and rows["a.png"].reason == "extension"


def test_manifest_scan(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "package.json").write_text('{"dependencies": {"hono": "^4.0.0", "esbuild-linux-x64": "1"}}')
    (tmp_path / "notes.txt").write_text("x")
    assert [(r.manifest, r.name, r.label) for r in manifests.detected(manifests.scan(spark, str(tmp_path))).collect()] == [("app/package.json", "hono", "4.x")]


def test_crawl_is_bounded(spark):
    site = {"https://e.com": ["/docs/a", "/docs/b", "/blog"], "https://e.com/docs/a": ["/docs/c"], "https://e.com/docs/b": [], "https://e.com/docs/c": ["/docs/d"]}
    web = spark.createDataFrame([(k, ["https://e.com" + x for x in v]) for k, v in site.items()], "normalized_url string, links array<string>")
    fetch = lambda b: b.select("source_id", "normalized_url").join(web, "normalized_url", "left").select("source_id", "normalized_url", F.when(F.col("links").isNull(), "HTTP 404").alias("error"), "links")
    seeds = spark.createDataFrame([(1, "https://e.com/", 0), (1, "https://other.com/", 0)], "source_id bigint, url string, depth int")
    front, got = frontier.crawl(seeds, fetch, "https://e.com", max_depth=2, max_pages=4, denied=["/blog"])
    rows = {r.normalized_url: r.status for r in front.collect()}
    assert rows == {"https://e.com": "done", "https://e.com/docs/a": "done", "https://e.com/docs/b": "done", "https://e.com/docs/c": "done"} and got.count() == 4
    empty = frontier.status_counts(spark.createDataFrame([], frontier.SCHEMA)).first()
    assert empty.total == 0 and empty.pending is None


def test_library_lookup(spark):
    score = lambda q, n="vercel/next.js": one(spark, n, lambda c: lookup.match_score(c, q))
    assert (score("nextjs"), score("next.js"), score("vercel/next.js"), score("verceljs")) == (64, 73, 100, 0)
    assert lookup.fallback_label("16.2.1") == "16.x" and lookup.fallback_label("main") is None
    src = spark.createDataFrame([(1, "next", "vercel", "next.js", None), (2, "site", None, None, "https://e.com/docs")], "id bigint, name string, owner string, repo string, root_url string")
    assert [r.id for r in lookup.resolve_library(src, "next.js").collect()] == [1] and [r.id for r in lookup.resolve_library(src, "2").collect()] == [2]
    assert [r.id for r in lookup.infer_library(src, "gh://vercel/next.js@main/a.md").collect()] == [1] and [r.id for r in lookup.infer_library(src, "https://e.com/docs/x").collect()] == [2]


def test_version_plan(spark):
    tags = spark.createDataFrame([(1, k, t) for k, t in enumerate(["v3.1.0", "v2.0.0", "v1.5.0", "v0.9.0"])], "source_id bigint, pos int, tag string")
    src = spark.createDataFrame([(1, "next", None, "main")], "source_id bigint, version_label string, ref string, default_branch string")
    rec = spark.createDataFrame([(1, "0.x", "v0.8.0")], "source_id bigint, version_label string, ref string")
    got = {(r.label, r.ref) for r in versions.version_plan(tags, src, rec).collect()}
    assert got == {("3.x", "v3.1.0"), ("2.x", "v2.0.0"), ("1.x", "v1.5.0"), ("0.x", "v0.8.0"), ("next", "main")}


def test_page_extraction():
    html = "<html><head><title>Test Page - Site</title></head><body><nav>menu</nav><main><h1>Test Page</h1><p>Words <b>here</b>.</p><pre><code class='language-python'>print(1)</code></pre></main><footer>f</footer></body></html>"
    title, dense, rooted, _ = page_oracle.read_page(html)
    assert title == "Test Page - Site" and "```python\nprint(1)\n```" in rooted and "# Test Page" in rooted and "menu" not in rooted and "f" not in rooted.split()
    assert page_oracle.read_page("")[1:] == ("", "", [])


def test_trees_begin_with_the_readme(spark):
    rows = [(1, "README.md"), (1, "docs/intro.md"), (2, "b.ts"), (2, "README.md")]
    out = {r.source_id: r.tree for r in tree.repo_trees(spark.createDataFrame(rows, "source_id int, path string")).collect()}
    assert "docs/" in out[1] and out[2].startswith("├── README.md")


def test_page_markdown_forms():
    html = """<body><main><div class="navbarItem">gone</div><my-widget>gone</my-widget><label>gone</label><div role="tablist">gone</div>
    <h2>A <em>b</em></h2><p>one <a href="/x">link</a> <code>c</code></p><ul><li>first<ul><li>inner</li></ul></li><li>second</li></ul>
    <blockquote><p>said</p><p>more</p></blockquote><pre><code class="language-ts">let a = 1;</code></pre><img src="i.png"></main></body>"""
    _, dense, rooted, links = page_oracle.read_page(html)
    assert rooted == "## A _b_\n\none [link](/x) `c`\n\n- first\n\n  - inner\n- second\n\n> said\n>\n> more\n\n```ts\nlet a = 1;\n```"
    assert "gone" not in rooted + dense and links == ["/x"] and "  - inner" in rooted and "> said" in rooted


def test_markdown_responses(spark):
    rows = [(1, "https://e.com/a", "<p>html</p>", None), (2, "https://e.com/b.md", None, "# Title\n\nText with [c](/c).\n\n```\nx\n```"), (3, "https://e.com/c", "<main><h1>T</h1><p>text</p></main>", "<!doctype html><p>no</p>")]
    out = {r.page_id: r for r in pages.read_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, markdown string")).collect()}
    assert out[2].title == "Title" and out[2].links == ["https://e.com/c"] and out[2].markdown.startswith("# Title") and out[3].markdown == "# T\n\ntext" and len(out) == 3


def test_llms_page_targets(spark):
    text = "# T\n- [A](https://e.com/a): x\n- docs/b\n- two words\n| - c |\nplain\n- https://e.com/d"
    row = spark.createDataFrame([(text, "https://e.com/docs/llms.txt")], "c string, u string").select(files.manifest_targets("c", "u").alias("t"), urls.is_llms_manifest(F.col("u")).alias("m")).first()
    assert row.t == ["https://e.com/a", "https://e.com/docs/docs/b", "https://e.com/d"] and row.m


COLS = "path string, uri string, title string, content string, content_type string"


def page_row(path, title, content):
    return (path, f"gh://demo/repo@main/{path}", title, content, "text/markdown")


def test_stored_index_follows_the_store(spark, tmp_path):
    """After every ingest the stored index gives what an index built from the chunks gives, and only changed tables are written."""
    e = plans.Engine(spark, str(tmp_path / "store"))
    e.SEGMENTS = 2
    bodies = ["alpha beta gamma", "beta gamma delta delta", "gamma epsilon words"]
    for step in range(4):
        rows = [page_row(f"d{k}.md", f"T{k}", f"{b} step{step if k == 1 else 0}") for k, b in enumerate(bodies)]
        e.ingest(spark.createDataFrame(rows, COLS), 1, "1.x", ["r"])
        e.ingest(spark.createDataFrame([page_row("other.md", "O", "beta elsewhere")], COLS), 2, "1.x", ["r"])
        lib = e.library()
        built = search.build_index(plans.indexed_texts(e.table("chunks")))
        for words in (["beta"], ["gamma", f"step{step}"], ["step0"]):
            got, want = (sorted((r.chunk_id, round(r.bm25, 9)) for r in search.bm25(i, words).collect()) for i in (lib.index, built))
            assert got == want, (step, words)
    n, state = e._state()
    assert len(state["postings"]["1"]) <= 2 and n >= 8 and all("part=2" in f for f in state["documents"]["2"])
    before = state["blobs"]["all"]
    e.clear_embeddings()
    assert e._state()[1]["blobs"]["all"] == before  # not written again
    assert e.vacuum(keep=1) > 0 and e.search("beta", "word").count() == 3
    e.remove_source(2)
    assert e.search("beta", "word").count() == 2 and e.search("elsewhere", "word").count() == 0


def test_commits_append_chunks_and_leave_no_scratch(spark, tmp_path):
    """A commit writes the chunks of what is new or changed only, readers see the live ones, and nothing stays in the shared folder."""
    from quarry.plans.shared import shared_folder

    e = plans.Engine(spark, str(tmp_path / "store"))
    shared = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    files_ = lambda d: {(p, r) for p, _, names in os.walk(tmp_path / "store" / d) for r in names if r.endswith(".parquet")}
    long = lambda k, word: f"## A{k}\n" + f"{word} text of a section\n" * 200 + "## B\nthe end"
    rows = [page_row(f"d{k}.md", f"T{k}", long(k, "first")) for k in range(6)]
    e.ingest(spark.createDataFrame(rows, COLS), 1, "1.x", ["r"])
    whole = e.table("chunks").count()
    rows[2] = page_row("d2.md", "T2", "## A2\nshorter than before")
    rows += [page_row("n.md", "N", "newly here"), page_row("x.py", "X", "def f(a):\n    return a\n"), page_row("x.py", "X", "def f(a):\n    return a\n")]
    e.ingest(spark.createDataFrame(rows[1:], COLS), 1, "1.x", ["r"])
    assert set(os.listdir(shared)) == before
    state = e._state()[1]
    assert len(state["chunks"]["1"]) == 2 and e._read("chunks", state["chunks"]["1"][1]).count() == 3 and files_("chunks/v=1")
    names = {r.path: r.document_id for r in e.table("documents").collect()}
    live = e.table("chunks", 1)
    assert live.columns == e._read("chunks", *state["chunks"]["1"]).columns and live.count() == whole - whole // 6 + 3 == live.select("chunk_id").distinct().count()
    found = {(r.document_id, r.content.split("\n")[-1]) for r in live.filter(F.col("document_id") == names["d2.md"]).collect()}
    assert found == {(names["d2.md"], "shorter than before")}
    assert [(r.doc_path, r.doc_title, r.language) for r in live.filter("chunk_type = 'code'").collect()] == [("x.py", "X", "python")]
    assert {r.chunk_id for r in live.collect()} == {r.chunk_id for r in e.table("lengths").collect()}
    want = {tuple(r) for r in live.collect()}
    e.merge_postings(1)
    assert {tuple(r) for r in e.table("chunks").collect()} == want and len(e._state()[1]["chunks"]["1"]) == 1
    assert e.search("newly", "word").count() == 1 and e.table("blobs").count() == 9
    assert e.cleanup().first().documents == 1 and e.table("chunks").count() == len(want) - whole // 6


def test_repeated_paths_and_writers(spark, tmp_path):
    from pyspark.errors import AnalysisException

    e = plans.Engine(spark, str(tmp_path / "store"))
    e.ingest(spark.createDataFrame([page_row("a.md", "A", "one"), page_row("a.md", "A", "two")], COLS), 1, "1.x", ["r"])
    assert e.table("documents").count() == 1 and e.table("chunks").count() == 1
    state = e._state()
    e._state = lambda: (state[0] - 1, state[1])  # a writer that has not seen the last commit
    with pytest.raises(AnalysisException):
        e._commit({("blobs", "all"): spark.createDataFrame([], e.TABLES["blobs"])})


def test_relaxed_terms_and_strong_signal(spark, tmp_path):
    e = plans.Engine(spark, str(tmp_path / "store"))
    rows = [page_row("a.md", "A", "routers and middleware"), page_row("b.md", "B", "the way to do it how"), page_row("c.md", "C", "caching layers")]
    e.ingest(spark.createDataFrame(rows, COLS), 1, "1.x", ["r"])
    lib = e.library()
    found = search.keyword_search(lib.index, lib.rows(), "how to use the router")
    assert [(r.path, r.used_relaxed) for r in found.collect()] == [("a.md", True)]
    assert search.keyword_search(lib.index, lib.rows(), "how to the").filter("used_relaxed").count() == 0
    asked = []
    more = lambda q: asked.append(q) or ["caching"]
    assert {r.path for r in e.search("routers", "hybrid", alternates=more).collect()} == {"a.md", "c.md"} and asked == ["routers"]
    lib.strong_score = lib.strong_gap = 0.0
    assert {r.path for r in plans.hybrid_search(lib, "routers", more).collect()} == {"a.md"} and len(asked) == 1


def test_embedding_options(spark, tmp_path):
    e = plans.Engine(spark, str(tmp_path / "store"))
    for source in (1, 2):
        e.ingest(spark.createDataFrame([page_row(f"{source}.md", "A", "some words " * 50)], COLS), source, "1.x", ["r"])
    size = F.pandas_udf(lambda s: s.map(lambda x: [float(len(x)), 1.0]), "array<float>")
    e.embed("m", size, source_id=1, most_tokens=10, count_tokens=lambda c: F.size(F.split(c, " ")))
    row = e.table("vectors").collect()
    assert len(row) == 1 and row[0].source_id == 1 and row[0].embedding[0] < 80
    assert e.table("chunks", 1).first().token_count > 90
    e.embed("m", size)
    assert e.table("vectors").count() == 2
    e.embed("m", size, source_id=1, force=True)
    assert e.table("vectors").count() == 2 and e.table("vectors", 1).first().embedding[0] > 80
    with pytest.raises(Exception, match="dimension"):
        e.embed("m", F.pandas_udf(lambda s: s.map(lambda x: [1.0]), "array<float>"), force=True)


def test_archive_sync(spark, tmp_path):
    e = plans.Engine(spark, str(tmp_path / "store"))
    source = e.add_source("demo/repo", docs="docs", tag="v1.2.0")
    files_ = [("docs/a.md", "# A\n\n```js\nlet a\n```"), ("docs/plain.md", "no code at all"), ("docs/logo.png", "x"), ("src/x.ts", "export const x = 1")]
    members = lambda rows: spark.createDataFrame([("z", p, len(c), bytearray(c.encode())) for p, c in rows], "archive string, path string, size bigint, content binary")
    first = e.sync_archive(source, members(files_), "1.x", "abc1234").first()
    assert (first.updated, first.unchanged) == (1, 0) and first.skipped >= 1
    got = e.get("docs/a.md", library="repo").first()
    assert got.uri == "gh://demo/repo@v1.2.0/docs/a.md" and e.get("gh://demo/repo@v1.2.0/docs/a.md").first().title == "A"
    assert e.sync_archive(source, members([]), "1.x", "abc1234").first().updated == 0 and e.table("documents").filter("active").count() == 1
    tree_ = e.table("source_versions").first().tree_hash
    again = e.sync_archive(source, members([(p, c + "\nmore") for p, c in files_]), "1.x", "def5678").first()
    assert again.updated == 1 and e.table("source_versions").first().tree_hash != tree_ and e.table("sources").first().last_commit == "def5678"
    with pytest.raises(ValueError, match="no library"):
        e.get("docs/a.md", library="nothing")
    with pytest.raises(Exception):
        e.sync_archive(source, members(files_).drop("content"), "1.x", "fff0000")
    assert e.table("sources").first().last_error and e.table("sources").first().last_commit == "def5678"


def test_pages_into_the_store(spark, tmp_path):
    e = plans.Engine(spark, str(tmp_path / "store"))
    source = e.add_source("https://e.com/docs")
    body = "<main><h1>Guide</h1><p>" + "useful words " * 40 + "</p><pre><code>run()</code></pre></main>"
    rows = [(1, "https://e.com/docs/guide", body), (2, "https://e.com/docs/tiny", "<main><p>x</p></main>"), (3, "https://e.com/blog", body)]
    out = {r.page_id: r.reason for r in e.ingest_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), source).collect()}
    assert out == {1: None, 2: "too small", 3: "out of scope"} and [r.doc_path for r in e.search("useful", "word").collect()] == ["docs/guide.md"]


def test_symbols_of_end_blocks(spark):
    ruby = "module A\n  class B\n    def c?(x)\n      if x\n        1\n      end\n    end\n    def d = 2\n    def e; 3 end\n  end\nend\n"
    lua = "local function f(a)\n  if a then\n    return 1\n  end\nend\nfunction m.g()\nend\n"
    bash = "run() {\n  echo 1\n}\nfunction go {\n  run\n}\n"
    files = spark.createDataFrame([(1, "ruby", ruby), (2, "lua", lua), (3, "bash", bash)], "document_id bigint, language string, content string")
    rows = sorted((r.document_id, r.line_start, r.line_end, r.symbol_type, r.symbol_name) for r in symbols.symbols(files).collect())
    assert rows == [(1, 0, 10, "module", "A"), (1, 1, 9, "class", "B"), (1, 2, 6, "method", "c?"), (1, 8, 8, "method", "e"), (2, 0, 4, "function_declaration", "f"), (2, 5, 6, "function_declaration", "m.g")]
    pairs = symbols.brackets(files.filter("document_id = 3")).collect()  # shells have no symbols, but brackets
    assert sorted((bash[r.opened], bash[r.closed], r.depth) for r in pairs) == [("{", "}", 1)] * 2


def test_crawl_goes_on(spark):
    pages_ = lambda rows: rows.select("source_id", "normalized_url", F.lit(None).cast("string").alias("error"), F.array(F.concat("url", F.lit("/n"))).alias("links"))
    seeds = spark.createDataFrame([(1, "https://e.com", 0)], "source_id bigint, url string, depth int")
    before, _ = frontier.crawl(seeds, pages_, "https://e.com", max_depth=1, max_pages=10)
    flight = before.withColumn("status", F.when(F.col("depth") == 1, "fetching").otherwise(F.col("status"))).withColumn("attempts", F.lit(1))
    after, seen = frontier.crawl(seeds, pages_, "https://e.com", max_depth=2, max_pages=10, frontier=flight)
    assert {r.normalized_url for r in seen.collect()} == {"https://e.com/n", "https://e.com/n/n"} and after.filter("status <> 'done'").count() == 0


def test_legacy_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.md", "1.x", "h1", 7), (2, "b.md", None, "h2", 8)], "source_id bigint, path string, version_label string, hash string, document_id bigint")
    blobs = spark.createDataFrame([("h1", "alpha text"), ("h2", "beta text"), ("h3", "unused")], "hash string, content string")
    e = plans.Engine(spark, str(tmp_path / "old"))
    e.ingest(spark.createDataFrame([page_row("a.md", "A", "alpha text")], COLS), 1, "1.x", ["r"])
    chunks = e.table("chunks").withColumn("document_id", F.lit(7).cast("long"))
    versions_ = spark.createDataFrame([(1, "1.x", "c1")], "source_id bigint, version_label string, commit_sha string")
    new = plans.Engine(spark, str(tmp_path / "new"))
    with pytest.raises(Exception):
        new.import_legacy({"documents": docs, "blobs": blobs.select(F.col("hash"), F.raise_error(F.lit("broken")).alias("content"))})
    assert new._state() == (0, {})
    new.import_legacy({"documents": docs, "blobs": blobs, "chunks": chunks, "source_versions": versions_})
    assert new.table("documents", 1).count() == 1 and new.table("blobs").count() == 2 and new.table("source_versions").first().etag is None
    assert [r.doc_path for r in new.search("alpha", "word").collect()] == ["a.md"]
    with pytest.raises(ValueError, match="not empty"):
        new.import_legacy({"documents": docs, "blobs": blobs})


def test_seeds_config_and_lines(spark, tmp_path):
    from quarry.plans import services

    rows = spark.createDataFrame([(1, "github", "o/r", "o", "r", "docs", None), (2, "web", "site", None, None, None, "https://e.com/docs")], "id bigint, kind string, name string, owner string, repo string, docs_path string, root_url string")
    full = services.shaped(rows, services.SOURCES)
    listed = files.read_seeds(spark, services.seed_yaml(full))
    assert sorted((r.name, r.type) for r in listed.collect()) == [("o/r", "github"), ("site", "web")]
    path = tmp_path / "c.yml"
    path.write_text("strong_score: 0.5\nother: 1\n")
    assert services.Config.read(str(path)).strong_score == 0.5 and services.Config.read(str(tmp_path / "none.yml")).strong_gap == 0.15
    found = spark.createDataFrame([(0.987, "T", None, "a.md", None, "pre", 3, 4, 1, 2)], "confidence double, title string, doc_title string, doc_path string, doc_uri string, preview string, line_start int, line_end int, document_id bigint, chunk_id bigint")
    assert services.result_lines(found).first().line == "0.99  T  a.md\npre"
    assert '"slice":"3:4","confidence":0.99' in plans.result_items(found).first().json
    assert frontier.backoff_seconds(F.lit(1)) is not None and spark.range(5).select(frontier.backoff_seconds(F.col("id")).alias("s")).agg(F.max("s"), F.min("s")).first()[:2] == (120.0, 15.0)


def test_commits_of_archives(spark):
    row = lambda h, d, u, p: spark.createDataFrame([(h, d, u, p)], "h string, d string, u string, p string").select(files.commit_of(F.col("h"), F.col("d"), F.col("u"), F.col("p")).alias("c")).first().c
    assert row("abc1234", None, None, "old") == "abc1234" and row(None, "repo-deadbeef1", None, "old") == "deadbeef1" and row("x", "repo", "https://x/0123456789.zip", "old") == "0123456789" and row(None, None, None, "old") == "old"


def test_engine_round_trip(spark, tmp_path):
    e = plans.Engine(spark, str(tmp_path / "store"))
    cols = "path string, uri string, title string, content string, content_type string"
    doc = lambda p, t, c: (p, f"gh://demo/repo@main/{p}", t, c, "text/markdown")
    rows = [doc("docs/intro.md", "Intro", "Hello world\n```ts\nlet a = 1;\n```"), doc("docs/next.md", "Next", "Next release notes about routers")]
    e.ingest(spark.createDataFrame(rows, cols), 1, "1.x", ["demo/repo"])
    assert [r.doc_path for r in e.search("hello", "word").collect()] == ["docs/intro.md"]
    assert [r.doc_path for r in e.search("routing release", "hybrid").collect()] == ["docs/next.md"]
    assert e.search("hello", "word", version="9.x").count() == 0 and e.get("docs/intro.md", "1:1").first().payload == "Hello world"
    embed = F.pandas_udf(lambda s: s.map(lambda x: [float(len(x)), 1.0, 0.5]), "array<float>")
    e.embed("stand-in", embed)
    assert e.search("hello", "vector", embed=lambda q: [1.0, 1.0, 0.5]).count() == 2
    before = {r.path: r.document_id for r in e.table("documents").collect()}
    e.ingest(spark.createDataFrame([doc("docs/intro.md", "Intro", "Hello again")], cols), 1, "1.x", ["demo/repo"])
    now = {r.path: r for r in e.table("documents").collect()}
    assert not now["docs/next.md"].active and now["docs/intro.md"].document_id == before["docs/intro.md"]
    assert e.search("world", "word").count() == 0 and e.search("again", "word").count() == 1
    counts = e.cleanup().first()
    assert (counts.documents, counts.chunks) == (1, 1) and e.status().first().documents == 1
    with pytest.raises(ValueError, match="mode"):
        e.search("x", "nonsense")


def test_streaming_ingest(spark, tmp_path):
    from quarry.streaming import incremental

    e = plans.Engine(spark, str(tmp_path / "store"))
    land = lambda k, c: spark.createDataFrame([(1, "1.x", "a.md", "u", "A", c, "text/markdown")], incremental.LANDED).write.mode("append").parquet(str(tmp_path / "land"))
    for k, body in enumerate(["first text", "second text"]):
        land(k, body)
        incremental.ingest_stream(spark, e, str(tmp_path / "land"), str(tmp_path / "cp"), ["d"]).awaitTermination()
        assert e.search(body.split()[0], "word").count() == 1
    assert e.search("first", "word").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
