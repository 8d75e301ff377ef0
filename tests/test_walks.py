"""Walks over links, trees and hash trees."""

import hashlib
import random
import time

from quarry.functions import stem
from quarry.operators import closure, tree
from quarry.plans import services
from quarry.sources import files


def xml(*nested, pages=()):
    if pages:
        return "<urlset>" + "".join(f"<url><loc>{p}</loc></url>" for p in pages) + "</urlset>"
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in nested) + "</sitemapindex>"


def test_sitemaps_of_ten_levels_and_cycles(spark):
    rows = [(f"s{k}", xml(f"s{k + 1}", f"s{k // 2}", f"p{k}")) for k in range(11)] + [(f"p{k}", xml(pages=[f"u{k}", "u0"])) for k in range(11)]
    rows += [("s11", xml(pages=["deep"])), ("other", xml(pages=["never"])), ("p3", "not a sitemap"), (None, None)]
    content = spark.createDataFrame(rows, "url string, content string")
    start = spark.createDataFrame([("s0",), ("s0",), (None,), ("missing",)], "url string")
    read = lambda depth: {r.url for r in files.read_sitemaps(start, content, depth).collect()}
    assert read(None) == {f"u{k}" for k in range(11)} | {"deep"}
    assert read(10) == {f"u{k}" for k in range(10)} | {"u0"} and read(0) == set() and read(1) == {"u0"}


def test_levels_are_the_fewest_steps(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5), (8, 9), (None, 7), (5, None)], "source int, target int")
    start = lambda *nodes: spark.createDataFrame([(n,) for n in nodes], "node int")
    walk = lambda depth, *nodes: sorted((r.node, r.level) for r in closure.reached(start(*nodes), links, depth).collect())
    assert walk(None, 1) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)] and walk(1, 1, 8) == [(1, 0), (2, 1), (3, 1), (8, 0), (9, 1)] and walk(None) == []


def test_long_runs_of_y_stem(spark):
    start = time.monotonic()
    assert stem.porter("y" * 20_000) and stem.porter("happy") == "happi" and stem.porter("sky") == "sky" and stem.porter("yyyed")
    assert time.monotonic() - start < 5

    def plain(word, k):
        return word[k] not in "aeiou" and not (word[k] == "y" and k > 0 and plain(word, k - 1))

    for word in ("y", "yy", "ayy", "byyy", "yayby", "ayyyyb", "syzygy"):
        assert [stem._consonant(word, k) for k in range(len(word))] == [plain(word, k) for k in range(len(word))]
        shape = "".join("c" if plain(word, k) else "v" for k in range(len(word)))
        assert stem._shape(word) == "".join(c for k, c in enumerate(shape) if k == 0 or shape[k - 1] != c)


def drawn(paths):
    """The tree by recursion."""
    root = {}
    for path in paths:
        at = root
        *folders, name = [p for p in path.split("/") if p] or [path]
        for f in folders:
            at = at.setdefault((f, True), {})
        at.setdefault((name, False), {})

    def order(item):
        (name, folder), _ = item
        low = name.lower()
        return (0 if low.startswith("readme") else 1 if low in tree.IMPORTANT else 2 if folder else 3, low, name, folder)

    def walk(node, indent):
        for k, ((name, folder), below) in enumerate(items := sorted(node.items(), key=order)):
            last = k == len(items) - 1
            yield f"{indent}{'└── ' if last else '├── '}{name}{'/' if folder else ''}"
            yield from walk(below, indent + ("    " if last else "│   "))

    return "\n".join(walk(root, ""))


def test_trees_against_recursion(spark):
    random.seed(12)
    names = ["a", "B", "b", "README.md", "readme", "go.mod", "LICENSE", "é", "z.ts", "Z"]
    rows = [(s, "/".join(random.choices(names, k=random.randint(1, 5))) + random.choice(["", "", "x"])) for s in range(4) for _ in range(60)]
    rows += [(9, "//a//b/"), (9, "/"), (9, None), (10, "a"), (10, "a/b"), (11, "d/" * 60 + "f")]
    got = {r.source_id: r.tree for r in tree.repo_trees(spark.createDataFrame(rows, "source_id int, path string")).collect()}
    for s in {s for s, _ in rows}:
        assert got[s] == drawn([p for k, p in rows if k == s and p]), s


def test_a_folder_of_many_files_is_spread(spark):
    files_ = spark.range(20_000).selectExpr("1 as source_id", "concat('docs/', id, '.md') as path")
    lines = tree.tree_lines(files_)
    assert lines.count() == 20_001 and lines.filter("line = '└── docs/'").count() == 1 and lines.filter("line like '    └── %'").count() == 1
    assert "Window" not in lines._jdf.queryExecution().executedPlan().toString()


def hash_by_hand(rows, leaf):
    digest = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    nodes = {}
    leaves = [hashlib.sha256(f"{p} {h}".encode()).hexdigest() for p, h in rows]
    depth = next(d for d in range(65) if len(rows) <= leaf * 16**d)
    for x in leaves:
        nodes.setdefault(x[:depth], []).append(x)
    for level in range(depth, 0, -1):
        above = {}
        for at, held in nodes.items():
            above.setdefault(at[: level - 1], []).append(f"{at} {digest(held)}")
        nodes = above
    return digest(nodes.get("", []))


def test_hash_tree(spark):
    for count, leaf in ((0, 256), (1, 256), (256, 256), (257, 256), (2000, 4)):
        rows = [(f"docs/{k}.md", str(k % 7)) for k in range(count)]
        got = [services.tree_hash(spark.createDataFrame(order, "path string, hash string"), leaf).first()[0] for order in (rows, rows[::-1])]
        assert got == [hash_by_hand(rows, leaf)] * 2
    frame = spark.createDataFrame([(f"docs/{k}.md", "1") for k in range(300)], "path string, hash string")
    assert services.tree_hash(frame).first() != services.tree_hash(frame.filter("path <> 'docs/7.md'")).first()
