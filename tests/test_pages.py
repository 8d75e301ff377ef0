"""Pages in columns against a reader in plain Python."""

import random

import page_oracle

from quarry.operators import pagetree
from quarry.sources import pages


def text():
    return random.choice(["word ", "a &amp; b ", " ", "more text &lt;x&gt; &#233;&#x1F600; ", "\n", "long words of prose here, some more. "])


def attrs():
    return random.choice(["", "", "", ' class="x menu"', " role=navigation", " title='a > b'", ' class="plain"'])


def inline(depth, link=True):
    out = ""
    for _ in range(random.randint(1, 3)):
        r = random.random()
        if depth == 0 or r < 0.5:
            out += text()
        elif r < 0.55:
            out += random.choice(["<br>", "<img src=x>", "<!-- <p> c -->"])
        else:
            t = random.choice(["b", "em", "code", "span", "strong", "i", *["a"] * link])
            href = random.choice(["", ' href="/q?a=1&amp;b=2"']) if t == "a" else ""
            out += f"<{t}{href}>{inline(depth - 1, link and t != 'a')}</{t}>"
    return out


def block(depth):
    out = ""
    for _ in range(random.randint(1, 4)):
        r = random.random()
        if r < 0.1:
            out += text()
        elif r < 0.4 or depth == 0:
            out += f"<p{attrs()}>{inline(2)}{random.choice(['</p>', '</p>', '</p>\n', '', '<b>open '])}"
        elif r < 0.5:
            out += f"<h2{attrs()}>{inline(1)}</h2>"
        elif r < 0.57:
            out += "<pre><code class='language-ts'>\n let a = 1;\n\n  b &lt; c\n</code></pre>"
        elif r < 0.6:
            out += random.choice(["<hr/>", "<script>var a='<p>';</script>", "<style>p{}</style>"])
        elif r < 0.72:
            out += "<ul>" + "".join(f"<li>{inline(1) if random.random() < 0.7 else block(depth - 1)}{random.choice(['</li>', '</li>\n', ''])}" for _ in range(random.randint(1, 3))) + "</ul>"
        else:
            t = random.choice(["div", "section", "nav", "article", "blockquote", "aside", "div", "section"])
            out += f"<{t}{attrs()}>{block(depth - 1)}</{t}>"
    return out


def page():
    return f"<html><head><title> T &amp; x - Site</title></head><body>{random.choice(['<main>%s</main>', '<article>%s</article>', '<div>%s</div>']) % block(3)}<footer>f</footer></body></html>"


FORMS = """<body><main><div class="navbarItem">gone</div><my-widget>gone</my-widget><label>gone</label><div role="tablist">gone</div>
    <h2>A <em>b</em></h2><p>one <a href="/x">link</a> <code>c</code></p><ul><li>first<ul><li>inner</li></ul></li><li>second</li></ul>
    <blockquote><p>said</p><p>more</p></blockquote><pre><code class="language-ts">let a = 1;</code></pre><img src="i.png"></main></body>"""


def quote_in_item(html):
    """Whether a quote lies in a list item: the marks of these two are set in another order."""
    read = page_oracle.Page(html).pieces
    return any(p.tag == "blockquote" and any(q.tag == "li" and q.end > k for q in read[:k]) for k, p in enumerate(read))


def test_pages_against_plain_python(spark):
    random.seed(5)
    html = dict(enumerate([page() for _ in range(120)] + [FORMS, "", "just text", "<p>x", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>t", "<main><p>a<b>b<p>c", "a < b <", "<p", "<!-- open", "<script>open"]))
    html |= {1000 + r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = pages.read_trees(spark.createDataFrame(list(html.items()), "page bigint, html string")).collect()
    assert len(rows) == len(html)
    for r in rows:
        want = page_oracle.read_page(html[r.page])
        if html[r.page] not in ("<p", "<!-- open", "<script>open") and not quote_in_item(html[r.page]):
            assert (r.raw_title, r.dense, r.rooted, r.hrefs) == want, html[r.page]


def test_tree_numbers(spark):
    html = "<main><span><nav>a<nav>bb</nav>c</nav>d</span><a>ee<b>f</a>g<ul><li>h<li>i</ul></main>"
    rows, found = pagetree.page_tree(spark.createDataFrame([(1, html)], "page int, html string"))
    got = {(r.n, r.end, r.tag, r.chars, r.linked, r.parent, r.level) for r in found.collect()}
    assert got == {
        (0, 23, "main", 7, 3, None, 0), (1, 10, "span", 1, 0, 0, 1), (2, 8, "nav", 0, 0, 1, 2), (4, 6, "nav", 0, 0, 2, 3), (11, 15, "a", 3, 3, 0, 1), (13, 15, "b", 1, 1, 11, 2),
        (17, 22, "ul", 2, 0, 0, 1), (18, 20, "li", 1, 0, 17, 2), (20, 22, "li", 1, 0, 17, 2),
    }
    assert [r.text for r in rows.filter("kind = 'text' and drops > 0").orderBy("n").collect()] == ["a", "bb", "c"]


def test_deep_and_hostile_pages(spark):
    html = [f"<main>{f'<{tag}>' * 1000}<p>deep words here</p>{'</x>' * 1000}" for tag in ("div", "b", "li", "blockquote", "span")]
    html += ["<" * 2000, "<p " + "a='x' " * 20_000 + ">words", "&" * 50_000 + "&#0;&#xD800;&#99999999;&nope;&eacute;", "<a href='" + "x" * 100_000 + "'>l</a>", None]
    rows = pages.extract_pages(spark.createDataFrame([(k, "https://e.com/a/", h) for k, h in enumerate(html)] + [(0, "https://e.com/b/", html[0])], "page_id int, url string, html string")).collect()
    assert len(rows) == len(html) + 1 and all("deep words here" in r.markdown for r in rows if r.page_id < 5)
    by = {r.page_id: r for r in rows}
    assert by[6].markdown == "words" and by[7].markdown.endswith("\ufffd\ufffd\ufffd&nope;é") and by[8].n_links == 1 and by[9].markdown == ""


def test_links_are_absolute_and_pages_keep_their_rows(spark):
    html = "<title>T | Site</title><main><h1>T</h1><p>Some <a href='x?a=1&amp;b=2'>words</a> <a href=''>none</a> <a href='javascript:x'>no</a></p></main>"
    rows = pages.extract_pages(spark.createDataFrame([(1, "https://e.com/a/", html), (2, "https://e.com/b/", html), (None, None, html)], "page_id int, url string, html string")).collect()
    assert sorted((str(r.page_id), r.title, r.links[0]) for r in rows) == [("1", "T", "https://e.com/a/x?a=1&b=2"), ("2", "T", "https://e.com/b/x?a=1&b=2"), ("None", "T", "x?a=1&b=2")]


def test_markdown_of_many_lines_stays_whole(spark):
    html = "<main><h1>T</h1>" + "".join(f"<p>words {k}</p>" for k in range(1200)) + "</main>"
    row = pages.extract_pages(spark.createDataFrame([(1, "https://e.com/a/", html)], "page_id int, url string, html string")).first()
    assert row.markdown == "\n\n".join(["# T", *[f"words {k}" for k in range(1200)]])


def test_prose_with_words_of_a_call_stays(spark):
    prose = ["the catalog in " + "many words " * 20 + "end", "a catalog in it", "those who log in " + "read on " * 20 + "here"]
    html = "<main><h1>T</h1><p>Sign up now</p>" + "".join(f"<p>{p}</p>" for p in prose) + "</main>"
    row = pages.extract_pages(spark.createDataFrame([(1, "https://e.com/a/", html)], "page_id int, url string, html string")).first()
    assert row.markdown == "\n\n".join(["# T", *prose])
