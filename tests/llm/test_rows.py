"""Operators that judge one row at a time: secrets, quality, personal data, html."""

import hashlib
import random
import re

import numpy as np
from quarry.llm import common, htmltext, pii, quality, secretscan


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = {}
    for k in range(len(words) - 7):
        count.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for at in count.values() if len(at) > 1 for k in at for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_quality_base_columns(spark, data, odd):
    docs = common.table(spark, data, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted([(d is None, d or 0, *brute_quality(t)) for d, t in texts])
    rows = quality.quality_scan(docs.distinct(), quality.all_content()).collect()
    got = sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows])
    assert got == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) for r in rows)


def test_quality_tells_labels_apart(spark, data):
    docs, labels = common.table(spark, data.replace("sf0.001", "sf0.01"), "documents"), common.table(spark, data.replace("sf0.001", "sf0.01"), "labels")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    chain = quality.fit(docs, train)
    rows = quality.quality_scan(docs.join(held, "doc_id", "left_semi"), chain).join(held, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    kept = quality.quality_filter(docs, chain)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_lines_of_a_mixed_document_are_told_apart(spark, data):
    """Half prose, half shouted or symbol lines: the chain switches where the text does, and transitions allow it."""
    d = data.replace("sf0.001", "sf0.01")
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    chain = quality.fit(docs, labels)
    prose = [x for r in docs.join(labels.filter("quality = 1"), "doc_id").filter("lang = 'en'").limit(12).collect() for x in r.text.split("\n") if len(x.split()) > 15][:30]
    junk = [" ".join(w.upper() + "!!" for w in x.split()) for x in prose[:6]] + [" ".join(w + "$$$" for w in x.split()) for x in prose[6:12]]
    for lines, want in ((prose + junk, [0] * 30 + [1] * 12), (junk + prose, [1] * 12 + [0] * 30), (prose[:15] + junk + prose[15:], [0] * 15 + [1] * 12 + [0] * 15)):
        found = quality.analyse("\n".join(lines))
        path = chain.decode(found.features)
        assert sum(a == b for a, b in zip(path, want, strict=True)) >= 40 and 0.2 < chain.content_share(found) < 0.95


def test_training_pieces_are_bounded():
    found = quality.analyse("\n".join(f"line {k} of the text" for k in range(5000)))
    own = quality.pieces(found, 256)
    assert [len(f) for f, _ in own] == [64] * 4 and own[0][0] == found.features[:64]
    assert [len(f) for f, _ in quality.pieces(quality.analyse("a\nb"), 256)] == [2]


def test_line_features_read_all_words():
    """Boilerplate and lower-case words count wherever they stand in a line."""
    features = lambda line: set(quality.line_features(line, line.split(), False))
    prose = "some words of a text " * 10
    assert not {18, 20} & features(prose) and 20 in features(prose + "subscribe") and 18 in features(prose + "subscribe now share login " * 10)
    caps = "WORDS " * 50
    assert not {19, 21} & features(caps) and 21 in features(caps + "small") and 19 in features(caps + "small words " * 20)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = quality.Chain(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = [[0, int(rng.integers(1, 20))] for _ in range(8)]

    def score(path):
        s = chain.start[path[0]] + sum(chain.emit[f, path[0]] for f in features[0])
        return s + sum(chain.move[a, b] + sum(chain.emit[f, b] for f in own) for a, b, own in zip(path, path[1:], features[1:]))

    best = max(score([k >> j & 1 for j in range(8)]) for k in range(256))
    assert abs(score(chain.decode(features)) - best) < 1e-9


def test_quality_without_labels_keeps_prose(spark, odd, none):
    assert quality.fit(odd, spark.createDataFrame([], "doc_id bigint, quality int")).content_share(quality.analyse("some words here")) == 1.0
    assert quality.quality_scan(none, quality.all_content()).count() == 0


def spans(found):
    return [] if not found else [tuple([k, int(a), int(b)]) for k, a, b in (x.split(":") for x in found.split(","))]


def brute_spans(text, rules):
    """Leftmost non-overlapping matches of the contract's own patterns, those that fail their test dropped; (start, kind order, end, kind)."""
    out = []
    for k, (kind, pattern, holds) in enumerate(rules):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if holds(m)]
    return sorted(out)


def luhn_holds(digits):
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


n_digits = lambda m: re.sub("[^0-9]", "", m[0])
SECRET_RULES = [
    ("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]
PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n_digits(m)) <= 19 and luhn_holds(n_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n_digits(m)) <= 15),
]


def check_base(rows, texts, rules):
    assert len(rows) == len(texts)
    want = sorted((str(d), tuple(sum(s[3] == k for s in found) for k, *_ in rules), hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in found).encode()).hexdigest()) for d, t in texts for found in [brute_spans(t or "", rules)])
    assert sorted((str(r.doc_id), tuple(r[f"n_{k}"] for k, *_ in rules), r.base_sha256) for r in rows) == want
    for r in rows:
        assert r.n_spans == len(spans(r.spans)) >= sum(r[f"n_{k}"] for k, *_ in rules)


def tricky(spark, data, odd, extra):
    docs = common.table(spark, data, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rng = random.Random(8)
    made = [(1000 + k, " ".join(rng.choice(extra) + rng.choice(["", "x", ".", "-", " 1", "\n"]) for _ in range(rng.randint(1, 12)))) for k in range(150)]
    return docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))


def test_secret_base_columns_against_brute_force(spark, data, odd):
    extra = ["password: hunter2hunter2", "API_KEY='abcdefgh", "token=secret:longvalue1", "AKIAABCDEFGHIJKL", "AKIA", "0123456789abcdef" * 2, "deadbeef" * 5, "passwd =short", "Secret==========", "é", "apikey:\t12345678"]
    docs = tricky(spark, data, odd, extra)
    check_base(secretscan.secret_scan(docs).collect(), [tuple(r) for r in docs.collect()], SECRET_RULES)


def test_pii_base_columns_against_brute_force(spark, data, odd):
    extra = ["a.b@c.d", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4539148803436467", "4539 1488 0343 6467", "123456789012", "+1 (017) 555-7713", "+12", "+49 30 1234567890123456", "é@ü.de", "000.0.0.0"]
    docs = tricky(spark, data, odd, extra)
    check_base(pii.pii_scan(docs).collect(), [tuple(r) for r in docs.collect()], PII_RULES)


def test_secret_base_spans():
    t = 'x password: "hunter2hunter2" token=short API-KEY api_key = ABCDEFGH1 token=secret:longvalue1 AKIAABCDEFGHIJKL AKIAX ' + "0123456789abcdef" * 2 + "é ſecret=12345678"
    got = [(k, t[a:b]) for a, b, k in sorted(secretscan.base_spans(t))]
    assert ("assign", 'password: "hunter2hunter2') in got and ("assign", "api_key = ABCDEFGH1") in got
    assert ("access", "AKIAABCDEFGHIJKL") in got and ("hex", "0123456789abcdef" * 2) in got
    assert not any("longvalue1" in s or "short" in s or "ſ" in s for _, s in got)


def test_guess_costs_order():
    cost = secretscan.guess_cost
    assert cost("password") < cost("password1") < cost("P@ssw0rd1990!x") < cost("x7#Kp9!qLz2w")
    assert cost("qwertyuiop") < cost("qpwoeirutylk") and cost("abababab") < cost("abcqzxvk") and cost("19900412") < cost("84732961")
    assert cost("aaaa" * 5000) < 10 and cost("") == 0


def test_repetitions_against_brute_force():
    rng = random.Random(6)
    for k in range(120):
        value = "".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(0, 24)))
        want = set()
        for unit in range(1, len(value) // 2 + 1):
            same = [value[j] == value[j + unit] for j in range(len(value) - unit)]
            j = 0
            while j < len(same):
                e = j
                while e < len(same) and same[e]:
                    e += 1
                if e - j >= unit:
                    want.add((j, e + unit, unit))
                j = max(e, j + 1)
        least = {(s, e, u) for s, e, u in want if not any(u % d == 0 and d < u and a <= s and e <= b for a, b, d in want)}
        assert set(secretscan.repetitions(value)) == least, value


def test_guess_cost_spans_of_any_length():
    cost, unit = secretscan.guess_cost, "kT9#vQz!2mXw7Rp"
    assert cost(unit * 3) < cost(unit) + 1 and cost("dragon7dragon7") < cost("dragon7") + 0.5
    assert cost("qazxdr") < cost("qzpmal") and cost("zaqwsxcde") < 9 and cost("asdfghjkl;'") < 5.5
    assert cost("xqwertyuiop[]") - cost("x") < 6 and cost("lkjhgfdsapoiuyt") < 8.5


def test_recall_of_planted_secrets():
    """Random values in credential contexts are found; words, dates and walks in the same contexts are not."""
    rng = random.Random(12)
    contexts = ["password: {}", "pwd = {}", "the passphrase is {} for now", 'auth => "{}"', "access_key={}", "my credentials: {}, keep them", "private-key = {}"]
    strong = ["".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%") for _ in range(rng.randint(11, 30))) for _ in range(300)]
    weak = ["sunshine", "dragon1999", "qwertyuiop", "password123", "19900412", "letmein!", "football7", "aaaaaaaaaaaa", "abcdefgh", "Monkey12", "p4ssw0rd", "asdfghjkl"] * 10
    hits = lambda values: sum(bool(secretscan.value_spans(t := rng.choice(contexts).format(v), [], 9.0)) and v in t for v in values) / len(values)
    assert hits(strong) >= 0.95 and hits(weak) <= 0.02


def brute_cost(value):
    """Best over all cuts into single characters and common words, for values of those alone."""
    best = [0.0] + [1e9] * len(value)
    for k in range(len(value)):
        best[k + 1] = min(best[k + 1], best[k] + np.log10(secretscan.class_size(value[k])))
        for w, rank in secretscan.WORD_RANK.items():
            if value.startswith(w, k):
                best[k + len(w)] = min(best[k + len(w)], best[k] + np.log10(rank + 1))
    return best[-1]


def test_guess_cost_against_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        value = "".join(rng.sample(["dragon", "monkey", "zqv", "kxw", "tiger"], rng.randint(1, 4)))
        assert abs(secretscan.guess_cost(value) - brute_cost(value)) < 1e-9


def test_secret_scan_rows(spark, odd, none):
    text = "the password is X9#kd!Qz81m and pwd: qwertyuiop"
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, text)], "doc_id bigint, text string"))
    rows = {r.doc_id: r for r in secretscan.secret_scan(docs).collect()}
    assert len(rows) == 11 and rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [text[a:b] for _, a, b in spans(rows[50].spans)] == ["X9#kd!Qz81m"] and rows[50].n_value == 1
    assert secretscan.secret_scan(none).count() == 0


def test_secret_values_of_letters_only():
    """The guess cost alone decides: random letters are found, words of prose are not."""
    for text in ("pwd: QxVbLmZtRkWp", "the passphrase is wkzhrvqmtbxp.", "auth => hZqPwRtXkBnM", "access_key=gqzxvtrwkpfj"):
        found = secretscan.value_spans(text, [], 9.0)
        assert [text[a:b] for a, b, _ in found] == [re.split(r"[ =]", text.rstrip("."))[-1]], text
    for word in "everything confidential required incorrect unfortunately placeholder incorrectly Administrator environment".split():
        assert not secretscan.value_spans(f"the password is {word}, auth: {word}", [], 9.0), word


def test_pii_base_spans():
    t = "é a.b+c@mail.example.com, 1.2.3.4 999.1.1.1 4539 1488 0343 6467 1234567890123 +1 (017) 555-7713. x@y"
    got = [(k, t[a:b]) for a, b, k in sorted(pii.base_spans(t))]
    assert ("email", "a.b+c@mail.example.com") in got and ("ip", "1.2.3.4") in got and ("phone", "+1 (017) 555-7713") in got
    assert not any("999" in s or "x@y" in s for _, s in got)
    assert [(k, "4539148803436467"[a:b]) for a, b, k in pii.base_spans("4539148803436467")] == [("card", "4539148803436467")]


def test_pii_network_learns():
    tagger = pii.train()
    x, y = pii.training_windows(400, 12345)
    tags = tagger.viterbi(tagger.scores(x))
    assert (tags == y).mean() > 0.95 and (tags[y == 1] == 1).mean() > 0.85


def test_pii_gradient():
    tagger = pii.Tagger(1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = pii.training_windows(3, 5)
    x, y = x[:, :9], y[:, :9]
    _, g = tagger.step(x, y)
    for name in ("wf", "ub", "move", "out"):
        v = tagger.p[name].copy()
        at = (1, 2)
        tagger.p[name] = v.copy()
        tagger.p[name][at] += 1e-5
        up = tagger.step(x, y)[0]
        tagger.p[name][at] -= 2e-5
        down = tagger.step(x, y)[0]
        tagger.p[name] = v
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_pii_spans_without_digits_and_of_any_length():
    """Spelled-out addresses without a digit, and long ones at every offset to the pieces."""
    address, long = "jane.doe [at] mail [dot] org", "rosalinda.montgomery-featherstone [at] departmental-post [dot] org"
    texts = [f"please write to {address} for more"] + [f"{('some words stand here ' * 9)[:k]} {long} and so on" for k in range(60, 124, 3)]
    found = pii.tag_texts(pii.train(), texts)
    assert [texts[0][a:b] for a, b in found[0]] == [address]
    assert sum(any(long in t[a:b] for a, b in own) for t, own in zip(texts[1:], found[1:], strict=True)) == len(texts) - 1


def test_pii_recall_by_kind():
    """Held-out spans of every kind in prose; most of each is found, and prose with neutral figures is left alone."""
    rng, tagger = np.random.default_rng(777), pii.train()
    prose = lambda: " ".join(pii._letters(rng, 1, 9) for _ in range(int(rng.integers(4, 12))))
    for kind, make in pii.PERSONAL.items():
        spans_ = [make(rng) for _ in range(60)]
        texts = [f"{prose()} {x} {prose()}" for x in spans_]
        hits = sum(any(2 * len(set(range(a, b)) & set(range(t.index(x), t.index(x) + len(x)))) > len(x) for a, b in own) for t, x, own in zip(texts, spans_, pii.tag_texts(tagger, texts), strict=True))
        assert hits >= 54, (kind, hits)
    texts = [f"{prose()} {pii._neutral(rng)} {prose()}" for _ in range(200)]
    assert sum(bool(own) for own in pii.tag_texts(tagger, texts)) <= 6


def test_pii_reads_every_character(spark):
    """Addresses with neither a digit, a sign nor a word of their own, far from any, at every offset to the pieces."""
    tagger, words = pii.train(), "some words stand here "
    for address in ("anna.keller_at_mailbox_dot_org", "jonas-weber_at_office_dot_net"):
        texts = [(words * 60)[:k].rsplit(" ", 1)[0] + f" {address} " + words * 20 for k in range(440, 1160, 24)]
        assert not any(c.isdigit() or c == "@" for t in texts for c in t)
        assert [[t[a:b] for a, b in own] for t, own in zip(texts, pii.tag_texts(tagger, texts), strict=True)] == [[address]] * len(texts)
    row = pii.pii_scan(spark.createDataFrame([(1, texts[0])], "doc_id bigint, text string")).collect()[0]
    at = texts[0].index(address)
    assert row.n_spans == 1 and row.spans == f"other:{at}:{at + len(address)}"


def test_pii_best_tags_are_those_of_the_whole_text():
    """Decoding by stretches against one plain Viterbi path a text, and reading by pieces against reading one by one."""
    rng, move = np.random.default_rng(6), pii.train().p["move"]

    def path(s):
        v, back = s[0] + move[0], []
        for row in s[1:]:
            ways = v[:, None] + move
            back.append(ways.argmax(0))
            v = ways.max(0) + row
        tags = [int((v + move[:, 0]).argmax())]
        for came in reversed(back):
            tags.append(int(came[tags[-1]]))
        return tags[::-1]

    texts = [rng.normal((1, -1, -0.5), 2, (n, 3)).astype(np.float32) for n in rng.integers(0, 200, 120)]
    got = pii.decoded(np.concatenate(texts), move, np.cumsum([0, *map(len, texts)]))
    assert got.tolist() == [tag for s in texts if len(s) for tag in path(s)] and (got > 0).any()
    found = ["", "one two\ud83d\ude00 \u00e9t\u00e9 call 219-09-9999", "x" * 700, "jane [at] mail [dot] org", ""]
    bounds = np.cumsum([0, *map(len, found)])
    scores = pii.read_scores(pii.train(), np.concatenate([*map(pii.encode, found)]), bounds)
    for k, text in enumerate(found):
        if 0 < len(text) <= pii.CORE:
            assert np.allclose(scores[bounds[k] : bounds[k + 1]], pii.train().scores(pii.encode(text)[None])[0], atol=1e-3)
    assert pii.tag_texts(pii.train(), found) == [pii.tag_texts(pii.train(), [t])[0] for t in found] and pii.tag_texts(pii.train(), []) == []


def test_pii_long_spans_beside_short_ones():
    """A stretch of 200,000 characters is decoded beside thousands of short ones in bounded memory."""
    import time
    import tracemalloc

    long, short = "five " * 40_000, "call 219-09-9999 " * 3000
    pii.train()
    tracemalloc.start()
    began = time.time()
    first, second = pii.tag_texts(pii.train(), [long, short])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and time.time() - began < 60
    assert max(b - a for a, b in first) > 100_000 and len(second) == 3000


def test_reconcile_takes_the_best_total():
    found = [(0, 10, 3.0), (5, 15, 5.0), (12, 20, 3.0), (12, 20, 0.5)]
    assert pii.reconcile(found) == [(0, 10), (12, 20)] and pii.reconcile([]) == []


def test_pii_rows(spark, odd, none):
    text = "call (555) 123-4567 or mail me.2@mail3.example.com"
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, text)], "doc_id bigint, text string"))
    rows = {r.doc_id: r for r in pii.pii_scan(docs).collect()}
    assert rows[50].n_email == 1 and rows[50].n_other >= 1 and rows[1].spans == "" and rows[50].n_spans == len(spans(rows[50].spans))
    assert pii.pii_scan(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><article class="post-{n}"><h1>Title &amp; more</h1><p><b>First<br>  para<p>Second&nbsp;one <a href="/x">link</a></p>
<div class="comments"><p>nice!</p></div><form><p>subscribe</p></form></article><aside>more</aside><footer>&copy; x</footer></body></html>"""


def test_html_text():
    found = htmltext.blocks(PAGE.replace("{n}", "17"))
    assert htmltext.votes(found)[0][0] == "html/body/article.post-0"
    assert htmltext.text_at(found, "html/body/article.post-0") == "Title & more First para Second one link"
    assert htmltext.text_at(found, "html/body/nothing") == "Title & more First para Second one link"
    assert htmltext.text_at(htmltext.blocks(""), None) == "" and htmltext.text_at(htmltext.blocks("plain &lt;text"), None) == "plain <text"
    assert htmltext.text_at(htmltext.blocks("<article><p>a b</p><p>c &am"), None) == "a b c &am"
    assert htmltext.text_at(htmltext.blocks("<article><p>a</p></art"), None) == "a"
    assert htmltext.text_at(htmltext.blocks("<p>x<!-- <p>no</p>"), None) == "x"


def test_html_wrappers_named_by_furniture_words():
    text = "long text of the page " * 20
    for wrapper in ("class='content with-sidebar'", "class='has-sidebar'", "class='no-sidebar header-fixed'", "id='search-results-page'"):
        for inner in (f"<p>{text}</p>", f"<article><p>{text}</p><div class='comments'><p>{text * 3}</p></div></article>"):
            page = f"<body><div {wrapper}>{inner}<div class='sidebar'><p>side</p></div></div><div class='cookie'>cookies</div></body>"
            assert htmltext.text_at(htmltext.blocks(page), None) == text.strip(), page
    page = f"<main><h1>Title</h1><div class='content with-sidebar'><p>{text}</p></div><div class='related'><p>other</p></div></main>"
    assert htmltext.text_at(htmltext.blocks(page), None) == f"Title {text.strip()}"
    assert htmltext.text_at(htmltext.blocks("<p>one w<span class='ad'>x</span>ord"), None) == "one word"


def test_html_of_any_depth():
    import time

    start = time.perf_counter()
    for tag in ("div", "b", "div class='sidebar'", "ul><li", "article"):
        page = f"<{tag}>" * 8000 + "<p>deep words</p>" + "</span></i>" * 3000
        assert htmltext.text_at(htmltext.blocks(page), None) == "deep words", tag
    assert time.perf_counter() - start < 8


def test_html_forms_and_repeated_blocks():
    text = "long text of the page " * 20
    page = f"<body><form action='/x'><div class='content'><p>{text}</p></div></form></body>"  # the whole page is one form
    assert htmltext.text_at(htmltext.blocks(page), None) == text.strip()
    page = f"<body><div class='story'><p>{text}</p></div><form><p>name and address</p></form></body>"
    assert htmltext.text_at(htmltext.blocks(page), None) == text.strip()
    twice = "<body><div class='story'><p>same words</p><p>same words</p><div class='w-1/2'><p>half</p></div></div></body>"
    found = htmltext.blocks(twice)
    assert htmltext.text_at(found, "body/div.story") == "same words same words half" and htmltext.text_at(found, "body/div.story/div.w-0|0") == "half"
    tied = "<body><div><p>one one</p></div><section><p>two two</p></section></body>"
    assert htmltext.text_at(htmltext.blocks(tied), None) == "one one two two"


def test_html_hosts_vote(spark):
    """A host whose pages share a layout: the page with a long side block follows the others."""
    normal = "<body><div class='story'><p>" + "text " * 40 + "</p></div><div class='box'><p>short</p></div></body>"
    odd_one = "<body><div class='story'><p>brief story</p></div><div class='box'><p>" + "side " * 90 + "</p></div></body>"
    rows = [(k, f"http://h.example/{k}", normal, 1) for k in range(9)] + [(9, "http://h.example/9", odd_one, 1), (10, None, None, 1), (11, "::bad", "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    out = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert out[9] == "brief story" and out[10] == "" and out[11] == "" and len(out) == 12
    assert htmltext.extract(pages.filter("page_id < 0")).count() == 0


def test_html_against_testdata(spark, data):
    import html

    pages = common.table(spark, data, "pages")
    out = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        parts = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|br)>", body.replace("<b>", "")))
        assert out[r.page_id] == " ".join(p for p in parts if p)
