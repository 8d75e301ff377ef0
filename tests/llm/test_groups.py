"""Operators over the whole table: packing, substrings, lines, near duplicates, decontamination, licences."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontam, license, linededup, neardup, packing, queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, compare, name):
    got, want = compare(queries.QUERIES[name](spark, data), queries.ORACLES[name])
    assert got == want


# Packing.


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        cap = rng.randint(max(counts), 60)
        used = packing.best_fill(counts, cap)
        assert all(used[k] <= counts[k] for k in used) and max(counts) in used
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        reach = {max(counts)}
        for x in items:
            reach |= {r + x for r in reach if r + x <= cap}
        assert sum(k * n for k, n in used.items()) == max(reach)


def test_added_tokens_as_tokenizers():
    from tokenizers import Tokenizer
    import public_tokenizers

    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.tiktoken")
    end = "<|endoftext|>"
    for text in (f"one{end}two", end, f" {end}{end} \n{end}", f"don't {end[:-1]} stop{end}'s  end", "plain text", ""):
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids, text
    assert 50256 in encode(f"a{end}")


def check_pieces(rows, texts, capacity=1024):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    assert set(docs) == {d for d, _ in texts}
    for d, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_round_trip(spark, data, odd, none):
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    check_pieces(packing.pack(docs.repartition(3)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    once = odd.dropDuplicates(["doc_id", "text"])
    check_pieces(packing.pack(once).collect(), [(r.doc_id, r.text) for r in once.collect()])
    assert packing.pack(none).count() == 0
    assert packing.pack(docs.coalesce(1), pool_tokens=4096).agg(F.sum("length")).first()[0] == packing.pack(docs).agg(F.sum("length")).first()[0]


# Substrings.


def brute_substrings(rows, size=13):
    first, words = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < d:
                gone |= set(range(k, k + size))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def random_documents(n, seed):
    rng = random.Random(seed)
    vocab, out = ["a", "b", "the", "x1", "é"] + [f"v{k}" for k in range(12)], []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if out and rng.random() < 0.7:
            src = rng.choice(out)[1].split()
            a = rng.randint(0, len(src))
            w = w[:10] + src[a : a + rng.randint(0, 40)] + w[10:]
        if rng.random() < 0.2:
            w += [rng.choice(vocab)] * rng.randint(10, 40)
        out.append((d, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rows = random_documents(120, seed)
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), pack_chars=700)
    assert sorted(map(tuple, got.collect())) == brute_substrings(rows)


def test_substring_symbols_are_consistent():
    """A window has the same standing symbol and form wherever it lies, and other windows have others."""
    rng, forms = random.Random(5), {}
    for k in range(60):
        window = [rng.choice("abcdefg") for _ in range(13)]
        if k % 3 == 0:  # a run
            window[2:9] = ["r"] * rng.randint(5, 7)
            window = (window + list("abcdefg"))[:13]
        seen = set()
        for _ in range(30):
            before, after = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 9))] for _ in range(2))
            pack = substring.Pack([1, 2], ["a b", " ".join(before + window + after)])
            starts = pack.windows()
            at = np.flatnonzero(starts == 2 + len(before))
            place, name = pack.stands(starts[at])
            high, low = pack.forms(starts[at])
            seen.add((int(place[0]) - 2 - len(before) if place[0] >= 0 else None, int(name[place[0]]) if place[0] >= 0 else None, int(high[0]), int(low[0])))
        assert len(seen) == 1, window
        forms.setdefault(seen.pop()[2:], set()).add(tuple(window))
    assert all(len(own) == 1 for own in forms.values()) and len(forms) == 60


def test_substring_rounds_name_runs_and_pairs(monkeypatch):
    """Runs and pairs become symbols; forms are made of them, so that without either round they are others."""
    text = "x a a a b c d e f g h a a a b q q y z u v w"
    pack = substring.Pack([1], [text])
    s = pack.symbols
    runs = {int(n) for n in substring.run_round(substring.Level(pack.names, *[np.arange(22)] * 2, np.arange(1, 23), pack.doc), pack.ends).name}
    assert len(s.name) < 18 and len(runs) == 15  # a a a is one symbol, twice, and q q another
    assert any(b - a >= 2 for a, b in zip(s.start, s.start[1:]))
    forms = set(pack.forms(pack.windows())[0].tolist())
    for step in ("run_round", "pair_round"):
        with monkeypatch.context() as m:
            m.setattr(substring, step, lambda level, ends: level)
            assert not forms & set(substring.Pack([1], [text]).forms(pack.windows())[0].tolist()) or step == "run_round"
    high = substring.four_round(s)
    assert len(high.name) == len(s.name) - 3 and (high.low <= high.start).all()


def test_most_windows_are_revealed_by_symbols(spark, data):
    docs = [r.text for r in common.table(spark, data, "documents").select("text").limit(60).collect()]
    pack = substring.Pack(list(range(len(docs))), docs)
    place, _ = pack.stands(pack.windows())
    assert (place >= 0).mean() > 0.97


def test_substring_cases(spark, odd, none):
    rows = {}
    for r in substring.substring_dedup(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[7]) == 2 and rows[7][0] == rows[7][1] and rows[7][0].n_removed == 40
    assert rows[None][0].n_removed == 0 and rows[1][0].n_words == 0 and rows[4][0].n_removed == 40
    assert substring.substring_dedup(none).count() == 0


# Lines.


def test_lines_cases(spark, odd, none):
    rows = {}
    for r in linededup.line_dedup(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert [rows[k][0].n_dropped for k in (4, 5, 6)] == [2, 2, 0] and [r.n_dropped for r in rows[7]] == [0, 0]
    assert rows[1][0].n_lines == 1 and rows[1][0].kept_text == "" and rows[9][0].kept_text == "a\r\nb"
    assert linededup.line_dedup(none).count() == 0
    out = linededup.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter("doc_id = 1").first().text is None


def test_runs_know_what_is_new(spark):
    """Every key lies in one run, counts come from runs and logs, and without the anti-join they would be wrong."""
    batch = lambda keys, d: spark.createDataFrame([(k, k, 1, d) for k in keys], "h1 bigint, h2 bigint, n_docs bigint, max_doc bigint")
    batches = [([1, 2, 3], {1, 2, 3}), ([2, 4], {4}), ([1, 4, 5], {5}), ([1], set())]
    runs = linededup.LineRuns(spark, fanout=2)
    for d, (keys, fresh) in enumerate(batches):
        run, log = runs.add(batch(keys, d))
        assert {r.h1 for r in run.collect()} == fresh and {r.h1 for r in log.collect()} == set(keys) - fresh
    assert len(runs.tables(True)) < 4  # compacted
    assert sorted(r.h1 for r in runs.united(runs.tables(True)).collect()) == [1, 2, 3, 4, 5]
    assert {(r.h1, r.max_doc) for r in runs.common_keys(3).collect()} == {(1, 3)} and {r.h1 for r in runs.common_keys(2).collect()} == {1, 2, 4}
    blind = linededup.LineRuns(spark, fanout=9)
    for d, (keys, _) in enumerate(batches):
        blind.levels[0].append(blind._write(batch(keys, d), None, "run"))
    assert blind.common_keys(3).count() == 0


def test_names_of_columns_may_hold_dots(spark, odd):
    named = odd.withColumnsRenamed({"lang": "a.b", "source": "c`d"})
    for out in (linededup.drop_lines(named), neardup.keep_first(named)):
        assert out.columns == named.columns and {r.doc_id for r in out.collect()} >= {None, 1, 2, 3}
    assert linededup.drop_lines(named).filter("`a.b` = 'en'").count() == 10


def test_many_common_keys_take_the_merge_join(spark, data, compare, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    got, want = compare(queries.QUERIES["op8_line_dedup"](spark, data), queries.ORACLES["op8_line_dedup"])
    assert got == want


# Near duplicates.


def brute_components(rows, percent=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def test_near_duplicates_in_one_large_group(spark):
    """Copies with so many edits that many pairs lie on both sides of the threshold."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(500, "a b c"), (501, "A B c"), (502, ""), (503, None), (504, " ".join(base).upper())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_components(rows)


def test_signature_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    b = np.unique(np.concatenate([a[:500], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = neardup.packed(neardup.minima(a)).view(np.uint64), neardup.packed(neardup.minima(b)).view(np.uint64)
    equal = sum((int(p) >> s & 15) == (int(q) >> s & 15) for p, q in zip(x, y) for s in range(0, 64, 4))
    chance = 2.0**-neardup.BITS
    assert abs((equal / neardup.MINIMA - chance) / (1 - chance) - true) < neardup.MARGIN
    odd = sum(int(p ^ q).bit_count() for p, q in zip(neardup.parities(a).view(np.uint64), neardup.parities(b).view(np.uint64)))
    assert odd <= len(np.setxor1d(a, b))


def test_recall_just_over_the_threshold():
    """Pairs of sets at 0.85 to 0.88: nearly all share a band, and the estimate's margin holds."""
    rng, seen, lost, low = np.random.default_rng(9), 0, 0, 0
    for _ in range(2000):
        n = int(rng.integers(60, 600))
        own = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        both = int(np.ceil(rng.uniform(0.85, 0.88) * 2 * n / 1.86))
        a, b = np.unique(own[:n]), np.unique(np.concatenate([own[:both], own[n : 2 * n - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if true < 0.85:
            continue
        x, y = neardup.minima(a), neardup.minima(b)
        lost += not set(neardup.band_keys(x)) & set(neardup.band_keys(y))
        p, q = neardup.packed(x).view(np.uint64), neardup.packed(y).view(np.uint64)
        equal = sum((int(v) >> s & 15) == (int(w) >> s & 15) for v, w in zip(p, q) for s in range(0, 64, 4))
        low += (equal / neardup.MINIMA - 1 / 16) / (15 / 16) < 0.85 - neardup.MARGIN
        seen += 1
    assert seen > 1000 and lost == 0 and low == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_after_more_edges(spark, monkeypatch, few):
    from quarry.llm import graph

    monkeypatch.setattr(graph, "BROADCAST_EDGES", few)
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(40)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    root = {k: k for k in range(80)}
    for a, b in edges + more:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    label = graph.extended(graph.components(frame(edges)), frame(more))
    got = {r.node: r.component for r in label.collect()}
    assert all(got[k] == root[k] for k in got) and set(got) >= {k for a, b in edges + more if a != b for k in (a, b)}
    assert label.count() == len(got) and graph.components(frame([])).count() == 0


def test_near_duplicate_cases(spark, odd, none):
    rows = {}
    for r in neardup.near_duplicates(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].component_id == 1 and rows[1][0].kept and rows[8][0].n_shingles == 0 and rows[8][0].kept
    assert len(rows[7]) == 2 and rows[None][0].kept and rows[None][0].component_id is None and not rows[7][0].kept
    assert neardup.keep_first(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 2, 3, 8, 9}


# Decontamination.


def test_lcs():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def test_leaks_against_brute_force(spark, data):
    """Every document that holds most trigrams of an item is found, and no other."""
    d = data.replace("sf0.001", "sf0.01")
    docs, bench = common.table(spark, d, "documents"), common.table(spark, d, "benchmark")
    tri = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    items = {r.item_id: tri(decontam.words_of(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, s in items.items() if len(s & tri(decontam.words_of(r.text))) >= 0.6 * len(s)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == want and len(want) > 10
    left = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {x for x, _ in want}


def test_paraphrase_is_found(spark, data):
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    item = "Which harbour town shipped copper ore to the northern smelters during the long winter of the siege? The answer is Port Maribel near Oldcastle."
    other = "filler words stand here first. Which harbour town sent copper ore up to the northern smelters in the long cold winter of that siege? Their answer is Port Maribel near Oldcastle. more filler follows now"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    rows = decontam.find_leaks(docs.unionByName(spark.createDataFrame([(10**6, other)], "doc_id bigint, text string")), bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(10**6, 1)]


def test_leak_cases(spark, odd, none, data):
    bench = common.table(spark, data, "benchmark")
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(odd, bench.filter("item_id < 0")).count() == 0
    assert decontam.drop_leaks(odd, bench).count() == odd.count()


def test_decoy_does_not_hide_a_leak(spark, data):
    """The item's words in other order beat the leak's window in cosine; the leak is found all the same."""
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    item = "Which harbour town shipped copper ore to the northern smelters during the long winter of the siege? The answer is Port Maribel near Oldcastle."
    leak = "Which harbour town then shipped raw copper ore up to the old northern smelters all during that long cold winter of the grim siege? The answer is surely Port Maribel lying near Oldcastle."
    decoy = " ".join(reversed(decontam.words_of(item)))
    text = f"{decoy} {'filler ' * 300} {leak} {'filler ' * 300} {decoy}"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    more = spark.createDataFrame([(10**6, text), (10**6 + 1, decoy)], "doc_id bigint, text string")
    rows = decontam.find_leaks(docs.unionByName(more), bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(10**6, 1)] and rows[0].lcs_share >= 0.6


def test_short_item_of_frequent_words_among_rare_ones(spark):
    """A verbatim item of 12 words that most documents hold, beside words of one document only."""
    rng = random.Random(5)
    common_words = [f"often{k}" for k in range(12)]
    rare = lambda k, n: " ".join(f"r{k}x{rng.randrange(10**9)}" for _ in range(n))
    rows = [(k, " ".join(f"{w} {rare(k, 12)}" for w in rng.sample(common_words, 12))) for k in range(60)]
    rows += [(100 + k, f"{rare(k, 50 + k)} {' '.join(common_words)} {rare(k, 60)}") for k in range(9)] + [(200, " ".join(common_words))]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(common_words))], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [(100 + k, 1) for k in range(9)] + [(200, 1)]


def test_latent_space_takes_no_sample(spark, data):
    """The space is that of all item passages and of nothing else, so cosines do not hang on which documents were drawn."""
    docs, items = common.table(spark, data, "documents"), decontam.items_of(common.table(spark, data, "benchmark"))
    spaces = decontam.latent_spaces(decontam.tokenised(docs), items)
    assert sum(s.passages.n for s in spaces) == sum(-(-len(i.words) // decontam.PASSAGE) for i in items)
    for s in spaces:
        units = [s.weights[q] / np.linalg.norm(s.weights[q]) for q in s.own]
        dense = np.zeros((len(s.own), len(s.used)))
        for k, (q, u) in enumerate(zip(s.own, units, strict=True)):
            np.add.at(dense[k], s.row[q], u)
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        assert np.abs(s.queries @ s.queries.T - dense @ dense.T).max() < 1e-3


# Licences.


def test_license_rules(spark, odd, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    cond = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, f"{mit}. {cond}"), (2, f"{cond} {mit}."), (3, "Text. Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, "licensed under something of my own"), (5, None)]
    out = {r.doc_id: r for r in license.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].licenses == ["MIT"] and out[2].licenses == [] and out[3].licenses == ["MIT", "CC-BY-NC-4.0"]
    assert out[4].n_generic == 1 and out[5].licenses == []
    assert license.license_scan(odd).count() == odd.count() and license.license_scan(none).count() == 0


def test_wrapped_licenses(spark):
    """Headers wrapped at some 70 columns, with comment marks, give the identifiers of their long sentences."""
    import textwrap

    known = {}
    for text, i in license.SENTENCES.items():
        known.setdefault(i, text)
    body = lambda *ids: [known[i][0].upper() + known[i][1:] + "." for i in ids]
    wrap = lambda parts, mark: "\n".join(textwrap.wrap(" ".join(parts), 70, initial_indent=mark, subsequent_indent=mark))
    mit, gpl = body("mit-grant", "mit-condition", "mit-disclaimer"), body("gpl-3.0-grant", "gpl-disclaimer")
    bsd = body("bsd-grant", "bsd-source", "bsd-binary")
    rows = [
        (1, "Copyright (c) 2001 Someone\n\n" + "\n\n".join(wrap([p], "") for p in mit)), (2, wrap(mit, " * ")), (3, wrap(gpl, "# ")),
        (4, "/*\n" + wrap(gpl, "// ") + "\n*/\nint x;"), (5, "\n".join(wrap([p], "  ") for p in bsd)), (6, "Licensed under the\n\nMIT License."), (7, "Licensed under the\r\nMIT License"),
    ]
    out = {r.doc_id: r for r in license.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[k].licenses for k in range(1, 8)] == [["MIT"], ["MIT"], ["GPL-3.0"], ["GPL-3.0"], ["BSD-2-Clause"], [], ["MIT"]]
    assert out[1].sentence_ids == "mit-grant,mit-condition,mit-disclaimer" and out[1].n_generic == 0 and out[6].n_generic == 2
    assert all(any(c in s for c in license.CUES) for s in license.SENTENCES)


BSD = """Copyright (c) 2019, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED."""
THIRD = """3. Neither the name of Some Body Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_rules_hold_the_longest_licence(spark):
    cases = {
        BSD.format(third=""): ["BSD-2-Clause"], BSD.format(third=THIRD.replace(" Inc.", " Inc")): ["BSD-3-Clause"], "All rights reserved.": [], "Licensed under the BSD 3-Clause License.": ["BSD-3-Clause"],
        "This library is licensed under the terms of the GNU LGPL v2.1 or later.": ["LGPL-2.1"], "The code is available under CC BY-SA 3.0.": ["CC-BY-SA-3.0"], "Released under a BSD license": ["BSD"],
        "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0": ["Apache-2.0"],
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": ["AGPL-3.0"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"], "Published under the EUPL-1.2": ["EUPL-1.2"], "licensed under my own terms": [],
    }
    out = license.license_scan(spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id bigint, text string"))
    assert {r.doc_id: r.licenses for r in out.collect()} == dict(enumerate(cases.values()))


def test_every_notice_is_known(spark):
    """Each name behind some opening, wrapped at its spaces, gives its licence alone."""
    rng = random.Random(2)
    rows = [(lic, f"{rng.choice(license.OPENINGS)} {rng.choice(license.BEFORE)}{name}".replace(" ", rng.choice([" ", "\n"])) + ".") for lic, names in license.NAMES.items() for name in names]
    out = license.license_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string"))
    got = {r.doc_id: r.licenses for r in out.collect()}
    assert all(got[k] == [lic] for k, (lic, _) in enumerate(rows)), [(rows[k], got[k]) for k in got if got[k] != [rows[k][0]]][:5]


# Pipeline.


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = common.table(spark, data, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k == len(corpus_pipeline.STAGES) - 1:
            check_pieces(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
            break
        assert out.columns == docs.columns, name
        path = common.scratch(spark, name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "line_dedup":
            assert after.count() == docs.count() and after.filter("n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            want = {d for d, _, _, kept in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if kept}
            assert {r.doc_id for r in after.collect()} == want
        docs = after


def brute_lines(rows, min_chars=20, min_docs=3):
    """Kept texts by the contract of line dedup; rows of distinct ids."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    gone = lambda d, line: len(k := key(line)) >= min_chars and len(holders[k]) >= min_docs and d < max(holders[k])
    return {d: "\n".join(line for line in (t or "").split("\n") if not gone(d, line)) for d, t in rows}


def test_whole_pipeline_against_brute_force(spark, data):
    """The packed documents of run() are those that plain versions of the stages keep, with their texts."""
    import corpus_pipeline
    from quarry.llm import quality

    docs, bench, labels = (common.table(spark, data, t) for t in ("documents", "benchmark", "labels"))
    chain = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(d, t) for d, t in rows if not (found := quality.analyse(t or "")).base_failed and chain.content_share(found) >= 0.5]
    texts = brute_lines(kept)
    first = {d for d, _, _, own in brute_components(list(texts.items())) if own}
    tri = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    items = [tri(decontam.words_of(r.text)) for r in bench.collect()]
    clean = [(d, texts[d]) for d in first if not any(len(i & tri(decontam.words_of(texts[d]))) >= 0.6 * len(i) for i in items if i)]
    check_pieces(corpus_pipeline.run(spark, data).collect(), clean)


def test_stages_take_odd_and_empty_tables(spark, data, odd, none):
    """Nulls, empty and long texts, ties, repeated rows, clashing and dotted names through every stage."""
    import corpus_pipeline

    named = odd.withColumnsRenamed({"lang": "a.b"})
    for docs in (named, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id", "text"]), data).collect(), [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id", "text"]).collect()])


def test_stage_hashes(spark, data):
    """Line dedup of the pipeline and of the query agree."""
    docs = common.table(spark, data, "documents")
    a = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in linededup.drop_lines(docs).collect()}
    assert a == {r.doc_id: r.kept_sha256 for r in queries.op8_line_dedup(spark, data).collect()}
