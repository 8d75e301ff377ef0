"""Spelling variants, ranked search and piece encoding against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import lexical, pieces, queries, variants

NEW = ["op11_spelling_variants", "op12_ranked_search"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, data, compare, name):
    got, want = compare(queries.QUERIES[name](spark, data), queries.ORACLES[name])
    assert got == want and got


# --- spelling variants


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(docs, noise, min_chars=5, min_count=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    others = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {w: min(o, key=lambda v: (-words[v], v)) if o else None for w, o in others.items()}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(others[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def test_composition_is_every_pair_once():
    random.seed(5)
    for size in (2, 9, 60):
        for _ in range(40):
            rests = sorted({"".join(random.choice("abç") for _ in range(random.choice([3, 4]))) for _ in range(size)})
            acceptor = variants.Acceptor()
            acceptor.add(["aab", "bab"])  # states of another partition are shared
            start = acceptor.add(rests)
            got = sorted(tuple(sorted((rests[i], rests[j]))) for i, j in acceptor.one_edit(start, 3, False))
            assert got == [(u, v) for k, u in enumerate(rests) for v in rests[k + 1 :] if near(u, v) and min(len(u), len(v)) == 3]
            inner = sorted(tuple(sorted((rests[i], rests[j]))) for i, j in acceptor.one_edit(start, 3, True))
            assert inner == [p for p in got if not (len(p[0]) != len(p[1]) and max(p, key=len).startswith(min(p, key=len)))]


def test_acceptor_is_minimal():
    acceptor = variants.Acceptor()
    acceptor.add(sorted(a + b + c for a in "abc" for b in "de" for c in ("ing", "ed")))
    # after the first letter, after the second, "ing" and "ed" letter by letter to one end
    assert len(acceptor.moves) == 7


@pytest.mark.parametrize(("noise", "partition_words"), [(97, 20_000), (3, 4), (None, 1)])
def test_variants_against_brute_force(spark, noise, partition_words):
    random.seed(partition_words)
    words = ["".join(random.choice("abé") for _ in range(random.choice([4, 5, 6, 7, 9]))) for _ in range(150)] + ["Straße", "façade", "facade", "x" * 3000, "x" * 3001]
    docs = [(k if k % 9 else None, " ".join(random.choice(words) + random.choice([",", " ", "1", "\n", "日"]) for _ in range(60))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "ABABA ababa Ababa"), (102, "ABABA ababa Ababa"), (103, "\x00\x85 ×÷×÷× ×÷×÷× ×÷×÷×")] + [(104, " ".join(words[-2:] * 3))]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id bigint, text string, word string, n int")
    got = rows_of(variants.spelling_variants(df, noise=noise, partition_words=partition_words))
    assert got == brute_variants(docs, noise)


def test_variant_chains_end_at_their_root(spark):
    counts = {"abcde": 3, "abcdx": 7, "abcyx": 15, "abzyx": 31, "aqzyx": 63, "pqzyx": 130}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    rows = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {r.root for r in rows.values()} == {"pqzyx"} and rows["abcde"].form == "abcdx" and rows["pqzyx"].form is None


def test_variants_of_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(variants.spelling_variants(odd, noise=97)) == brute_variants(docs, 97)
    assert variants.spelling_variants(none).count() == 0


# --- ranked search


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc_id, c in counts:
            m = 25 + 75 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_case(seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "naïve", "A1"]
    text = lambda low, high: random.choice([" ", "-", "\n"]).join(random.choices(words, range(len(words), 0, -1), k=random.randint(low, high)))
    docs = [(k, text(1, 60)) for k in range(120)]
    docs += [(k + 200, docs[3][1]) for k in range(30)] + [docs[3], docs[3], (None, docs[3][1]), (None, None), (500, ""), (501, "!?\x00"), (502, "w1 " * 5000)]
    items = [(k, text(3, 12)) for k in range(8)] + [(3, "w1 w1 w2"), (90, None), (91, ""), (92, "nowhere at all"), (93, docs[3][1]), (93, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 20])
def test_search_against_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    docs, items = search_case(block_terms)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, queries string, q int")
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, weight string")
    assert rows_of(lexical.ranked_search(frame, asked)) == brute_search(docs, items)


def test_bounds_hold_with_crowded_sketches(monkeypatch):
    monkeypatch.setattr(lexical, "MOST_COORDINATES", 64)
    random.seed(2)
    counts = {f"t{k}".encode(): random.choice([1, 2, 3, 200, 5000, 10**7]) for k in range(500)}
    folded = lexical.sketch(counts)
    assert len(folded) == 64
    block = lexical.Block([(k % 7, k % 7, f"t{k}", 1 + k % 5) for k in range(0, 900, 3)])
    exact = block.scores({t: n for t, n in counts.items() if t in block.term_numbers}, 77, set(range(7)))
    bounds = block.bounds(folded, 77)
    assert all(bounds[q] >= s for q, s in exact.items())


def test_sketch_codes_round_up():
    counts = {f"t{n}".encode(): n for n in (1, 2, 127, 128, 129, 1000, 10**6, 2**31)}
    for term, n in counts.items():
        assert lexical.CODES[lexical.sketch({term: n}).max()] >= n


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "word w1 w2"), (2, "line shared"), (None, "a b")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(lexical.ranked_search(odd, asked)) == brute_search([(r.doc_id, r.text) for r in odd.collect()], items)
    assert lexical.ranked_search(none, asked).count() == 0
    assert lexical.ranked_search(odd, asked.filter("item_id > 9")).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PARTS = ["a", "the", "▁", " ", "  ", "\n", "\t", "é", "漢", "😀", "́", "ß", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "\r\n", "ing", "1", "2024", ". ", "      ", "　", "�"]


def mixed(count):
    random.seed(count)
    return ["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(count)] + ["", " ", "▁", "\n" * 300_000, " " * 300_000 + "x", "é" * 5000, "漢" * 5000]


def test_pieces_and_spans_are_the_library_s(library):
    from sentencepiece import sentencepiece_pb2

    texts = mixed(800)
    for text, (ids, begins, ends) in zip(texts, pieces.load("piece_bpe_32k.model").encode(t.encode() for t in texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True)
        want = sentencepiece_pb2.SentencePieceText.FromString(library.encode(text, out_type="serialized_proto"))
        size = len(text.encode())
        assert [*zip(begins.tolist(), ends.tolist(), strict=True)] == [*((p.begin, p.end) for p in want.pieces), (size, size)]


def test_malformed_bytes(library):
    for source in (b"\xff", b"a\xc3", b"\xe6\xbc b", b"\xed\xa0\x80x", b"ok \xf0\x9f\x98"):
        ids, begins, ends = next(pieces.load("piece_bpe_32k.model").encode([source]))
        assert ids.tolist() == library.encode(source, add_eos=True) and ends[-1] == len(source) and (begins[1:] == ends[:-1]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps(rule, dummy, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    other = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    own = object.__new__(pieces.Pieces)
    own.spec, own.suffix = sentencepiece_model_pb2.ModelProto.FromString(other.serialized_model_proto()).normalizer_spec, False
    own.map = pieces.CharacterMap(own.spec.precompiled_charsmap)
    for text in mixed(150)[:-4] + ["ﬁn ㍿ Å Å 한 한", "  Ａ½① ｶﾞ  é  ", "plain words of ASCII  and two blanks  "]:
        text = text.replace("\x00", "")
        want, places = other.normalize(text, with_offsets=True)
        got, back = own.normalise(text.encode())
        source = [0, *(len(text[: k + 1].encode()) for k in range(len(text)))]
        ends = [0, *(len(got[: k + 1].encode()) for k in range(len(got)))]
        assert got == want
        if want:  # of nothing but squeezed blanks the library gives no places
            assert [int(back[e]) for e in ends] == [source[p] for p in places]


def test_cuts_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(pieces, "KNOWN", 50)
    monkeypatch.setattr(pieces, "LEARNT_BYTES", 40)
    own = pieces.Pieces("piece_bpe_32k.model")
    texts = [f"word{k} other{k % 5} é{k}" for k in range(60)]
    assert [ids.tolist() for ids, _, _ in own.encode(t.encode() for t in texts)] == library.encode(texts, add_eos=True)


def test_encoding_of_odd_rows(spark, odd, none, library, monkeypatch):
    rows = pieces.encode(odd).collect()
    want = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in rows) == sorted((i is None, i or 0, library.encode(t, add_eos=True), library.decode(library.encode(t))) for i, t in want)
    assert all(r.ends[-1] == len(t.encode()) for r in rows for i, t in want if i == r.doc_id and i is not None)
    assert pieces.encode(none).count() == 0


def test_encoding_query(spark, data, library):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op13_sentencepiece(spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


# --- packing of hostile texts


def test_long_white_space_is_packed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm import packing

    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b <|endoftext|>", "short"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, text in enumerate(texts):
        want = [*own.encode(text, add_special_tokens=False).ids, 0]
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == k)
        assert mine == [(s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want[s : s + n])), len(want)) for s, n, _, _ in mine] and sum(n for _, n, _, _ in mine) == len(want)


# --- base spans of personal data in long runs


def test_addresses_are_leftmost_and_linear():
    import time

    from quarry.llm import pii

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    number = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    random.seed(13)
    for _ in range(4000):
        text = "".join(random.choices("a1_.@-é +", weights=[4, 4, 1, 4, 3, 1, 1, 1, 1], k=random.randint(0, 40)))
        assert list(pii.emails(text)) == [m.span() for m in email.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in number.finditer(text)], text
    start = time.monotonic()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@x.org", "a." * 500_000, "@" * 1_000_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000, "@" + "a" * 1_000_000):
        pii.base_spans(text)
    assert time.monotonic() - start < 20
