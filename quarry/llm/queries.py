"""The queries opN_<name> over whole tables, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontam, htmltext, lexical, license, linededup, neardup, packing, pieces, pii, quality, secretscan, substring, variants


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = htmltext.extract(common.table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_scan(common.table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = quality.quality_scan(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op5_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_scan(common.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.substring_dedup(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.line_dedup(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license.license_scan(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "n_generic")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(common.table(spark, sf_dir, "documents"), noise=97)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(common.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )


WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, {WHITE_SQL}), '{linededup.UPPER}', '{linededup.LOWER}') AS key FROM lines
), common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, FALSE) AS dropped FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _license_sql() -> str:
    """Known sentences that lie in one line, by equality with the listed ones and with all notices; rules take their identifiers out one after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cues = lambda of, words: "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"
    pairs = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows.items())
    one = lambda rows: ", ".join(f"({quoted(x)})" for x in rows)
    steps, at = [], "r0"
    for k, (name, ids) in enumerate(license.RULES):
        own = quoted("," + ",".join(ids) + ",")
        steps.append(f"r{k + 1} AS (SELECT doc_id, sentence_ids, n_generic, replace(ids, {own}, ',|,') AS ids, CASE WHEN contains(ids, {own}) AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {at})")
        at = f"r{k + 1}"
    return f"""
WITH known(s, id) AS (
    SELECT * FROM (VALUES {pairs(license.SENTENCES)})
    UNION ALL SELECT o || ' ' || b || n, id FROM (VALUES {one(license.OPENINGS)}) t(o), (VALUES {one(license.BEFORE)}) u(b), (VALUES {pairs(license.NAME_IDS)}) v(n, id)
), once AS (SELECT s, min(id) AS id FROM known GROUP BY s),
lines AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS lpos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), cut AS (
    SELECT doc_id, lpos, unnest(ss) AS sentence, unnest(range(len(ss))) AS spos
    FROM (SELECT doc_id, lpos, string_split_regex(regexp_replace(line, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ss
          FROM lines WHERE {cues("lower(line)", license.CUES)})
), norm AS (
    SELECT doc_id, lpos, spos, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut
), found AS (
    SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY lpos, spos), '') AS sentence_ids,
           count(*) FILTER (id IS NULL AND {cues("norm.s", license.STRONG)}) AS n_generic
    FROM norm LEFT JOIN once USING (s) GROUP BY doc_id
), r0 AS (
    SELECT doc_id, sentence_ids, n_generic, ',' || sentence_ids || ',' AS ids, []::VARCHAR[] AS names FROM found
), {", ".join(steps)}
SELECT d.doc_id, coalesce(o.sentence_ids, '') AS sentence_ids, coalesce(array_to_string(o.names, ','), '') AS licenses, coalesce(o.n_generic, 0)::BIGINT AS n_generic
FROM documents d LEFT JOIN {at} o USING (doc_id)
"""


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP10_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), '{linededup.UPPER}', '{linededup.LOWER}')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, c) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""

OP7_SQL = f"""
WITH words AS (
    SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
    SELECT s, min(doc_id) AS d FROM windows GROUP BY s
), removed AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE d < doc_id
), spread AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
    SELECT s.doc_id, count(*) FILTER (r.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY s.i) FILTER (r.i IS NULL) AS t
    FROM spread s LEFT JOIN removed r ON s.doc_id = r.doc_id AND s.i = r.i GROUP BY s.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = rf"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce([b] || repeat([0], 8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crcs FROM (SELECT unnest(range(256)) AS b)
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{linededup.UPPER}', '{linededup.LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), runs AS (
    SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM found GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295) AS h FROM runs, bits
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cuts AS (
    SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word AS a, b.word AS b, a.n AS na, b.n AS nb FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
    UNION
    SELECT w.word, c.word, w.n, c.n FROM words w JOIN cuts c ON w.word = c.rest
), near AS (
    SELECT a AS word, b AS other, nb AS n FROM pairs UNION ALL SELECT b, a, na FROM pairs
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), onward(word, root, depth) AS (
    SELECT word, word, 0 FROM formed UNION ALL SELECT o.word, f.form, depth + 1 FROM onward o JOIN formed f ON f.word = o.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM onward GROUP BY word) USING (word)
"""

TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{linededup.UPPER}', '{linededup.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH terms AS (
    SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY term, nd
), wanted AS (
    SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_text": op2_html_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii_scan": op5_pii_scan,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES: dict[str, str] = {"op7_substring_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_license_scan": _license_sql(), "op10_near_duplicates": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_ranked_search": OP12_SQL}
