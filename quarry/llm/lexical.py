"""Ranked lexical search with hashed max-sketches: exact top-k of BM25-like integer scores.

``build`` reads the texts once. A document's term frequencies fold into a sketch: each
term has a coordinate (its hash modulo the sketch's size), and a coordinate holds the
largest frequency of its terms, as a one-byte code that is rounded up. A term's impact
in a document rises with its frequency, so the coordinatewise maximum of frequencies is
that of impacts, and an index need not change when the corpus' statistics do. A sketch
has eight to sixteen coordinates for each distinct term (at most ``MOST_COORDINATES``;
beyond, bounds only get looser). The same pass counts the documents of each term, added
up within tasks.

``Index.search`` takes queries in blocks of bounded size. (1) Each query term looks up
its coordinate in every sketch; the sum of what it finds is an upper bound of the
document's score. (2) The k documents with the largest bounds of each query are scored
exactly from their texts, and the k-th score is the query's threshold. (3) Documents
whose bound reaches the threshold are scored exactly in descending order of their
bounds; tasks raise the threshold as they go and leave out what can't reach it. Ties at
the threshold are scored, so the result is that of scoring everything.

Tables: sketches and term counts are written; candidates meet the texts in a join on
row keys that Spark broadcasts or shuffles by their size. Top-k lists are cut in tasks
before they are shuffled. The driver holds one block of queries, never documents.

Defined cases: null or empty text has no terms and is not ranked; a null doc_id comes
after all others of its score; repeated documents are ranked each; repeated queries (same
id and text) count once; queries without terms that some document holds give no rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.names import names_of

#: Letters, digits and what is beyond ASCII stay, A-Z in lower case; all else is a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FEWEST_COORDINATES, MOST_COORDINATES = 1 << 6, 1 << 20
#: A task's term counts go out whenever it holds this many terms.
HELD_TERMS = 1_000_000
#: Distinct (query, term) pairs of a block, on average.
BLOCK_TERMS = 200_000
BATCH_BYTES = 16_000_000
#: The largest frequency that each code stands for: itself, then steps of a seventh.
CODES = np.array([*range(129), *[min(int(128 * 1.15**k) + 1, 1 << 32) for k in range(1, 126)], 1 << 32], np.int64)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def sketch(counts: dict[bytes, int]) -> np.ndarray:
    """Largest frequency code of each coordinate."""
    size = min(max(FEWEST_COORDINATES, 1 << (8 * len(counts) - 1).bit_length()), MOST_COORDINATES)
    out = np.zeros(size, np.uint8)
    codes = np.searchsorted(CODES, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    order = np.argsort(codes, kind="stable")  # of several writes to a coordinate the last one stays
    out[(names_of(counts.keys()) & np.uint64(size - 1)).astype(np.int64)[order]] = codes[order]
    return out


@dataclass(frozen=True)
class Corpus:
    """Documents with terms, and all their terms."""

    documents: int
    terms: int

    def damping(self, n: int) -> int:
        return 25 + 75 * n * self.documents // self.terms


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """Queries of a block: their terms, and per term the queries that hold it with weight times repeats."""

    def __init__(self, rows: list[tuple[int, int, str, int]]):
        """``rows`` are (number of the query, item_id, term, weight times repeats)."""
        self.items = {q: item for q, item, _, _ in rows}
        self.size = 1 + max(self.items)
        terms = sorted({t for _, _, t, _ in rows})
        self.term_numbers = {t.encode(): k for k, t in enumerate(terms)}
        ordered = sorted((self.term_numbers[t.encode()], q, w) for q, _, t, w in rows)
        number, self.query, self.weight = (np.array(c, np.int64) for c in zip(*ordered, strict=True))
        self.starts = np.searchsorted(number, np.arange(len(terms) + 1))
        self.hashes = names_of([t.encode() for t in terms])

    def bounds(self, codes: np.ndarray, m: int) -> np.ndarray:
        """Upper bound of a document's score for each query, from its sketch."""
        found = codes[(self.hashes & np.uint64(len(codes) - 1)).astype(np.int64)]
        held = np.flatnonzero(found)
        tf = CODES[found[held]]
        counts = self.starts[held + 1] - self.starts[held]
        at = np.arange(counts.sum()) + np.repeat(self.starts[held] - (np.cumsum(counts) - counts), counts)
        impacts = np.repeat(1_000_000_000 * tf // (1000 * tf + 8 * m), counts)
        # sums of whole numbers below 2**53; the last factor covers rounding beyond
        return np.bincount(self.query[at], self.weight[at] * impacts, self.size) * (1 + 1e-12)

    def scores(self, counts: dict[bytes, int], m: int, queries: set[int]) -> dict[int, int]:
        """Exact scores of a document for some queries."""
        out = dict.fromkeys(queries, 0)
        for term, tf in counts.items():
            k = self.term_numbers[term]
            worth = impact(tf, m)
            for at in range(self.starts[k], self.starts[k + 1]):
                if (q := int(self.query[at])) in out:
                    out[q] += int(self.weight[at]) * worth
        return out


def build(docs: DataFrame) -> Index:
    """Sketches of all documents and document counts of all terms, in shared scratch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL("kind string, _id bigint, _rk bigint, n bigint, sketch binary, term string, df bigint")
    schema = to_arrow_schema(out)

    def batch_of(kind, **columns):
        size = len(next(iter(columns.values())))
        columns["kind"] = [kind] * size
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def terms(held: Counter):
        return batch_of("terms", term=[t.decode() for t in held], df=list(held.values()))

    def run(batches):
        held: Counter = Counter()
        rows, size = [], 0
        for batch in batches:
            for _id, _rk, text in zip(batch.column("_id").to_pylist(), batch.column("_rk").to_pylist(), batch.column("text"), strict=True):
                counts = Counter(terms_of(text.as_py()))
                held.update(counts.keys())
                folded = sketch(counts).tobytes() if counts else b""
                rows.append((_id, _rk, counts.total(), folded))
                size += len(folded)
                if size >= BATCH_BYTES:
                    yield batch_of("documents", **dict(zip(("_id", "_rk", "n", "sketch"), zip(*rows, strict=True), strict=True)))
                    rows, size = [], 0
                if len(held) >= HELD_TERMS:
                    yield terms(held)
                    held = Counter()
        if rows:
            yield batch_of("documents", **dict(zip(("_id", "_rk", "n", "sketch"), zip(*rows, strict=True), strict=True)))
        if held:
            yield terms(held)

    rows = common.texts(docs).select(*common.row_key(), "text").mapInArrow(lambda batches: common.released(run(batches)), out)
    return Index(docs, common.materialise(rows, "sketches", "kind"))


class Index:
    """Sketches and term counts of a document table."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        self.docs = docs
        self.sketches = rows.filter("kind = 'documents'").select("_id", "_rk", "n", "sketch").filter("n > 0")
        self.terms = rows.filter("kind = 'terms'").select("term", "df")
        found = self.sketches.agg(F.count("*"), F.sum("n")).first()
        self.corpus = Corpus(found[0], found[1] or 0)

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """(q, item_id, term, weight) of the terms of queries that some document holds; ``weight`` is times repeats, ``q`` one hash a query."""
        rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
        found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))
        rows = rows.select(F.xxhash64("item_id", "text").alias("q"), "item_id", F.explode(found).alias("term"))
        rows = common.materialise(rows.groupBy("q", "item_id", "term").agg(F.count("*").alias("repeats")), "query-terms")
        df = self.terms.join(rows.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.corpus.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        return common.materialise(rows.join(df, "term").select("q", "item_id", "term", (weight * F.col("repeats")).alias("weight")), "weights")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(item_id, rank, doc_id, score) of the ``k`` best documents of each row of ``queries`` (item_id, text)."""
        spark = self.docs.sparkSession
        terms = self.query_terms(queries)
        blocks = -(-terms.count() // BLOCK_TERMS)
        out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
        for number in range(blocks):
            own = terms.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number)
            numbers: dict[int, int] = {}
            rows = [(numbers.setdefault(r.q, len(numbers)), r.item_id, r.term, r.weight) for r in own.toLocalIterator()]
            if rows:
                out = out.unionByName(self._search(spark, Block(rows), k))
        return out

    def _search(self, spark: SparkSession, block: Block, k: int) -> DataFrame:
        best = self._best_bounds(block, k)
        probes = self._rescored(best, block, k, np.ones(block.size, np.int64))
        kth = probes.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
        threshold = np.ones(block.size, np.int64)
        for row in kth.toLocalIterator():  # one number a query of the block
            threshold[row.q] = row.score
        candidates = common.materialise(self._reaching(block, threshold), "candidates")
        rows = self._rescored(candidates, block, k, threshold)
        return rows.select("item_id", F.col("rank"), "doc_id", "score")

    def _best_bounds(self, block: Block, k: int) -> DataFrame:
        """(_id, _rk, queries, bounds) of the documents that are among the ``k`` of largest bound of some query."""
        import pyarrow as pa

        corpus = self.corpus

        def run(batches):
            top, ids, keys = np.zeros((0, block.size)), np.zeros((0, block.size), np.int64), np.zeros((0, block.size), np.int64)
            for batch in batches:
                own = [block.bounds(np.frombuffer(s.as_buffer(), np.uint8), corpus.damping(n)) for s, n in zip(batch.column("sketch"), batch.column("n").to_pylist(), strict=True)]
                spread = lambda c: np.repeat(batch.column(c).to_numpy()[:, None], block.size, 1)  # noqa: B023, E731
                top, ids, keys = np.vstack([top, *own]), np.vstack([ids, spread("_id")]), np.vstack([keys, spread("_rk")])
                if len(top) > k:
                    at = np.argpartition(-top, k - 1, axis=0)[:k]
                    top, ids, keys = (np.take_along_axis(x, at, 0) for x in (top, ids, keys))
            where = np.nonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(keys[where]), pa.array(where[1].astype(np.int32)), pa.array(top[where])], ["_id", "_rk", "q", "bound"])

        rows = self._by_block(block).mapInArrow(run, "_id bigint, _rk bigint, q int, bound double")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "_id", "_rk")
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        grouped = rows.groupBy("_id", "_rk").agg(F.collect_list(F.struct("q", "bound")).alias("found"))
        return common.materialise(grouped.select("_id", "_rk", F.col("found.q").alias("queries"), F.col("found.bound").alias("bounds")), "probes")

    def _by_block(self, block: Block) -> DataFrame:
        """Sketches in batches whose bounds take a few megabytes."""
        common.bound_batches(self.docs.sparkSession, max(16, min(1000, 4_000_000 // block.size)))
        return self.sketches

    def _reaching(self, block: Block, threshold: np.ndarray) -> DataFrame:
        """(_id, _rk, queries, bounds) of every document with the queries whose threshold its bound reaches."""
        import pyarrow as pa

        corpus = self.corpus

        def run(batches):
            for batch in batches:
                at, queries, bounds = [], [], []
                for row, (s, n) in enumerate(zip(batch.column("sketch"), batch.column("n").to_pylist(), strict=True)):
                    own = block.bounds(np.frombuffer(s.as_buffer(), np.uint8), corpus.damping(n))
                    if len(reached := np.flatnonzero(own >= threshold)):
                        at.append(row)
                        queries.append(reached.astype(np.int32))
                        bounds.append(own[reached])
                if at:
                    kept = batch.select(["_id", "_rk"]).take(pa.array(at))
                    offsets = pa.array(np.cumsum([0, *map(len, queries)]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, np.concatenate(c)) for c in (queries, bounds)]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *lists], ["_id", "_rk", "queries", "bounds"])

        return self._by_block(block).mapInArrow(run, "_id bigint, _rk bigint, queries array<int>, bounds array<double>")

    def _rescored(self, candidates: DataFrame, block: Block, k: int, threshold: np.ndarray) -> DataFrame:
        """(q, item_id, doc_id, score, rank): the ``k`` best of the candidates by exact score, those below the threshold left out."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        corpus, names = self.corpus, block.term_numbers
        out = StructType.fromDDL("q int, item_id bigint, doc_id bigint, score bigint")
        schema = to_arrow_schema(out)

        def run(batches):
            least = threshold.astype(np.float64)
            best: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("doc_id", "queries", "bounds")]
                for row, (doc_id, queries, bounds) in enumerate(zip(*columns, strict=True)):
                    open_queries = {q for q, bound in zip(queries, bounds, strict=True) if bound >= least[q]}
                    if not open_queries:
                        continue
                    terms = terms_of(batch.column("text")[row].as_py())
                    counts = Counter(t for t in terms if t in names)
                    for q, score in block.scores(counts, corpus.damping(len(terms)), open_queries).items():
                        if score < least[q] or score <= 0:
                            continue
                        own = best.setdefault(q, [])
                        rank = (score, -doc_id if doc_id is not None else common.NULL_ID)
                        if len(own) < k:
                            heapq.heappush(own, rank)
                        else:
                            heapq.heappushpop(own, rank)
                        if len(own) == k:
                            least[q] = max(least[q], own[0][0])
            rows = [(q, block.items[q], None if i == common.NULL_ID else -i, score) for q, own in best.items() for score, i in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        key = ["_id", "_rk"]
        texts = common.texts(self.docs).select("doc_id", "text", *common.row_key())
        rows = texts.join(candidates.dropDuplicates(key), key).select("doc_id", "text", "queries", "bounds")
        rows = rows.sortWithinPartitions(F.desc(F.array_max("bounds"))).mapInArrow(lambda batches: common.released(run(batches)), out)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, of all documents."""
    return build(docs).search(queries, k)
