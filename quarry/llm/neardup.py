"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct ``SHINGLE``-word shingles (A-Z in lower case; the
whole sequence where there are fewer words). Documents with equal sets are one
class. Of ``MINIMA`` minima of a class, bands of ``ROWS`` give bucket keys; the low
``BITS`` bits of all minima are packed into longs, and the similarity of a candidate
pair is estimated by counting differing fields, corrected for chance collisions.
Parities of set sizes by hash cell bound the difference of two sets from below by
another bit count. Pairs that neither excludes are confirmed on the full sets.

Links decide components, so not all pairs of a bucket are needed. First every
member is compared with a few centres of its bucket (smallest id, smallest hashes).
Then, in buckets that still hold several components, the members outside the
largest one are compared with all members of other components. No link between
different components is left out; pairs within a component can change nothing.

Odds, for independent minima: a pair at the threshold shares no band with probability
(1 - 0.85^5)^25 = 4e-7, and falls under the estimate's margin (five standard
deviations) with less than 1e-6. A test measures both on pairs just over the threshold.

Defined cases: null or empty text and text without words have an empty set, are
linked with nothing and kept; a null doc_id is a document that sorts first and is
returned as null; repeated rows (same id) are one document when their sets are
equal, and each row is returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, graph
from quarry.llm.names import names_of

SHINGLE, MINIMA, ROWS, BANDS, BITS = 5, 128, 5, 25, 4
PACKED = MINIMA * BITS // 64
CELLS = 1024
FIELDS = [f"s{k}" for k in range(PACKED)]
PARITIES = [f"p{k}" for k in range(CELLS // 64)]
SIGNATURE = FIELDS + PARITIES
MARGIN = 0.16
#: Candidates up to this many (16 bytes each) are broadcast to fetch their sets; beyond, a shuffled semi-join does.
BROADCAST_ROWS = 1_000_000
CENTRES = 3
CLASS = "struct<d0: bigint, d1: bigint>"

WORDS = re.compile(common.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(2024)
FACTORS = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | 1).astype(np.uint32)
OFFSETS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    names = names_of(words)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = (out ^ (out >> np.uint64(32))) * PRIME + names[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(own: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048, None] * FACTORS + OFFSETS).min(0), out=out)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket key a band; the band is part of the key."""
    rows = found[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * PRIME + rows[:, k]
    return ((key ^ (key >> np.uint64(32))) * PRIME).view(np.int64)


def packed(found: np.ndarray) -> np.ndarray:
    """Low bits of all minima, as signed longs."""
    fields = (found & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(PACKED, -1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(fields << shifts, axis=1).view(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of ``CELLS`` cells of the hash space holds an odd number of shingles, as signed longs."""
    odd = np.bincount(((own >> np.uint64(16)) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(_id, _rk, doc_id, n_shingles, d0, d1, s0.., bands) of every row; d0 and d1 name the set."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_rk", pa.int64()), ("n_shingles", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), *[(s, pa.int64()) for s in SIGNATURE], ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, names, packs, bands = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingles(text)
                    n.append(len(own))
                    names.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64))
                    found = minima(own)
                    packs.append(np.concatenate([packed(found), parities(own)]))
                    bands.append(band_keys(found).tolist() if len(own) else [])
                packs, names = np.array(packs).reshape(-1, len(SIGNATURE)), np.array(names).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_id"), part.column("_rk"), pa.array(n, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), *[pa.array(packs[:, k]) for k in range(len(SIGNATURE))], pa.array(bands, pa.list_(pa.int64()))],
                    schema=schema,
                )

    rows = common.texts(docs).select("doc_id", "text", *common.row_key())
    kinds = "doc_id bigint, _id bigint, _rk bigint, n_shingles bigint, d0 bigint, d1 bigint, " + ", ".join(f"{s} bigint" for s in SIGNATURE) + ", bands array<bigint>"
    return rows.mapInArrow(lambda batches: common.released(run(batches)), kinds)


def estimate(a: str, b: str) -> Column:
    """Similarity by counts of equal fields, corrected for fields that are equal by chance."""
    ones = F.lit(int("1" * (64 // BITS), 16))
    differ = F.lit(0)
    for s in FIELDS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        y = x
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(y.bitwiseAND(ones))
    match = 1 - differ / F.lit(float(MINIMA))
    chance = 2.0**-BITS
    return (match - chance) / (1 - chance)


def least_difference(a: str, b: str) -> Column:
    """Cells of different parity: the symmetric difference of the sets is at least as large."""
    out = F.lit(0)
    for p in PARITIES:
        out = out + F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    return out


def may_link(a: str, b: str, percent: int) -> Column:
    """Neither the set sizes, nor the estimate, nor the parities exclude a link."""
    small, great = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    near = least_difference(a, b) * (100 + percent) <= (small + great) * (100 - percent)
    return (small * 100 >= great * percent) & near & (estimate(a, b) >= percent / 100 - MARGIN)


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, hashes) of the wanted classes (class, rep, rep_rk): full shingle sets of their representatives."""
    import pyarrow as pa

    rows = common.texts(docs).select("text", *common.row_key())
    wanted = wanted.select(F.col("rep").alias("_id"), F.col("rep_rk").alias("_rk"), "class").dropDuplicates(["_id", "_rk"])
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(sets, pa.binary())], names=["class", "hashes"])

    found = rows.join(wanted, ["_id", "_rk"]).select("class", "text")
    return found.mapInArrow(lambda batches: common.released(run(batches)), f"class {CLASS}, hashes binary").dropDuplicates(["class"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of classes whose full sets reach the threshold."""
    import pyarrow as pa

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                shared = int((q[at] == p).sum()) if len(q) else 0
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lambda batches: common.released(run(batches)), f"a {CLASS}, b {CLASS}")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.class", f"{y}.class").alias("a"), F.greatest(f"{x}.class", f"{y}.class").alias("b")]


def linked_classes(docs: DataFrame, classes: DataFrame, member: DataFrame, body: DataFrame, percent: int) -> DataFrame:
    """(class, component) of the classes that links join; ``member``: (class, bucket, centres) of buckets of several classes."""
    near = member.select("class", F.explode("centres").alias("y")).filter(F.col("class") != F.col("y"))
    near = near.select(F.least("class", "y").alias("a"), F.greatest("class", "y").alias("b")).distinct()
    tried = near.join(body.alias("x"), F.col("a") == F.col("x.class")).join(body.alias("y"), F.col("b") == F.col("y.class"))
    tried = common.materialise(tried.filter(may_link("x", "y", percent)).select("a", "b"), "tried")
    wanted = classes.select("class", "rep", "rep_rk").join(member.select("class").distinct(), "class", "left_semi")
    sets = common.materialise(candidate_sets(docs, wanted), "sets")
    label = graph.components(common.materialise(confirmed(tried, sets, percent), "links"))
    # Members outside the largest component of their bucket against the other components' members.
    state = member.select("class", "bucket").join(label.withColumnsRenamed({"node": "class", "component": "part"}), "class", "left")
    state = common.materialise(state.withColumn("part", F.coalesce("part", "class")), "state")
    parts = state.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts"))
    parts = parts.filter("parts > 1").select("bucket", F.col("most.part").alias("largest"))
    open_ = common.materialise(state.join(parts, "bucket").join(body, "class"), "open")
    outside = open_.filter(F.col("part") != F.col("largest"))
    more = outside.alias("x").join(open_.alias("y"), F.col("x.bucket") == F.col("y.bucket"))
    more = more.filter((F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.largest")) | (F.col("x.class") < F.col("y.class"))) & may_link("x", "y", percent))
    more = common.materialise(confirmed(more.select(*ordered("x", "y")).distinct().join(tried, ["a", "b"], "left_anti"), sets, percent), "more-links")
    # Components of classes, named by the smallest id of any document in them.
    label = graph.extended(label, more).withColumnsRenamed({"node": "class", "component": "part"}).join(classes.select("class", "rep"), "class")
    name = label.groupBy("part").agg(F.min("rep").alias("component"))
    return common.materialise(label.join(name, "part").select("class", "component"), "components")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, _id, _rk, n_shingles, component_id, kept) of every row."""
    found = common.materialise(signatures(docs), "signatures")
    # Classes of equal sets, named by both halves of the set's name; the representative has the smallest id.
    first = F.min(F.struct("_id", "_rk", "n_shingles", *SIGNATURE, "bands")).alias("top")
    classes = found.filter("n_shingles > 0").groupBy("d0", "d1").agg(first).select(F.struct("d0", "d1").alias("class"), "top.*")
    classes = common.materialise(classes.withColumnsRenamed({"_id": "rep", "_rk": "rep_rk"}), "classes")
    body = classes.select("class", "n_shingles", *SIGNATURE)
    buckets = classes.select("class", "rep", F.explode("bands").alias("bucket"))
    # A few centres of every bucket that holds several classes: ids only, with their bodies once a pair.
    picks = [F.min(F.struct("rep", "class")).alias("c0"), *[F.min(F.struct(F.xxhash64(F.lit(k), "class").alias("h"), "class")).alias(f"c{k}") for k in range(1, CENTRES)]]
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), *picks).filter("n > 1")
    shared = shared.select("bucket", F.array_distinct(F.array(*[f"c{k}.class" for k in range(CENTRES)])).alias("centres"))
    member = common.materialise(buckets.select("class", "bucket").join(shared, "bucket"), "members")
    linked = linked_classes(docs, classes, member, body, percent) if not member.isEmpty() else classes.select("class", F.col("rep").alias("component")).limit(0)
    rows = found.select("doc_id", "_id", "_rk", "n_shingles", F.struct("d0", "d1").alias("class"))
    rows = rows.join(classes.select("class", "rep"), "class", "left").join(linked, "class", "left")
    lone = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("_id"))
    component = F.coalesce("component", lone)
    return rows.select(
        "doc_id", "_id", "_rk", "n_shingles",
        F.when(component != common.NULL_ID, component).alias("component_id"), (F.col("_id") == component).alias("kept"),
    )


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows of ``docs``, with their own columns, whose id names their component."""
    gone = common.materialise(near_duplicates(docs, percent).filter(~F.col("kept")).select("_id", "_rk").distinct(), "not-kept")
    rows = common.keyed_rows(docs)
    gone = gone.select(F.struct("_id", "_rk").alias("_key"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    return common.plain_rows(rows.join(gone, "_key", "left_anti"), docs)
