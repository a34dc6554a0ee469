"""Near-duplicate groups by min-max hashing, with every link confirmed on the full shingle sets.

Each of ``permutations`` hash functions gives two entries of a signature, the least and the greatest value over a
document's shingles, so that half the evaluations fill it.  Both agree for two sets with a probability equal to their
Jaccard similarity.  Bands of ``rows`` entries bring candidates together.

1. Documents with equal shingle sets (a 128-bit fingerprint) become one class, stood for by its least doc_id.  A class's
   members are found, and told their component, in groups dealt by doc_id, so that a class of any size is many tasks.
2. In every bucket that classes share, all members meet the bucket's least one; the sets of such pairs are compared in
   full, in cells of one least member and a bounded number of rows and shingles; links give components.
3. Buckets that still hold several components are dealt to cells: a bucket's members in blocks of about ``cell_rows`` rows
   and ``cell_shingles`` shingles at most, every two blocks one cell.  A cell counts all its intersections at once, as a
   product of the matrix of members and the shingles that occur twice in it, and returns the links that join components.

So no pair is ever a row unless its members meet in a star or are linked, and no candidate is given up.  With 44 bands
of 5 rows a pair at similarity 0.75 shares no bucket with a probability below 1e-5.

Rows: null, empty or blank text has an empty set, is linked with nothing and kept.  Fewer words than a shingle are one
shingle.  Rows that share a doc_id are one document (its texts' links are joined).  A null doc_id is linked with
nothing: component_id null, kept.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.shingles import U, mixed, shingle_sets
from gristmill.llm.token_files import slices
from gristmill.operators.components import connected_components
from gristmill.operators.skew import lookup
from gristmill.storage import discard, materialize, small_batches

SHINGLE_WORDS = 5
PERMUTATIONS = 110
ROWS = 5
PERCENT = 75
#: Members of a bucket in a block, and their shingles; blocks of a bucket meet two by two.
CELL_ROWS = 256
CELL_SHINGLES = 250_000
#: Groups that the members of a class are dealt to.
SALTS = 256
#: Rows that go to Python at once: texts and sets may be long.
BATCH_ROWS = 500
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 500_000
_STRIP = 8192


class MinMaxHasher:
    """Signatures of 2 * permutations entries and their band keys."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = 1):
        values = mixed(np.arange(1, 2 * permutations + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
        self.xor, self.mul = values[:permutations, None], values[permutations:, None] | U(1)
        self.rows = rows
        self.bands = 2 * permutations // rows
        self.factors = mixed(np.arange(11, 11 + rows, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
        self.salt = mixed(np.arange(1, self.bands + 1, dtype=U))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(shingles), 1024):
            h = (shingles[None, i : i + 1024] ^ self.xor) * self.mul
            a, b = h.min(axis=1), h.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.concatenate([low, high])

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        used = mixed(signature[: self.bands * self.rows].reshape(self.bands, self.rows))
        return mixed((used * self.factors).sum(axis=1, dtype=U) + self.salt)


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (two longs), band keys (null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMaxHasher(permutations, rows)
        for b in slices(batches, SLICE_BYTES):
            sizes, one, two, keys = [], [], [], []
            for s in shingle_sets(b.column(1), n):
                sizes.append(len(s))
                one.append(mixed(s ^ U(0x5BD1E995)).sum(dtype=U).astype(np.int64))
                two.append(mixed(s + U(0x1B873593)).sum(dtype=U).astype(np.int64))
                keys.append(hasher.band_keys(hasher.signature(s)).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print_a", "print_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its whole shingle set, as sorted 64-bit integers, of the documents in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            found = shingle_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary")


def _cells(rows: Column, shingles: Column, cell_rows: int) -> Column:
    """Into how many cells so many rows and shingles go."""
    return F.greatest(F.ceil(rows / cell_rows), F.ceil(shingles / CELL_SHINGLES), F.lit(1)).cast("int")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The pairs (a, b, nb) whose full sets reach the similarity.  In a cell, the set of one a meets those of some of its b."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    by = pairs.groupBy("a").agg(_cells(F.count(F.lit(1)), F.sum("nb"), cell_rows).alias("cells"))
    dealt = lookup(pairs, by, ["a"], "b").select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.col("cells")).cast("int").alias("cell"))
    many = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    one = by.join(sets, F.col("a") == F.col("doc_id")).select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("part"), F.col("shingles").alias("set_a"))
    met = many.join(one, (F.col("a") == F.col("pivot")) & (F.col("cell") == F.col("part")))
    return met.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def joining_links(docs: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join what they join."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column, owner = (np.cumsum(shared) - 1)[at], np.repeat(np.arange(m), sizes)
    use = shared[at]
    column, owner = column[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), np.float32)  # counts stay far below 2 ** 24
    for first in range(0, int(shared.sum()), _STRIP):
        lo, hi = np.searchsorted(column, [first, first + _STRIP])
        strip = np.zeros((m, min(_STRIP, int(shared.sum()) - first)), np.float32)
        strip[owner[lo:hi], column[lo:hi] - first] = 1
        both += strip @ strip.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= parts[:, None] != parts[None, :]
    found, top = [], {p: p for p in parts.tolist()}

    def root(p: int) -> int:
        while top[p] != p:
            top[p] = top[top[p]]
            p = top[p]
        return p

    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(parts[i])), root(int(parts[j]))
        if a != b:
            top[a] = b
            found.append((int(docs[i]), int(docs[j])))
    return found


def _between_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members (band, key, doc, part, blocks) that share a bucket and not a component."""

    def compare(cell: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(x.as_buffer(), U) for x in cell["shingles"]]
        links = joining_links(cell["doc"].to_numpy(), cell["part"].to_numpy(), sets_, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "part")
    full = dealt.join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    return full.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")


def _classes(real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts: a row for each group (s) of a class's members; classes: print_a, print_b, n_shingles, rep, other.  Stored."""
    parts = real.groupBy(*_PRINT, _group().alias("s")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    parts = materialize(parts, "minmax-parts")
    return parts, materialize(parts.groupBy(*_PRINT).agg(F.min("lo").alias("rep"), F.max("hi").alias("other")), "minmax-classes")


_PRINT = ("print_a", "print_b", "n_shingles")


def _group() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, n: int = SHINGLE_WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text), stored."""
    with small_batches(spark, BATCH_ROWS):
        return _near_duplicates(docs, percent, permutations, rows, n, cell_rows)


def _near_duplicates(docs: DataFrame, percent: int, permutations: int, rows: int, n: int, cell_rows: int) -> DataFrame:
    sig = materialize(signatures(docs, permutations, rows, n), "minmax-signatures")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    several = materialize(real.groupBy("doc_id").count().where("count > 1").select("doc_id"), "minmax-several")
    repeated = several.limit(1).count() > 0
    if repeated:
        real = real.dropDuplicates(["doc_id", *_PRINT])
    parts, classes = _classes(real)

    # one bucket row for each band of each class; buckets of one class are left out
    reps = real.join(classes.select("print_a", "print_b", F.col("rep").alias("doc_id")), ["doc_id", "print_a", "print_b"], "left_semi")
    banded = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min(F.struct("doc", "n")).alias("p"), F.max("doc").alias("other")).where("p.doc <> other")
    shared = materialize(shared.select("band", "key", F.col("p.doc").alias("pivot"), F.col("p.n").alias("na")), "minmax-shared")
    members = materialize(lookup(banded, shared, ["band", "key"], "doc"), "minmax-members")
    sets = full_sets(docs, materialize(members.select(F.col("doc").alias("doc_id")).distinct(), "minmax-candidates"), n)
    sets = materialize(sets.dropDuplicates() if repeated else sets, "minmax-sets")

    pairs = members.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "na", F.col("n").alias("nb"))
    # sizes of documents with several texts say nothing about which of them are alike
    pairs = materialize((pairs if repeated else _fitting(pairs, percent)).groupBy("a", "b").agg(F.max("nb").alias("nb")), "minmax-pairs")
    near = materialize(confirmed(pairs, sets, percent, cell_rows), "minmax-links")
    if repeated:  # the classes that a document of several texts is in
        both = parts.select(*_PRINT, "s").join(classes, list(_PRINT)).select(*_PRINT, "s", "rep")
        ties = real.join(several, "doc_id", "left_semi").withColumn("s", _group()).join(both, [*_PRINT, "s"])
        near = materialize(near.unionByName(ties.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "minmax-links")
    linked = connected_components(near)
    rest = members.select("band", "key", "doc", "n").join(linked, F.col("doc") == F.col("node"), "left").select("band", "key", "doc", "n", F.coalesce("component", "doc").alias("part"))
    rest = materialize(rest, "minmax-members")
    buckets = rest.groupBy("band", "key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), _cells(F.count(F.lit(1)), F.sum("n"), cell_rows).alias("blocks")).where("p0 <> p1")
    open_ = lookup(rest, materialize(buckets.select("band", "key", "blocks"), "minmax-open"), ["band", "key"], "doc")
    more = materialize(_between_components(open_, sets, percent), "minmax-links")
    if more.limit(1).count():
        linked = connected_components(near.unionByName(more))
    found = classes.join(linked, F.col("rep") == F.col("node"), "left").where("component is not null or rep <> other").select(*_PRINT, F.coalesce("component", "rep").alias("component_id"))
    told = parts.select(*_PRINT, "s").join(found, list(_PRINT))
    rows_ = sig.select("doc_id", *_PRINT, F.when(F.col("doc_id").isNotNull(), _group()).alias("s"))
    out = rows_.join(told, [*_PRINT, "s"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "minmax-result")
    discard(sig, parts, classes, shared, sets, members, rest, pairs, near, more)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those of a group's other documents, with their own columns.

    Rows that share a doc_id are one document: one of them stays.
    """
    gone = materialize(near_duplicates(spark, docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "minmax-gone")
    rest = docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rest = rest.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id is null"))
    return rest


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes alone don't rule the similarity out."""
    return pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def op9_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
