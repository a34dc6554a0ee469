"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; a pair of a good and a bad document is a preference, whose
probability is the logistic function of the difference in strength.  Weights come from the logistic loss on feature
differences over pairs drawn from labelled documents.  The features are shape ratios of the whole text, each cut
into bins at the quantiles of the training rows, so that strength may bend in each of them, and the words of the whole text:
which of ``BUCKETS`` hash buckets they fall into, over the square root of how many do.

The decision is a quantile of the training scores: of all, the one that best separates the labels.  The score is a
logistic function of strength that takes the value ``CUT`` there.

Training uses at most ``SAMPLE`` labelled documents a label, the first by a hash of their ids; all other work covers every row.

Rows: null text counts as empty; empty texts are scored as well.  A document labelled more than once counts once as each of
its labels; of rows that share a doc_id the first by a hash of the text is the one that is learned from.  Repeated rows get
equal scores.  An empty table gives an empty result; without labels of both kinds every
score is 0.5.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.shingles import U, buffers, word_hashes
from gristmill.storage import materialize

SAMPLE = 10_000
BINS = 16
BUCKETS = 4096
PAIRS = 60_000
STEPS = 200
#: how strongly weights are held near 0: those of bins, and those of words, of which there are many
HOLD, HOLD_WORDS = 1e-4, 3e-3
CUT = 0.3
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 4
_CLASSES[[9, 10, 11, 12, 13, 32]] = 5
_CLASSES[[ord(c) for c in "!?"]] = 6
_CLASSES[[ord(c) for c in "#*$%&|<>{}[]\\/_=+~^@"]] = 7
_CLASSES[[ord(c) for c in ".,;:'\"()-"]] = 8


def shape(text: str) -> list[float]:
    """Ratios of characters, words and lines of one whole text."""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw) - kinds[5])
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    runs = sum(map(str.__eq__, words, words[1:]))
    ends = sum(1 for x in lines if x.rstrip()[-1:] in ".!?:;")
    return [
        math.log1p(len(words)),
        *(kinds[k] / size for k in (1, 2, 3, 4, 6, 7, 8)),
        size / n,
        len(distinct) / n,
        len(distinct) / math.sqrt(n),
        runs / n,
        1 - len(set(lines)) / m,
        math.log1p(n / m),
        ends / m,
        raw.count(b" | ") / n,
        raw.count(b"!!") / n,
        raw.count(b". ") / n,
    ]


class Words:
    """The distinct buckets of each text's words, one text after the other, and how many each text has."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.share = 1 / np.sqrt(np.maximum(counts, 1))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], len(self.counts)) * self.share


def words_of(texts: pa.Array) -> Words:
    hashes, at = word_hashes(*buffers(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    found = np.unique(owner * BUCKETS + (hashes >> U(64 - 12)).astype(np.int64))
    return Words(found % BUCKETS, np.bincount(found // BUCKETS, minlength=len(texts)))


def shapes(docs: DataFrame, extra: list[str]) -> DataFrame:
    """x, words (buckets) and the ``extra`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                values, words = [shape(t or "") for t in part.column(0).to_pylist()], words_of(part.column(0))
                ends = np.concatenate([[0], np.cumsum(words.counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.flat.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), lists, *part.columns[1:]], ["x", "words", *extra])

    rows = docs.select(F.col("text").cast("string").alias("text"), *extra)
    return rows.mapInArrow(run, "x array<double>, words array<smallint>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]))


class Ranker:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, of_words: np.ndarray, middle: float = 0.0, scale: float = 1.0, quantile: float = 0.0):
        self.edges, self.weights, self.of_words, self.middle, self.scale, self.quantile = edges, weights, of_words, middle, scale, quantile

    def cells(self, x: np.ndarray) -> np.ndarray:
        """For each row the index of its bin in each feature, into the flat weights."""
        return np.stack([np.searchsorted(e, x[:, j], "right") + j * BINS for j, e in enumerate(self.edges)], axis=1)

    def strength(self, x: np.ndarray, words: Words | None = None) -> np.ndarray:
        return self.weights[self.cells(x)].sum(axis=1) + (words.sums(self.of_words) if words else 0.0)

    def score(self, x: np.ndarray, words: Words | None = None) -> np.ndarray:
        return self.from_strength(self.strength(x, words))

    def from_strength(self, strength: np.ndarray) -> np.ndarray:
        z = self.scale * (strength - self.middle) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    def __init__(self, w: np.ndarray, hold: float, rate: float = 0.1):
        self.w, self.hold, self.rate, self.m, self.v, self.t = w, hold, rate, np.zeros_like(w), np.zeros_like(w), 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        grad = grad + self.hold * self.w
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-9)


def fit(x: np.ndarray, y: np.ndarray, words: Words | None = None, pairs: int = PAIRS, steps: int = STEPS, seed: int = 3) -> Ranker | None:
    """None without labels of both kinds.  Rows must be in an order that doesn't change between runs."""
    if len(set(y.tolist())) < 2:
        return None
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    model = Ranker(edges, np.zeros(x.shape[1] * BINS), np.zeros(BUCKETS))
    cells, rng = model.cells(x), np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    shape_step, word_step = Adam(model.weights, HOLD), Adam(model.of_words, HOLD_WORDS, 0.03)
    for _ in range(steps):
        s = model.weights[cells].sum(axis=1) + (words.sums(model.of_words) if words else 0.0)
        lose = 1 / (1 + np.exp(np.clip(s[good] - s[bad], -30, 30))) / pairs
        pull = np.bincount(bad, lose, len(y)) - np.bincount(good, lose, len(y))  # of each row's strength, as all its pairs have it
        shape_step.step(np.bincount(cells.ravel(), np.repeat(pull, cells.shape[1]), len(model.weights)))
        if words:
            word_step.step(np.bincount(words.flat, (pull * words.share)[words.owner], BUCKETS))
    s = model.weights[cells].sum(axis=1) + (words.sums(model.of_words) if words else 0.0)
    order = np.argsort(s, kind="stable")
    ranked, ys = s[order], y[order]
    lost, caught = np.concatenate([[0], np.cumsum(ys == 1)]) / (y == 1).sum(), np.concatenate([[0], np.cumsum(ys == 0)]) / (y == 0).sum()
    usable = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    k = int(np.argmax(np.where(usable, caught - lost, -1)))
    low, high = ranked[max(0, k - 1)], ranked[min(len(s) - 1, k)]
    model.quantile, model.middle, model.scale = k / len(s), float(low + high) / 2, 2.0 / max(1e-6, float(np.std(s)))
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def chosen(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y: of each label the first ``sample`` documents by hash, stored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1)).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    # twice as many by hash alone, so that only those are put in order
    top = lambda y: min(1.0, 2 * sample / max(1, counts.get(y, 0))) * float(1 << 62)
    hashed = known.withColumn("h", F.xxhash64("doc_id", F.lit("bt")).bitwiseAND(F.lit((1 << 62) - 1)))
    near = hashed.where(F.col("h") <= F.when(F.col("y") == 1, top(1)).otherwise(top(0)))
    first = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))
    return materialize(near.withColumn("k", first).where(F.col("k") <= sample).select("doc_id", "y"), "bt-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker | None:
    # at most 2 * sample rows of 12 bytes; one text of each document
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen(labels, sample)), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = shapes(one, ["doc_id", "y"]).toPandas().sort_values(["doc_id", "y"], kind="stable")
    if not len(got):
        return None
    words = Words(np.concatenate([np.asarray(w, np.int64) for w in got["words"]]), np.array([len(w) for w in got["words"]]))
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy(), words)


def scores(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """doc_id, held_out, score, predicted, strength."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                if model is None:
                    s = strength = np.full(len(part), 0.5)
                else:
                    strength = model.strength(np.array([shape(t or "") for t in part.column(2).to_pylist()]), words_of(part.column(2)))
                    s = model.from_strength(strength)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(strength)], ["doc_id", "held_out", "score", "predicted", "strength"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, strength double")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
