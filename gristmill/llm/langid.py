"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is lowered; letters are kept, all else is a gap.  Every three neighbouring characters with a letter are a
subword, hashed into ``BUCKETS``.  The mean of the subwords' embeddings goes through a linear softmax; both are learned by
stochastic gradient descent.  As both are linear, scoring sums one row of (embedding times weights) for each subword.

A fifth of the training rows only serves calibration: a temperature that makes probabilities honest, and the least
confidence from which at least ``ACCEPTED_RIGHT`` of those rows are right.  Predictions below it are marked as rejected.

Training uses at most ``SAMPLE`` rows a language, the first by a hash of their ids, and at most ``ROWS`` in all (but one of
each language): with more than ROWS / SAMPLE languages each gets an equal part.  What comes to the driver of a row are the
buckets of its subwords and how often each comes: at most ``PAIRS`` of these pairs over all rows, each row with an equal part
(the most frequent of its buckets, the lower among equals), however long its text is.

Rows: a text that is null or has no letter is ``und`` with score 0 and rejected.  Without training rows everything is
``und``.  Repeated rows get equal results; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.storage import materialize

BUCKETS = 1 << 15
DIM = 12
SAMPLE = 800
ROWS = 40_000
#: pairs of bucket and count that training takes, 8 bytes each on the driver and as many again while they arrive
PAIRS = 16_000_000
LEAST_PAIRS = 16
#: counts of no more languages than this are broadcast; more are joined by shuffle, none is left out
FEW_LANGUAGES = 1000
EPOCHS = 4
ACCEPTED_RIGHT = 0.995
_SLICE_CHARS = 400_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords in order, and per text the number of its subwords."""
    codes = np.frombuffer("".join(f"\0\0{t.lower()}\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t.lower()) + 4 for t in texts])
    c = np.where(_letter_table()[codes], codes, 0).astype(np.uint32)
    a, b, d = c[:-2], c[1:-1], c[2:]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + d * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - (buckets.bit_length() - 1))
    use = (a | b | d) != 0
    total = np.concatenate([[0], np.cumsum(use), [use.sum()] * 2])
    ends = np.cumsum(sizes)
    return h[use], total[ends] - total[ends - sizes]


class Model:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.names, self.table, self.bias, self.temperature, self.least = names, table, bias, temperature, least

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean logits, and its number of subwords."""
        h, n = subwords(texts)
        out, many = np.zeros((len(texts), len(self.names))), np.flatnonzero(n)
        if len(many):
            starts = (np.cumsum(n) - n)[many]
            for k in range(len(self.names)):
                out[many, k] = np.add.reduceat(self.table[k][h], starts, dtype=np.float64) / n[many]
        return out + self.bias, n

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords, and how often each comes."""
    return np.unique(subwords([text])[0], return_counts=True)


def fit(counted: list[tuple[np.ndarray, np.ndarray]], langs: list[str], calibrate: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model | None:
    """``counted``: the bag of each row; ``calibrate`` marks the rows that only serve calibration."""
    names = sorted(set(langs))
    if not names:
        return None
    places = {x: i for i, x in enumerate(names)}
    y = np.array([places[x] for x in langs])
    rng = np.random.default_rng(seed)
    emb, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    bags = [(u, (c / max(1, c.sum())).astype(np.float32)) for u, c in counted]
    learn = [i for i in np.flatnonzero(~calibrate) if len(bags[i][0])]
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs) + 0.05
        for i in rng.permutation(learn):
            u, c = bags[i]
            rows = emb[u]
            mean = c @ rows
            z = mean @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            emb[u] = rows - rate * np.outer(c * 10, back)
    model = Model(names, np.ascontiguousarray((emb @ w).T.astype(np.float32)), bias)
    held = [i for i in np.flatnonzero(calibrate) if len(bags[i][0])]
    if held:
        z, truth = np.stack([model.table[:, bags[i][0]] @ bags[i][1] for i in held]) + bias, y[held]
        grid = np.geomspace(0.05, 10, 60)

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.probabilities(z)[np.arange(len(truth)), truth], 1e-12)).mean())

        model.temperature = float(min(grid, key=loss))
        p = model.probabilities(z)
        sure, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-sure, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= ACCEPTED_RIGHT)
        model.least = float(sure[order][good[-1]]) if len(good) else 1.0
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def most_frequent(buckets: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many pairs, those with the greatest counts, in order of their buckets."""
    if len(buckets) <= most:
        return buckets, counts
    kept = np.sort(np.lexsort((buckets, -counts))[:most])
    return buckets[kept], counts[kept]


def bags_of(rows: DataFrame, most: int = BUCKETS) -> DataFrame:
    """doc_id, lang, buckets and counts (at most ``most`` of each) of rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [most_frequent(*bag(t), most) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "lang", "buckets", "counts"])

    return rows.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, buckets array<int>, counts array<int>")


def chosen(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> DataFrame:
    """doc_id, lang, text of the training rows: of each language the first by hash, as many as it may have."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")  # a row a language
    few = counts.count()
    each = max(1, min(sample, rows // max(1, few)))
    # twice as many by hash alone, so that only those are put in order
    top = F.when(F.col("n") > 2 * each, F.lit(float(1 << 62)) * 2 * each / F.col("n")).otherwise(float(1 << 62)).alias("top")
    sizes = counts.select("lang", top)
    hashed = known.withColumn("h", F.xxhash64("doc_id", F.lit("lang")).bitwiseAND(F.lit((1 << 62) - 1)))
    near = hashed.join(F.broadcast(sizes) if few <= FEW_LANGUAGES else sizes, "lang").where(F.col("h") <= F.col("top"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    return near.withColumn("k", first).where(F.col("k") <= each).select("doc_id", "lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS, pairs: int = PAIRS) -> Model | None:
    picked = materialize(chosen(docs, sample, rows), "language-sample")
    got = bags_of(picked, max(LEAST_PAIRS, pairs // max(1, picked.count()))).toPandas()
    got["first"] = [tuple(b[:8]) for b in got["buckets"]]
    got = got.sort_values(["doc_id", "lang", "first"], kind="stable")
    ids = got["doc_id"].fillna(0).to_numpy(np.int64)
    calibrate = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(5) == 0
    return fit([(np.asarray(u, np.int32), np.asarray(c, np.int32)) for u, c in zip(got["buckets"], got["counts"], strict=True)], got["lang"].tolist(), calibrate)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, preds, scores = [t or "" for t in b.column(2).to_pylist()], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < _SLICE_CHARS):
                    size += len(texts[j])
                    j += 1
                if model is None:
                    preds += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                else:
                    z, n = model.logits(texts[i:j])
                    p = model.probabilities(z)
                    preds += [model.names[k] if m else "und" for k, m in zip(p.argmax(axis=1).tolist(), n.tolist(), strict=True)]
                    scores += np.where(n > 0, p.max(axis=1), 0.0).tolist()
                i = j
            out = [b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array([q == "und" or s < model.least for q, s in zip(preds, scores, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_lang_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
