"""Operators that learn, by held-out accuracy and defined results on hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import langid, quality_bt

SF = "/root/testdata/sf0.01"


def hard(spark, like):
    return spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 456 !!"), (-4, "word " * 30000), (None, "null id"), (-5, "twice"), (-5, "twice")], "doc_id long, text string").join(like.limit(0).select("doc_id", "lang"), "doc_id", "left")


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_bt.train(docs, labels)
    got = quality_bt.scores(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) and (good.predicted.mean() + (1 - bad.predicted.mean())) / 2 > 0.9
    assert np.mean([g > b for g in good.score for b in bad.score]) > 0.95
    rows = quality_bt.scores(hard(spark, docs), model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_bt.scores(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_bt.train(docs, empty) is None
    assert quality_bt.scores(docs, None).select("score").distinct().count() == 1


def test_pairs_are_won():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    m = quality_bt.fit(x, y, pairs=5000)
    s = m.score(x)
    assert ((s >= quality_bt.CUT) == y).mean() > 0.95 and 0 < m.quantile < 1
    assert np.allclose(quality_bt.fit(x, y, pairs=5000).score(x), s)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    rows = {r["doc_id"]: r for r in langid.identify(hard(spark, docs), model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 and rows[k]["rejected"] for k in (-1, -2, -3))
    assert rows[-4]["lang_pred"] in model.names
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_without_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert model is None
    assert {r[0] for r in langid.identify(docs, model).select("lang_pred").distinct().collect()} == {"und"}


@pytest.mark.parametrize("texts", [["abc", "", "12", "é"], ["x"]])
def test_subwords_stay_in_their_text(texts):
    h, n = langid.subwords(texts)
    assert n.sum() == len(h)
    alone = [langid.subwords([t])[0].tolist() for t in texts]
    assert sum(alone, []) == h.tolist()


def test_every_language_is_trained(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda bags, langs, calibrate: seen.extend(langs))
    for n in (3, 1500):
        seen.clear()
        d = spark.range(4 * n).select(F.col("id").alias("doc_id"), F.format_string("l%d", F.col("id") % n).alias("lang"), F.lit("some words").alias("text"))
        langid.train(d)
        want = {r["lang"] for r in d.where(~langid.held_out()).select("lang").distinct().collect()}
        assert set(seen) == want and len(want) > 0.9 * n


def test_training_rows_are_bounded(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("lang"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    d = d.unionByName(d.where("doc_id < 100").crossJoin(spark.range(30)).drop("id"))  # ids that come again and again
    got = langid.chosen(d, sample=300).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"hot": 300, "rare": 300}
    assert langid.chosen(d, sample=300, rows=100).count() == 100
    assert {tuple(r) for r in langid.chosen(d, 50).collect()} == {tuple(r) for r in langid.chosen(d.repartition(7), 50).collect()}
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("quality"))
    assert {r["y"]: r["count"] for r in quality_bt.chosen(labels, 200).groupBy("y").count().collect()} == {0: 200, 1: 200}
    assert quality_bt.chosen(labels.where("doc_id < 100"), 200).count() == labels.where("doc_id < 100").distinct().where(~quality_bt.held_out()).count()


def test_columns_with_clashing_names(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    clash = docs.withColumns({n: F.lit("x") for n in ("score", "predicted", "held_out", "y", "h", "k", "n", "lang_pred", "buckets", "strength")})
    twice = labels.unionByName(labels).unionByName(labels.limit(5).withColumn("quality", 1 - F.col("quality"))).withColumn("text", F.lit("t"))
    model = quality_bt.train(clash, twice)
    assert quality_bt.scores(clash, model).count() == docs.count()
    got = langid.identify(clash, langid.train(clash))
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
