from pyspark.sql import functions as F

from gristmill.streaming.incremental import ingest_new


def test_backdated_rows_of_a_later_run(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    rows = lambda a, b, day: spark.range(a, b).select("id", F.lit(day).cast("timestamp").alias("ts"))
    rows(0, 10, "2024-01-20").write.parquet(src)
    assert ingest_new(spark, src, out, state) == 10
    old = rows(5, 25, "2024-01-03")  # five known keys, fifteen new ones, each twice
    old.union(old).write.mode("append").parquet(src)
    assert ingest_new(spark, src, out, state) == 25
    assert ingest_new(spark, src, out, state) == 25
    got = {r["id"]: r["ts"].day for r in spark.read.parquet(out).collect()}
    assert got == {i: 20 if i < 10 else 3 for i in range(25)}
