"""Queries against their SQL on small tables that hold what the given ones hold only where they are large."""

import duckdb
from pyspark.sql import functions as F

from gristmill.plans import catalogue


def both(spark, path, name, **tables):
    """Rows of a query and of its SQL, in order of their values."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(path))
    names = ", ".join(got.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(con.execute(f"SELECT {names} FROM ({catalogue.oracle_sql()[name]})").fetchall(), key=repr)


def test_references_that_end_within_a_text(spark, tmp_path):
    texts = ["<h1>a &amp</h1>b", "<p>a&am</p><p>&</p>&amp;&amp", "<p>&quo</p>&ampx; &copy &copy; &amp;lt; &lt;&#60;", "x &middot", "&nbsp;&lt", ""]
    got, want = both(spark, tmp_path, "html_text", pages=spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"))
    assert got == want


def test_modified_within_the_second_of_the_mark(spark, tmp_path):
    times = ["11:59:59.999999", "12:00:00", "12:00:00.000001", "12:00:00.302911", "12:00:01", None]
    events = spark.createDataFrame([(i, t and f"2024-01-02 {t}") for i, t in enumerate(times)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got, want = both(spark, tmp_path, "withdrawn_candidates", events=events, documents=spark.range(9).toDF("doc_id"))
    assert got == want == [(2,), (3,), (4,)]


def test_shares_that_five_places_do_not_show(spark, tmp_path):
    rows = spark.range(20_000_100).select(F.greatest(F.col("id") - 20_000_000, F.lit(0)).alias("l_orderkey"))
    got, want = both(spark, tmp_path, "display_percent", lineitem=rows)
    assert got == want and dict(got)[7] == 0


def test_blocks_end_where_their_quotes_do(spark, tmp_path):
    texts = {2: "Dear Sir, " * 13 + "\nthe end im.\n" + "Einte im.\n" * 25 + "Einte", 4: "the " * 25 + "Zu und. Die Ann Lee.\nBob Roe wrote a longer line than any of the others, which comes once, and that is not the last.\nZu und. Die Ann Lee."}
    d = spark.createDataFrame([(i, t, "de", "src0") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    events = spark.range(9).select(F.col("id").alias("event_id"), F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"))
    labels = spark.range(9).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got, want = both(spark, tmp_path, "checked_signers", documents=d, events=events, labels=labels)
    assert got == want and [r[1] for r in got] == ["found", "found"]
