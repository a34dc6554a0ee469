"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.skew import with_least
from gristmill.storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node with an edge.

    Alternating large-star and small-star steps: every step hangs neighbours below the smallest one, which halves
    path lengths and never needs more than one row per edge; a node that most others hang on is dealt to many tasks.  Each step is stored, so that lineage stays short.
    Edges with a null end and loops are ignored; an empty table gives an empty result.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, ["u"], "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large-star")
        small = with_least(large, ["u"], "v", "m").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = materialize(small, "small-star")
        seen = tuple(small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
        discard(now, large)
        now = small
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
