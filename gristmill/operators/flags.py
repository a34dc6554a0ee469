"""Flags and facets that a configuration declares, compiled to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.numbers import display_pct, split_pct
from gristmill.functions.text import any_match, distinct_matches


def regex_flags(text: Column, config: dict[str, list[str]]) -> list[Column]:
    return [F.coalesce(any_match(text, patterns), F.lit(False)).alias(name) for name, patterns in config.items()]


def derived_flag(value: Column, least: int = 2) -> Column:
    return F.coalesce(value.try_cast("int") >= least, F.lit(False))


def listed(rows: DataFrame, ids: DataFrame, name: str, excluded: Column | None = None, notes: bool = False) -> DataFrame:
    """Flag rows whose id, or its part before ``#``, is in ``ids`` (column id), unless ``excluded`` holds.

    With ``notes`` also what the list says of the whole id, else of the part before ``#`` (its column note).
    """
    note = F.col("note") if notes else F.lit("")
    known = ids.groupBy(F.col("id").alias("_known")).agg(F.first(note, ignorenulls=True).alias("_note"))
    out = rows.withColumn("_base", F.substring_index("id", "#", 1)).join(known, F.col("_base") == F.col("_known"), "left")
    whole = known.select(F.col("_known").alias("_whole"), F.col("_note").alias("_own"))
    out = out.join(whole, F.col("id") == F.col("_whole"), "left")
    flag = F.col("_known").isNotNull() | F.col("_whole").isNotNull()
    if excluded is not None:
        flag = flag & ~F.coalesce(excluded, F.lit(False))
    if notes:
        out = out.withColumn(f"{name}_note", F.coalesce(F.nullif("_own", F.lit("")), "_note", F.lit("")))
    return out.withColumn(name, flag).drop("_base", "_known", "_whole", "_note", "_own")


def kept_ids(ids: DataFrame, field: str, patterns: list[str]) -> DataFrame:
    """The list without entries (JSON) one field of which matches a pattern; what no pattern knows stays."""
    value = F.coalesce(F.get_json_object("entry", f"$.{field}"), F.lit(""))
    return ids.where(~any_match(value, patterns))


def coverage(rows: DataFrame, ids: DataFrame, name: str, description: str = "") -> DataFrame:
    """listed, shown, description: how many ids are on record and how many rows the flag marks, told where some are missing."""
    counts = ids.agg(F.count_distinct("id").alias("listed")).crossJoin(F.broadcast(rows.agg(F.count_if(F.col(name)).alias("shown"))))
    said = F.format_string("%s Of %,d on record, %,d are shown here; of the other %,d there is no text.", F.lit(description), F.col("listed"), F.col("shown"), F.col("listed") - F.col("shown"))
    return counts.withColumn("description", F.when(F.col("listed") > F.col("shown"), F.trim(said)).otherwise(F.lit(description)))


def facet(rows: DataFrame, pattern: str, text: str = "text", position: str = "position", top: int | None = 15) -> DataFrame:
    """Values of a multi-value dimension: comments, position split, percent; the ``top`` by count, then value."""
    values = rows.select(F.explode(distinct_matches(F.col(text), pattern)).alias("value"), F.col(position).alias("p"))
    out = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == "Oppose").alias("oppose"), F.count_if(F.col("p") == "Support").alias("support"))
    out = out.withColumn("oppose_pct", split_pct(F.col("oppose"), F.col("support")))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def facet_total(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """distinct: how many values a multi-value dimension has in all."""
    return rows.select(F.explode(distinct_matches(F.col(text), pattern)).alias("value")).agg(F.count_distinct("value").alias("distinct"))


def flag_sections(rows: DataFrame, flags: list[str], samples: int = 500, sizes: dict[str, Column] | None = None) -> DataFrame:
    """flag, n, pct, largest, ids of the first rows in input order.  One pass; ranks are kept within a flag's matches.

    ``sizes``: of flags derived from a number, that number; its largest value is told, and the first rows come by it.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    size = lambda f: F.coalesce((sizes or {}).get(f, F.lit(None)).cast("long"), F.lit(0))
    marks = F.array(*[F.when(F.col(f), F.struct(F.lit(f).alias("flag"), size(f).alias("size"))) for f in flags])
    long = rows.select("row_idx", "id", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select("row_idx", "id", "m.*")
    counts = long.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).crossJoin(F.broadcast(total))
    few = long.withColumn("k", F.row_number().over(Window.partitionBy("flag").orderBy("row_idx"))).where(F.col("k") <= samples)
    few = few.groupBy("flag").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "k", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return counts.join(few, "flag").select("flag", "n", display_pct(F.col("n"), F.col("total")).alias("pct"), "largest", "ids")
