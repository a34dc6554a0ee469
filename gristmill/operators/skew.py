"""Joins and least values over keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key's rows are dealt to so many groups, so that no task holds them all.
SALTS = 64


def salt(by: str, salts: int = SALTS) -> Column:
    """The group of a row, by the hash of a column that differs between the rows of a key."""
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key: first the groups that occur, then rows by key and group."""
    dealt = rows.withColumn("_salt", salt(by, salts))
    groups = dealt.select(*keys, "_salt").distinct().join(table, keys)
    return dealt.join(groups, [*keys, "_salt"], how).drop("_salt")


def with_least(rows: DataFrame, keys: list[str], value: str, name: str, salts: int = SALTS) -> DataFrame:
    """Adds the least ``value`` of each key: found in each group of its rows, then over the groups."""
    dealt = rows.withColumn("_salt", salt(value, salts))
    groups = dealt.groupBy(*keys, "_salt").agg(F.min(value).alias("_part"))
    groups = groups.select(*keys, "_salt").join(groups.groupBy(*keys).agg(F.min("_part").alias(name)), keys)
    return dealt.join(groups, [*keys, "_salt"]).drop("_salt")


def nth(rows: DataFrame, keys: list[str], order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Adds the place of each row among those of its key, from 1, in ascending ``order`` (an integer that no two rows share).

    Rows are counted in blocks of the order first, so a task has the rows of one key and block, and a hot key is many tasks.
    Keys may be null, which is a key as well.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(order) / block))
    names = [f"_key{i}" for i in range(len(keys))]
    counts = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_block").alias("_b"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    same = F.col("_block") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return dealt.withColumn("_inside", inside).join(counts, same).withColumn(name, F.col("_before") + F.col("_inside")).drop(*names, "_b", "_block", "_before", "_inside")
