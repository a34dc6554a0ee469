"""Where results go besides guarded tables: logs, flat files, shards, a relational database."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.chunks import byte_chunks
from gristmill.operators.report import shards


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_shards(rows: DataFrame, path: str, fields: list[str], size: int = 500) -> None:
    """One folder a shard, so that a lookup by shard reads one file."""
    shards(rows, fields, size).write.mode("overwrite").partitionBy("shard").parquet(path)


def lookup(spark, path: str, key: str, shard: int) -> str | None:
    """A row's detail as JSON, from its shard alone; None if the shard doesn't have it."""
    row = spark.read.parquet(path).where(F.col("shard") == shard).select(F.get_json_object("body", f"$['{key}']").alias("d")).first()
    return row["d"] if row else None


def write_jdbc(rows: DataFrame, url: str, table: str, batch: int = 1000, **properties: str) -> None:
    """Append in batches; the caller has removed the rows that these replace."""
    rows.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties)


def _names(*names: str) -> None:
    """Names of tables and columns are put into statements, so they must be names; values never are."""
    if bad := [n for n in names if not all(part.replace("_", "").isalnum() for part in n.split("."))]:
        raise ValueError(f"not names: {', '.join(bad)}")


def delete_statement(table: str, key: str) -> str:
    """Removes the rows of one key."""
    _names(table, key)
    return f"DELETE FROM {table} WHERE {key} = ?"


def replace_jdbc(rows: DataFrame, url: str, table: str, key: str, value: str, batch: int = 1000, **properties: str) -> None:
    """The rows of one key anew, in one transaction.

    Tasks write the new rows in batches to a table of the same shape beside the target.  Then the old rows go and the new ones
    are copied inside the database, and both or neither hold; whatever fails before leaves the old rows as they are.
    """
    staged, columns = f"{table}_{uuid.uuid4().hex[:12]}", ", ".join(rows.columns)
    _names(table, key, *rows.columns)
    jvm = rows.sparkSession._jvm
    props = jvm.java.util.Properties()
    for k, v in properties.items():
        props.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        con.createStatement().execute(f"CREATE TABLE {staged} AS SELECT {columns} FROM {table} WITH NO DATA")
        try:
            write_jdbc(rows, url, staged, batch, **properties)
            con.setAutoCommit(False)
            try:
                gone = con.prepareStatement(delete_statement(table, key))
                gone.setString(1, value)
                gone.executeUpdate()
                con.createStatement().executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged}")
                con.commit()
            except Exception:
                con.rollback()
                raise
            finally:
                con.setAutoCommit(True)
        finally:
            con.createStatement().execute(f"DROP TABLE {staged}")
    finally:
        con.close()


def snapshot(rows: DataFrame, path: str) -> str:
    """What a run has so far, beside its results: those are the next run's source and stay as they are."""
    beside = path.rstrip("/") + ".inprogress"
    rows.write.mode("overwrite").parquet(beside)
    return beside


def write_chunks(rows: DataFrame, path: str, line: str, order: str, cap: int = 8 << 20) -> None:
    """Lines in files of at most ``cap`` bytes, a folder for each chunk, in order; a folder from before is replaced."""
    dealt = byte_chunks(rows, line, order, cap).select("chunk", order, F.col(line).alias("value"))
    dealt.repartition("chunk").sortWithinPartitions("chunk", order).select("chunk", "value").write.mode("overwrite").partitionBy("chunk").text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any storage that the session can write; written beside first, then moved."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = target.getFileSystem(conf)
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(fresh, target)


def write_document(spark: SparkSession, path: str, document: Any) -> None:
    write_text(spark, path, json.dumps(document, indent=1, ensure_ascii=False))


def write_ids(ids: DataFrame, path: str, key: str = "id", most: int = 100_000) -> None:
    """A list of ids in order, as one JSON document; for lists that people read: more than ``most`` ids are an error."""
    found = [r[key] for r in ids.select(key).orderBy(key).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} ids: write them as a table")
    write_document(ids.sparkSession, path, found)


def stored_bytes(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or of all files below a folder; None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def push(spark: SparkSession, source: str, target: str, shrink: float = 0.1, force: bool = False) -> None:
    """Copy state to where it is shared; an empty source, or one that is smaller by more than ``shrink``, is refused."""
    from gristmill.operators.gates import Refused

    new, old = stored_bytes(spark, source), stored_bytes(spark, target)
    if not new:
        raise Refused(f"{source} is empty")
    if old and not force and new < old * (1 - shrink):
        raise Refused(f"{new} bytes would replace {old}")
    pull(spark, source, target)


def pull(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder beside the target, then put it in its place; an empty source is refused."""
    from gristmill.operators.gates import Refused

    if not stored_bytes(spark, source):
        raise Refused(f"{source} is empty or absent")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target, target.rstrip("/") + ".new"))
    to = b.getFileSystem(conf)
    to.delete(fresh, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, to, fresh, False, conf)
    to.delete(b, True)
    to.rename(fresh, b)


def verification_log(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that any second pass has given a value."""
    any_set = F.lit(False)
    for f in fields:
        any_set = any_set | F.col(f).isNotNull()
    return rows.where(any_set).select("id", *fields)
