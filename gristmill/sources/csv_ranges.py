"""One large CSV file read by many tasks, though its quoted values may hold line breaks.

A range of a file can't tell whether it starts inside a quoted value.  So every line is scanned for both cases, as an
expression: how does it end if it starts outside a value, and if inside?  Both answers compose over lines and over ranges,
which tells each range how it starts and how many records there are before it.  Then the ranges are read again, each by its
own task, and cut into records; only a record that goes on in another range is put together after a shuffle.

A quote opens a value at the start of a field only and is doubled inside; any other quote closes the value that is open, as
the CSV reader has it.  Records end with a line feed, with or without a carriage return before it; blank lines between
records are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.storage import materialize

#: Rows of the table of ranges (one for each 128 MB or so of input) that is sent to all tasks; more are an error.
FEW_RANGES = 100_000


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted value is open at the end of a line that starts inside one, or outside."""
    parts = F.split(F.concat(F.lit(","), F.regexp_replace(line, '""', "")), '"', -1)
    opens = lambda acc, part: (~acc) & part.endswith(",")
    folded = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(inside), opens)
    return F.when(line.contains('"'), folded).otherwise(F.lit(inside))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), value, a and b (open at the end, if it starts outside and inside), blank; ranges in order."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    value, r = F.col("value"), F.regexp_replace("value", "\r$", "")
    return spark.read.option("lineSep", "\n").text(path).select(*at, "value", ends_inside(value, False).alias("a"), ends_inside(value, True).alias("b"), (r == "").alias("blank"))


def _before(a: np.ndarray, b: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line starts inside a value, and the end, for lines one after the other of which the first does or not."""
    n = np.arange(len(a))
    fixed, turns = np.maximum.accumulate(np.where(a == b, n, -1)), np.cumsum(a & ~b)
    known = np.where(fixed >= 0, a[np.maximum(fixed, 0)], inside)
    since = turns - np.where(fixed >= 0, turns[np.maximum(fixed, 0)], 0)
    return np.concatenate([[inside], known ^ (since % 2 == 1)])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that are of one range."""
    start = batch.column("start").to_numpy()
    files = batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(batch)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield batch.column("file")[i].as_py(), int(start[i]), batch.slice(i, j - i)


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("a", "b", "blank"))


def ranges(found: DataFrame) -> DataFrame:
    """file, start, inside (how the range starts), ahead (records begun before it in the file); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, start, part in _runs(batch):
                state = told.setdefault((file, start), [False, True, 0, 0])
                a, b, blank = _flags(part)
                for k in (0, 1):
                    inside = _before(a, b, state[k])
                    state[k] = bool(inside[-1])
                    state[2 + k] += int((~inside[:-1] & ~blank).sum())
        names = ["file", "start", "a", "b", "n_a", "n_b"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        rows = [(*k, *v) for k, v in told.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    per = materialize(found.select("file", "start", "a", "b", "blank").mapInArrow(run, "file string, start long, a boolean, b boolean, n_a long, n_b long"), "csv-ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = per.withColumn("turns", F.sum((F.col("a") & ~F.col("b")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "turns")), ignorenulls=True).over(before)
    turned = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    odd = (turned - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    per = per.withColumn("inside", F.coalesce(last["a"], F.lit(False)) != odd)
    per = per.withColumn("n", F.when(F.col("inside"), F.col("n_b")).otherwise(F.col("n_a")))
    return materialize(per.select("file", "start", "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), "n"), "csv-starts")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file, number (from 0 in each file), record (text); and file, n (its records).  The order of rows is any."""
    found = lines(spark, path)
    starts = ranges(found)
    if (n := starts.count()) > FEW_RANGES:
        raise ValueError(f"{n} ranges, {FEW_RANGES} at most: read with a larger spark.sql.files.maxPartitionBytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, number, held = None, False, 0, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "number", "start", "whole", "record"])

        def closed(rows: list[tuple]) -> None:
            """What is held ends here: with the record, or with the range."""
            if held:
                first = held.pop(0)  # whether the record began in this range
                rows.append((*(at[0], number - 1, at[1]), first and not inside, "\n".join(held)))
                held.clear()

        for batch in batches:
            rows: list[tuple] = []
            for file, start, part in _runs(batch):
                if at != (file, start):
                    closed(rows)
                    at, inside, number = (file, start), part.column("inside")[0].as_py(), part.column("ahead")[0].as_py()
                    if inside:
                        held.append(False)
                a, b, blank = _flags(part)
                before = _before(a, b, inside)
                for value, within, empty, after in zip(part.column("value").to_pylist(), before[:-1].tolist(), blank.tolist(), before[1:].tolist(), strict=True):
                    if not within:
                        if empty:
                            continue
                        number += 1
                        held.append(True)
                    held.append(value)
                    inside = after
                    if not after:
                        closed(rows)
            if rows:
                yield out(rows)
        rows = []
        closed(rows)
        if rows:
            yield out(rows)

    told = starts.select("file", "start", "inside", "ahead")
    cut = found.join(F.broadcast(told), ["file", "start"])  # as counted above; leaves the lines of a range together and in order
    pieces = cut.select("file", "start", "value", "a", "b", "blank", "inside", "ahead").mapInArrow(run, "file string, number long, start long, whole boolean, record string")
    pieces = materialize(pieces, "csv-records")
    parts = pieces.where("not whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"))
    joined = parts.select("file", "number", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return pieces.where("whole").select("file", "number", "record").unionByName(joined), starts.groupBy("file").agg(F.sum("n").alias("n"))
