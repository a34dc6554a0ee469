"""What is checked before results are kept or published, and the state that says what was."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import position
from gristmill.operators.infer import credential_errors


@dataclass(frozen=True)
class GateLimits:
    """Points of percent; fixed defaults."""

    enabled: bool = True
    min_batch: int = 50
    max_batch_shift_pp: float = 30
    max_corpus_shift_pp: float = 3
    max_no_stance_rise_pp: float = 1.5


def shares(rows: DataFrame) -> dict[str, float]:
    """Percent of each gate bucket: at most four rows."""
    got = rows.groupBy(position.gate(F.col("analysis")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in got)
    return {r["b"]: r["n"] * 100.0 / total for r in got} if total else {}


def new_rows(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    return current.join(previous.select(key), key, "left_anti")


def gate_figures(current: DataFrame, previous: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """scope, bucket, before, now, over: every comparison of the gate, as rows."""
    def share(rows: DataFrame, name: str) -> DataFrame:
        b = position.gate(F.col("analysis"))
        cols = [(F.count_if(b == k) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias(k) for k in ("Oppose", "Support", "none")]
        return rows.agg(*cols, F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scope"), "n", F.explode(F.create_map(*[x for k in ("Oppose", "Support", "none") for x in (F.lit(k), F.col(k))])).alias("bucket", "now"))

    before = share(previous, "previous").select("bucket", F.col("now").alias("before"), F.col("n").alias("n_before"))
    both = share(new_rows(current, previous), "batch").unionByName(share(current, "corpus")).join(before, "bucket")
    shift = F.col("now") - F.col("before")
    over = F.when((F.col("scope") == "batch") & (F.col("bucket") != "none"), (F.abs(shift) > limits.max_batch_shift_pp) & (F.col("n") >= limits.min_batch) & (F.col("n_before") > 0))
    over = over.when((F.col("scope") == "corpus") & (F.col("bucket") != "none"), F.abs(shift) > limits.max_corpus_shift_pp).when(F.col("scope") == "corpus", shift > limits.max_no_stance_rise_pp)
    return both.select("scope", "bucket", "before", "now", F.coalesce(over, F.lit(False)).alias("over"))


def problems(current: DataFrame, previous: DataFrame, limits: GateLimits = GateLimits(), published: dict[str, float] | None = None) -> list[str]:
    """Reasons to stop, empty if none; published shares, where there are any, stand in for the previous corpus."""
    if not limits.enabled:
        return []
    out = []
    now, before = shares(current), shares(previous)
    batch = new_rows(current, previous)
    n = batch.count()
    if before and n >= limits.min_batch:
        new = shares(batch)
        for b in ("Oppose", "Support"):
            if abs(d := new.get(b, 0.0) - before.get(b, 0.0)) > limits.max_batch_shift_pp:
                out.append(f"new comments: {b} differs by {d:+.1f} points")
    base = published or before
    if base:
        for b in ("Oppose", "Support"):
            if abs(d := now.get(b, 0.0) - base.get(b, 0.0)) > limits.max_corpus_shift_pp:
                out.append(f"overall {b} moved by {d:+.1f} points")
        if (d := now.get("none", 0.0) - base.get("none", 0.0)) > limits.max_no_stance_rise_pp:
            out.append(f"comments with no stance rose by {d:.1f} points")
    return out


class Refused(RuntimeError):
    """A write that would lose results."""


def save_guarded(rows: DataFrame, path: str, force: bool = False, small: int = 100, least: float = 0.5) -> None:
    """Write a table; refuse to replace one of more than ``small`` rows by less than a share ``least`` of it.

    Written beside first, then moved, so a table is never overwritten while it may be read.  The old one stays as .bak.
    """
    spark: SparkSession = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = hadoop.Path(path + ".new")
    rows.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(target):
        old, new = spark.read.parquet(path).count(), spark.read.parquet(path + ".new").count()
        if not force and old > small and new < old * least:
            fs.delete(fresh, True)
            raise Refused(f"{new} rows would replace {old}")
        back = hadoop.Path(path + ".bak")
        fs.delete(back, True)
        fs.rename(target, back)
    fs.rename(fresh, target)


def _read_state(path: str | Path, spark: SparkSession | None) -> dict:
    """The state in a file of this machine, or with a session of any storage; an unreadable one counts as none."""
    if spark is not None:
        from gristmill.sources.files import read_document

        return read_document(spark, str(path)) or {}
    p = Path(path)
    try:
        found = json.loads(p.read_text()) if p.exists() else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


def published_baseline(path: str | Path, spark: SparkSession | None = None) -> dict[str, float]:
    return _read_state(path, spark).get("last_shares") or {}


def changelog_state(state: dict, total: int, shares_: dict[str, float] | None, day: str) -> dict | None:
    """The state after a publish, its newest entry first; None where nothing has grown.  Without shares the last ones stay."""
    last, kept = state.get("last_total"), shares_ or state.get("last_shares")
    if last is not None and total <= last:
        return None
    note = f"Published with {total:,} comments." if last is None else f"Now {total:,} comments, {total - last:,} of them new."
    out = {"last_total": total, "entries": [{"date": day, "note": note}, *(state.get("entries") or [])]}
    return out | ({"last_shares": {k: round(v, 3) for k, v in kept.items()}} if kept else {})


def record_publish(total: int, path: str | Path, shares_: dict[str, float] | None = None, day: str | None = None, spark: SparkSession | None = None) -> bool:
    """Enter a first publish or growth in the changelog; without growth the file stays as it is."""
    new = changelog_state(_read_state(path, spark), total, shares_, day or date.today().isoformat())
    if new is not None and spark is not None:
        from gristmill.sources.sinks import write_document

        write_document(spark, str(path), new)
    elif new is not None:
        Path(path).write_text(json.dumps(new, indent=2))
    return new is not None


def credential_block(rows: DataFrame, error: str = "analysis_error") -> None:
    """Stops a publish where any row failed for its credentials; results are kept before."""
    if n := credential_errors(rows, error).count():
        raise Refused(f"{n} analyses failed for their credentials")


def sample_folder(base: str, sample: int | None, seed: int = 42) -> tuple[str, bool]:
    """Where a run writes and whether it may publish: samples have a folder of their own and never do."""
    return (base, True) if not sample else (f"{base.rstrip('/')}/samples/n{sample}-seed{seed}", False)
