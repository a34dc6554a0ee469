"""Extraction caches packed for an object store: compressed archives with an index of members and checksums.

Tasks write the archives and read them back; what comes to the driver is one row an archive.  A push is a folder of its own,
and a small document beside the pushes names the one that holds, written last, so that a push that breaks off changes
nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.gates import Refused
from gristmill.sources import shared
from gristmill.sources.attachments import KEY, answers, merged_caches
from gristmill.sources.files import read_document
from gristmill.sources.sinks import write_document
from gristmill.storage import materialize

#: Bytes of text in an archive, which a task holds at once.
ARCHIVE_BYTES = 16 << 20
#: fixed value: how a cached text is named in an archive
ENDING = ".extracted.txt"
CURRENT = "current.json"


class Corrupt(RuntimeError):
    """An archive that isn't what was written."""


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _archive(members: list[tuple[str, str, bytes]]) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for doc, filename, data in members:
            info = tarfile.TarInfo(f"{quote(doc, safe='')}/{quote(filename, safe='')}{ENDING}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return gzip.compress(raw.getvalue(), mtime=0)


def _members(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(gzip.decompress(data))) as tar:
        for info in tar:
            doc, _, name = info.name.removesuffix(ENDING).partition("/")
            yield unquote(doc), unquote(name), tar.extractfile(info).read()


def push(cache: DataFrame, target: str, archive_bytes: int = ARCHIVE_BYTES, shrink: float = 0.1, force: bool = False) -> int:
    """Pack the texts of a cache (doc, filename, text) below ``target``; how many there are.

    Blank texts are no answers and stay out.  Nothing to push is refused, and so is a push smaller by more than ``shrink`` than
    the one that holds, unless ``force``.
    """
    spark = cache.sparkSession
    texts = answers(cache).select(*[F.col(k).cast("string").alias(k) for k in KEY], F.col("text").cast("binary").alias("data"))
    texts = materialize(texts, "cache-texts")
    size = texts.agg(F.sum(F.length("data"))).first()[0]
    if not size:
        raise Refused("there is nothing to push")
    held = read_document(spark, f"{target}/{CURRENT}")
    if held and not force and size < held["bytes"] * (1 - shrink):
        raise Refused(f"{size} bytes would replace {held['bytes']}")
    version, many = uuid.uuid4().hex, -(-size // archive_bytes)
    folder = f"{target}/{version}"

    def written(number: int, members: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        data, path = _archive(members), f"{folder}/{number:06d}.tar.gz"
        shared.write_file(path, data)
        rows = [(path, _sha(data), len(data), doc, name, len(text), _sha(text)) for doc, name, text in members]
        names = ["archive", "archive_sha256", "archive_bytes", *KEY, "bytes", "sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, members = None, []
        for batch in batches:
            for n, doc, name, data in zip(*(batch.column(c).to_pylist() for c in ("number", *KEY, "data")), strict=True):
                if members and n != number:
                    yield written(number, members)
                    members = []
                number = n
                members.append((doc, name, data))
        if members:
            yield written(number, members)

    dealt = texts.withColumn("number", F.pmod(F.xxhash64(*KEY), F.lit(many)).cast("int")).repartition("number").sortWithinPartitions("number", *KEY)
    index = dealt.select("number", *KEY, "data").mapInArrow(write, "archive string, archive_sha256 string, archive_bytes long, doc string, filename string, bytes long, sha256 string")
    index.write.parquet(f"{folder}/index")
    n = spark.read.parquet(f"{folder}/index").count()
    write_document(spark, f"{target}/{CURRENT}", {"version": version, "bytes": size, "texts": n})
    return n


def pull(spark: SparkSession, target: str) -> DataFrame:
    """doc, filename, text of the push that holds, stored; an archive that is absent, empty or altered is refused as ``Corrupt``."""
    held = read_document(spark, f"{target}/{CURRENT}")
    if not held:
        raise Refused(f"nothing was pushed to {target}")
    index = spark.read.parquet(f"{target}/{held['version']}/index")
    archives = index.groupBy("archive", "archive_sha256").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("sha256")).alias("all"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = shared.read_file(r["archive"])
                if not data or _sha(data) != r["archive_sha256"]:
                    raise Corrupt(f"{r['archive']} is {'empty or absent' if not data else 'not what was written'}")
                found = list(_members(data))
                if sorted(_sha(x) for _, _, x in found) != r["all"]:
                    raise Corrupt(f"{r['archive']} has other members than its index")
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([f[2].decode() for f in found])], [*KEY, "text"])

    tasks = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 4))
    return materialize(archives.repartition(tasks).mapInArrow(read, "doc string, filename string, text string"), "pulled-cache")


def refresh(local: DataFrame, target: str) -> DataFrame:
    """A cache with what was pushed from elsewhere; where both have a text, the local one stays."""
    return merged_caches(local, pull(local.sparkSession, target))
