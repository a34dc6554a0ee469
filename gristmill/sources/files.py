"""File sources: bulk exports, earlier results in JSON or logs, HTML and XML."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gristmill.functions.text import strip, text_or_empty
from gristmill.operators.skew import lookup
from gristmill.sources import csv_ranges
from gristmill.storage import materialize


#: Rows of the table of a collection's files that is sent to all tasks; a longer one is joined in groups.
FEW_FILES = 20_000


def read_export(spark: SparkSession, path: str, columns: list[str], first: int | None = None) -> DataFrame:
    """A CSV export with quoted line breaks, and row_idx: the place of each row, files in order of their names.

    Every column is text, nothing is inferred.  With ``first`` only so many rows.  A file is read in ranges by many tasks; a
    header that names other columns is an error.  Where the header ends with a carriage return, quoted breaks lose theirs.
    """
    found, counts = csv_ranges.records(spark, path)
    heads = found.where("number = 0").select("file", F.col("record").endswith("\r").alias("returns"), "record")
    ahead = F.coalesce(F.sum(F.col("n") - 1).over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = materialize(counts.where("n > 0").join(heads, "file").select("file", "returns", ahead.alias("ahead"), F.regexp_replace("record", "^\ufeff|\r$", "").alias("head")), "export-files")  # a row a file
    schema, options = ", ".join(f"`{c}` string" for c in columns), {"escape": '"', "multiLine": "true"}
    named = places.select(F.from_csv("head", schema, options).alias("r")).select(F.array(*[f"r.`{c}`" for c in columns]).alias("names"))
    if other := named.where(F.col("names") != F.array(*map(F.lit, columns))).first():
        raise ValueError(f"the header is {other['names']}, not {columns}")
    rows, places = found.where("number > 0"), places.select("file", "returns", "ahead")
    rows = rows.join(F.broadcast(places), "file") if places.count() <= FEW_FILES else lookup(rows, places, ["file"], "number")
    record = F.when(F.col("returns"), F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", "")).otherwise(F.col("record"))
    rows = rows.select((F.col("ahead") + F.col("number") - 1).alias("row_idx"), F.from_csv(record, schema, options).alias("r"))
    return (rows if first is None else rows.where(F.col("row_idx") < first)).select("row_idx", "r.*")


def read_stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Earlier results in Parquet under a declared schema: columns that a file lacks are null."""
    return spark.read.schema(schema).parquet(path)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation sheet in CSV: its labelled rows, with a weight of 1 where there is no number."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    return rows.where(strip("label") != "").withColumn("weight", weight)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a folder has files of a table: one whose first write broke off has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.parquet")
    return len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def read_whole(spark: SparkSession, path: str) -> str | None:
    """A small file as one text, from any storage that the session can read; None where there is none."""
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None


def read_document(spark: SparkSession, path: str, kind: type = dict):
    """A small JSON file of a kind (dict or list); None where it is absent, empty, broken or of another kind."""
    import json

    try:
        found = json.loads(read_whole(spark, path) or "null")
    except ValueError:
        return None
    return found if isinstance(found, kind) and found else None


def read_metadata(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """What a collection says about itself, over defaults."""
    return defaults | {k: v for k, v in (read_document(spark, path) or {}).items() if v not in (None, "")}


def map_columns(rows: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Logical columns from the first filled of their physical ones."""
    blank = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`"))
    return rows.select(*[F.coalesce(*[blank(c) for c in cs if c in rows.columns], F.lit("")).alias(name) for name, cs in mapping.items()])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results in JSON: a list of records, or an object whose ``comments`` is one."""
    rows = spark.read.json(path, multiLine=True)
    if rows.columns == ["comments"]:
        return rows.select(F.explode("comments").alias("c")).select("c.*")
    if "id" not in rows.columns:
        raise ValueError(f"{path} holds neither a list of records nor an object with comments")
    return rows


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; lines that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_ids(spark: SparkSession, path: str, notes: list[str] = (), clip: int = 0) -> DataFrame:
    """id, entry (JSON), note, from a JSON list of ids or records, or an object whose ``comments`` is one; a missing file is an error.

    The note is the first of the named fields that isn't blank, on one line, cut at a word where it is longer than ``clip``.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    whole = spark.read.text(path, wholetext=True).select(F.when(F.trim("value").startswith("{"), F.get_json_object("value", "$.comments")).otherwise(F.col("value")).alias("value"))
    items = whole.select(F.explode(F.from_json("value", "array<string>")).alias("entry"))
    record = F.col("entry").startswith("{")
    ids = items.select(F.when(record, F.get_json_object("entry", "$.document_id")).otherwise(F.col("entry")).alias("id"), F.when(record, F.col("entry")).otherwise("{}").alias("entry"))
    line = [F.nullif(strip(F.regexp_replace(text_or_empty(F.get_json_object("entry", f"$.{n}")), r"(?U)\s+", " ")), F.lit("")) for n in notes]
    note = F.coalesce(*line, F.lit(""))
    short = F.when(F.length(note) > clip, F.concat(F.regexp_replace(F.substring(note, 1, clip), " [^ ]*$", ""), F.lit("…"))).otherwise(note) if clip else note
    return ids.where(text_or_empty("id") != "").select("id", "entry", short.alias("note")).dropDuplicates(["id"])


#: an ampersand, and what a semicolon closes behind it
REFERENCE = re.compile(r"&(#?\w+;)?")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str, references: Collection[str] | None = None) -> str:
    """The texts between tags, a line each.

    ``references``: the only names that stand for a character, and only closed; without it all of HTML's do, closed or not.
    """
    if references is not None:
        html = REFERENCE.sub(lambda m: m[0] if m[1] and m[1][:-1] in references else "&amp;" + m[0][1:], html)
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def with_html_text(pages: DataFrame, html: str = "html", references: Collection[str] | None = None) -> DataFrame:
    @F.pandas_udf("string")
    def convert(s):
        return s.fillna("").map(lambda x: html_to_text(x, references))

    return pages.withColumn("text", convert(F.col(html)))


def rule_sections(xml: str, part: str | None = None) -> list[dict[str, str]]:
    """Sections of a rule in reading order; an amendment before a section goes to the next section that has a number."""
    from xml.etree import ElementTree

    text = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    out, pending = [], ""
    for e in ElementTree.fromstring(xml).iter():
        if e.tag == "AMDPAR":
            pending = text(e)
        elif e.tag == "SECTION":
            label = text(e.find("SECTNO"))
            m = re.search(r"\d+\.\d+", label)
            if not m:
                continue
            amendment, pending = pending, ""
            if part and not m[0].startswith(f"{part}."):
                continue
            out.append({"number": m[0], "sectno": label, "heading": text(e.find("SUBJECT")), "amendment": amendment, "text": "\n\n".join(text(p) for p in e.iter("P"))})
    return out


def sections(documents: DataFrame, part: str | None = None) -> DataFrame:
    """path, place, number, sectno, heading, amendment, text of the sections of rules in XML (path, xml), many documents at once.

    A document that isn't well formed is an error; null or blank ones have no sections.
    """
    names = ["number", "sectno", "heading", "amendment", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = rule_sections(xml, part) if xml and xml.strip() else []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), *(pa.array([f[n] for f in found], pa.string()) for n in names)], ["path", "place", *names])

    return documents.select(F.col("path").cast("string").alias("path"), F.col("xml").cast("string").alias("xml")).mapInArrow(run, "path string, place int, " + ", ".join(f"{n} string" for n in names))


# --- attachments ----------------------------------------------------------------------------------------------------

#: fixed value: what stands between the texts of two attachments
BETWEEN = "\n\n--- ATTACHMENT ---\n\n"
#: fixed order in which the files of one attachment are tried
FORMATS = [".docx", ".doc", ".pdf", ".txt", ".rtf", ".html", ".htm", ".png", ".jpg", ".jpeg", ".gif", ".webp"]


def attachment_groups(files: DataFrame) -> DataFrame:
    """``files``: doc, pos, filename, text (null or blank: nothing came out).  doc, stem, chosen, text, n, skipped, failed.

    Files that differ only in format are one attachment; the first that yields text stands for it.
    """
    ext = F.lower(F.regexp_extract("filename", r"(\.[A-Za-z0-9]+)$", 1))
    stem = F.lower(F.trim(F.regexp_replace(F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", ""), r"^attachment_\d+_", "")))
    place = F.array_position(F.array(*map(F.lit, FORMATS)), ext)
    rank = F.when(place > 0, place - 1).otherwise(len(FORMATS))
    full = F.coalesce(F.trim("text"), F.lit("")) != ""
    rows = files.select("doc", "pos", "filename", F.trim("text").alias("text"), stem.alias("stem"), rank.alias("rank"), full.alias("full"))
    first = F.min(F.when(F.col("full"), F.struct("rank", "pos", "filename", "text")))
    out = rows.groupBy("doc", "stem").agg(F.min("pos").alias("at"), F.count(F.lit(1)).alias("n"), first.alias("f"), F.collect_list(F.struct("rank", "pos")).alias("all"))
    tried = F.size(F.filter("all", lambda x: F.struct(x["rank"], x["pos"]) < F.struct(F.col("f.rank"), F.col("f.pos"))))
    return out.select("doc", "stem", "at", "n", F.col("f.filename").alias("chosen"), F.col("f.text").alias("text"), F.when(F.col("f").isNull(), F.col("n").cast("int")).otherwise(tried).alias("failed"), F.when(F.col("f").isNull(), 0).otherwise(F.col("n").cast("int") - tried - 1).alias("skipped"))


def attachment_text(groups: DataFrame) -> DataFrame:
    """doc, attachment_text: what the groups yield, in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"])
    return groups.groupBy("doc").agg(F.array_join(parts, BETWEEN).alias("attachment_text"), F.sum("n").alias("total"), F.sum("skipped").alias("skipped"), F.sum("failed").alias("failed"))
