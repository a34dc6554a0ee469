"""Texts of attached files: readers by format, a client for pictures, and a cache that is read through."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import gibberish, strip, text_or_empty
from gristmill.sources.files import FORMATS

#: fixed values: pictures, the largest one that is sent to a client, how it says that there is no text, pages of a scan it may see
PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".webp")
PICTURE_BYTES, NO_TEXT, SCAN_PAGES = 5 * 1024 * 1024, "EMPTY", 20
KEY = ["doc", "filename"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class OcrClient(Protocol):
    """Reads pictures; picklable, as it runs on executors."""

    def read(self, content: bytes, extension: str) -> str: ...


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts, self.hidden = [], ""

    def handle_starttag(self, tag, attrs):
        self.hidden = self.hidden or (tag if tag in ("script", "style") else "")

    def handle_endtag(self, tag):
        self.hidden = "" if tag == self.hidden else self.hidden

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def read_html(content: bytes) -> str:
    """All text outside of scripts and styles, as it stands."""
    p = _Plain()
    p.feed(content.decode("utf-8"))
    p.close()
    return "".join(p.parts)


def read_docx(content: bytes) -> str:
    """Paragraphs of the body, a line each, then the rows of its tables, cells side by side."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    mark = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    text = lambda e: "".join((x.text or "") if mark[x.tag] is None else mark[x.tag] for x in e.iter() if x.tag in mark)
    lines = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iterfind(f"{_W}tbl/{_W}tr"):
        cells = ["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            lines.append(" ".join(cells))
    return "\n".join(lines)


#: by extension; others (PDF) come with the libraries that a caller has
READERS: dict[str, Callable[[bytes], str]] = {".txt": lambda b: b.decode("utf-8"), ".html": read_html, ".htm": read_html, ".docx": read_docx, ".doc": read_docx}


def read_file(name: str, content: bytes, readers: dict[str, Callable[[bytes], str]], ocr: OcrClient | None) -> tuple[str, str]:
    """text, reason (why there is none)."""
    found = re.search(r"\.[A-Za-z0-9]+$", name)
    extension = found[0].lower() if found else ""
    try:
        if extension in PICTURES:
            if ocr is None or len(content) > PICTURE_BYTES:
                return "", "no client for pictures" if ocr is None else "picture too large"
            text = ocr.read(content, extension).strip()
            text = "" if text.upper() == NO_TEXT else text
        elif extension in readers:
            text = readers[extension](content)
        else:
            return "", "no reader"
    except Exception as e:  # one broken file is a row without a text
        return "", f"unreadable: {type(e).__name__}"
    return (text, "") if text.strip() else ("", "no text extracted")


def attached_files(rows: DataFrame, urls: str, key: str = "doc") -> DataFrame:
    """key, pos, url, filename of every address in a comma-separated list; names without an extension count as PDF."""
    listed = rows.select(key, F.posexplode(F.split(text_or_empty(urls), ",")).alias("i", "url")).select(key, (F.col("i") + 1).alias("pos"), strip("url").alias("url")).where("url <> ''")
    name = F.concat(F.lit("attachment_"), F.col("pos").cast("string"), F.lit("_"), F.element_at(F.split("url", "/"), -1))
    return listed.withColumn("filename", F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".pdf"))))


class Downloader(Protocol):
    """Fetches one file; picklable.  It raises where there is none to be had."""

    def fetch(self, url: str) -> bytes: ...


def downloaded(files: DataFrame, client: Downloader) -> DataFrame:
    """``files`` (doc, pos, url, filename) with content, null where the client could not fetch it."""
    names = files.schema.fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def get(url: str) -> bytes | None:
            try:
                return client.fetch(url)
            except Exception:  # a row without content tells it
                return None

        for frame in frames:
            for i in range(0, len(frame), 16):
                part = frame.iloc[i : i + 16]
                yield part.assign(content=[get(u) for u in part["url"]])

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", content binary")


def with_attachments(rows: DataFrame, kind: str, urls: str, public: str = "Public Submission") -> DataFrame:
    """Public submissions that have attachments."""
    return rows.where((F.col(kind) == public) & (strip(urls) != ""))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def extracted(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, ocr: OcrClient | None = None) -> DataFrame:
    """``files`` (doc, filename, content, others) with text and reason instead of content.  Broken extractions count as none."""
    names = [f for f in files.schema.fields if f.name != "content"]
    use = READERS | (readers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 16):
                part = frame.iloc[i : i + 16]
                told = [read_file(n, bytes(c) if c is not None else b"", use, ocr) for n, c in zip(part["filename"], part["content"], strict=True)]
                yield part.drop(columns="content").assign(text=[t for t, _ in told], reason=[r for _, r in told])

    out = files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", text string, reason string")
    broken = (F.col("reason") == "") & gibberish("text")
    return out.withColumns({"reason": F.when(broken, "gibberish").otherwise(F.col("reason")), "text": F.when(broken, "").otherwise(F.col("text"))})


#: fixed value: a page with so many readable characters needs no client
PAGE_CHARS = 100


def scanned_pages(pages: DataFrame, least: int = PAGE_CHARS, most: int = SCAN_PAGES) -> DataFrame:
    """Of ``pages`` (doc, filename, page, text, ink, others) those with something on them but no readable text; the first ``most`` of a file.

    ``scans`` tells how many of the file's pages are such.  Pages without ink are blank and need no one to say so.
    """
    readable = (F.length(strip("text")) >= least) & ~gibberish(strip("text"))
    needy = pages.where(F.coalesce(F.col("ink"), F.lit(False)) & ~F.coalesce(readable, F.lit(False)))
    counts = needy.groupBy(*KEY).agg(F.count(F.lit(1)).alias("scans"))
    first = needy.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("page"))).where(F.col("_k") <= most).drop("_k")
    return first.join(counts, KEY)


def read_scans(pages: DataFrame, ocr: OcrClient, least: int = PAGE_CHARS, most: int = SCAN_PAGES) -> DataFrame:
    """doc, filename, text, scans, asked of every file with scanned pages: what a client reads on them, in order, a line break between.

    ``pages`` has ``picture``, the page drawn as PNG.  A page that is too large, empty, gibberish or fails gives nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 16):
                part = frame.iloc[i : i + 16]
                yield part.drop(columns="picture").assign(read=[read_file("page.png", bytes(c) if c is not None else b"", {}, ocr)[0] for c in part["picture"]])

    shown = scanned_pages(pages, least, most).select(*KEY, "page", "scans", "picture")
    kinds = dict(shown.dtypes)
    told = shown.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in (*KEY, "page", "scans")) + ", read string")
    told = told.withColumn("read", F.when(~gibberish("read"), F.col("read")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(strip("read") != "", F.struct("page", "read")))), lambda x: x["read"]), "\n")
    return told.groupBy(*KEY).agg(text.alias("text"), F.max("scans").alias("scans"), F.count(F.lit(1)).alias("asked"))


# --- the cache ------------------------------------------------------------------------------------------------------

def answers(cache: DataFrame) -> DataFrame:
    """Cached texts that are any: an empty one is no answer."""
    return cache.where(strip("text") != "").select(*KEY, "text").dropDuplicates(KEY)


def read_through(files: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """doc, filename, text, reason of all files, and those of them that were extracted now, for the cache."""
    known = answers(cache)
    hit = files.join(known, KEY).select(*KEY, "text", F.lit("").alias("reason"))
    fresh = extract(files.join(known, KEY, "left_anti")).select(*KEY, "text", "reason")
    return hit.unionByName(fresh), fresh


def stem(filename: Column) -> Column:
    """What files of one attachment share: the name without its number and extension."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", ""), r"^attachment_\d+_", "")))


def warmed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """doc, stems, found, complete: a comment is done when as many files have texts as it has attachments."""
    want = files.groupBy("doc").agg(F.count_distinct(stem(F.col("filename"))).alias("stems"))
    have = answers(cache).groupBy("doc").agg(F.count(F.lit(1)).alias("found"))
    return want.join(have, "doc", "left").select("doc", "stems", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) >= F.col("stems")).alias("complete"))


def refreshed(cache: DataFrame, again: DataFrame, docs: list[str]) -> DataFrame:
    """The cache in which the entries of some comments are those extracted again."""
    return cache.where(~F.col("doc").isin(docs)).select(*KEY, "text").unionByName(again.select(*KEY, "text"))


def merged_caches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both caches' texts; where both have one, the local one."""
    own = answers(local)
    return own.unionByName(answers(remote).join(own, KEY, "left_anti"))


# --- states and failures --------------------------------------------------------------------------------------------


def failures(files: DataFrame) -> DataFrame:
    """doc, filename, reason of each file that was tried in vain, and of each attachment of which no file has a text.

    ``files``: doc, pos, filename, text, reason.  A file after one that gave the attachment's text is not tried.
    """
    ext = F.lower(F.regexp_extract("filename", r"(\.[A-Za-z0-9]+)$", 1))
    place = F.array_position(F.array(*map(F.lit, FORMATS)), ext)
    rank = F.struct(F.when(place > 0, place - 1).otherwise(len(FORMATS)).alias("rank"), F.col("pos"))
    rows = files.select("doc", stem(F.col("filename")).alias("stem"), rank.alias("r"), "filename", "reason", (strip("text") != "").alias("full"))
    by = rows.groupBy("doc", "stem").agg(F.min(F.when(F.col("full"), F.col("r"))).alias("first"), F.array_sort(F.collect_list(F.struct("r", "filename", "reason"))).alias("all"))
    pdf = rows.groupBy("doc").agg(F.max(F.lower("filename").endswith(".pdf")).alias("pdf"))
    tried = F.filter("all", lambda x: F.col("first").isNull() | (x["r"] < F.col("first")))
    one = by.select("doc", F.explode(tried).alias("x")).select("doc", "x.filename", "x.reason")
    none = by.where("first is null").join(pdf, "doc").select("doc", F.array_join(F.transform("all", lambda x: x["filename"]), ", ").alias("filename"), F.when(F.col("pdf"), "all formats empty").otherwise("no PDF rendition").alias("reason"))
    return one.unionByName(none)
