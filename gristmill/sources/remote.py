"""Records of a remote service: guarded calls, detail records as export rows, what is new, and what was withdrawn.

A service is a callable from a path to bytes, given by import path where it runs on executors; nothing here opens a
connection by itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import collapse, text_or_empty

#: fixed values: attributes of a detail record and the export's columns for them
COLUMNS = {
    "agencyId": "Agency ID", "docketId": "Docket ID", "trackingNbr": "Tracking Number", "documentType": "Document Type", "title": "Title", "legacyId": "Legacy ID",
    "commentOnDocumentId": "Comment on Document ID", "postmarkDate": "Postmark Date", "subtype": "Document Subtype", "field1": "Additional Field 1", "field2": "Additional Field 2",
    "pageCount": "Page Count", "firstName": "First Name", "lastName": "Last Name", "city": "City", "stateProvinceRegion": "State/Province", "zip": "Zip/Postal Code", "country": "Country",
    "organization": "Organization Name", "submitterRep": "Submitter Representative", "submitterRepAddress": "Representative's Address", "submitterRepCityState": "Representative's City, State & Zip",
    "govAgency": "Government Agency", "govAgencyType": "Government Agency Type", "comment": "Comment", "category": "Category", "restrictReasonType": "Restrict Reason Type",
    "restrictReason": "Restrict Reason", "reasonWithdrawn": "Reason Withdrawn", "docAbstract": "Abstract",
}
#: fixed values: those columns that are not copied as they are
WITHDRAWN, LATE, DUPLICATES, DISPLAY, POSTED, RECEIVED, FILES = "Is Withdrawn?", "Allow Late Comments", "Duplicate Comments", "Display Properties (Name, Label, Tooltip)", "Posted Date", "Received Date", "Attachment Files"


class RateLimited(RuntimeError):
    """The service's budget is spent: keep what there is and go on with the next run."""


class Failed(RuntimeError):
    """A call that the service refused, with its status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def call(service: Callable[[str], bytes], path: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A JSON answer.  Busy and broken states are tried again after a short while; a budget that stays spent is ``RateLimited``."""
    for n in range(1, tries + 1):
        try:
            return json.loads(service(path))
        except Failed as e:
            if e.status != 429 and e.status < 500 or (e.status >= 500 and n == tries):
                raise
            if n < tries:
                sleep(5 * n)
    raise RateLimited(path)


def fetch_details(ids: DataFrame, service: str, budget: int | None = None) -> DataFrame:
    """id, body (JSON, null where the budget was spent): one task, as a service's budget can't be shared out.

    ``service`` is ``module:name``.  Rows keep coming after a spent budget, without a body, so that a caller sees what is open.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = service.partition(":")
        ask, left = getattr(import_module(module), name), float("inf") if budget is None else budget
        for frame in frames:
            bodies = []
            for i in frame["id"]:
                body = None
                if left > 0:
                    try:
                        body, left = json.dumps(call(ask, f"comments/{i}", sleep=lambda s: None)), left - 1
                    except RateLimited:
                        left = 0
                bodies.append(body)
            yield pd.DataFrame({"id": frame["id"], "body": bodies})

    return ids.select("id").coalesce(1).sortWithinPartitions("id").mapInPandas(run, "id string, body string")


def _minutes(c: Column) -> Column:
    """The export leaves the seconds of full hours out."""
    return F.when(c.endswith(":00:00Z"), F.replace(c, F.lit(":00Z"), F.lit("Z"))).otherwise(c)


def detail_rows(details: DataFrame) -> DataFrame:
    """Detail records (id, body) as rows that can't be told from the bulk export's."""
    at = lambda name: F.get_json_object("body", f"$.data.attributes.{name}")
    shown = F.from_json(at("displayProperties"), "array<struct<name:string,label:string,tooltip:string>>")
    lines = F.transform(shown, lambda p: F.concat_ws(", ", *[F.coalesce(p[k], F.lit("")) for k in ("name", "label", "tooltip")]))
    files = F.from_json(F.get_json_object("body", "$.included"), "array<struct<attributes:struct<fileFormats:array<struct<fileUrl:string>>>>>")
    urls = F.flatten(F.transform(files, lambda f: F.transform(F.coalesce(f["attributes"]["fileFormats"], F.array().cast("array<struct<fileUrl:string>>")), lambda x: x["fileUrl"])))
    own = {
        WITHDRAWN: F.when(at("withdrawn") == "true", "true").otherwise("false"),
        LATE: F.when(at("openForComment") == "true", "true").otherwise("false"),
        DUPLICATES: F.when(at("duplicateComments") != "0", at("duplicateComments")),
        DISPLAY: F.array_join(lines, "\n"),
        POSTED: _minutes(at("postedDate")),
        RECEIVED: _minutes(at("receiveDate")),
        FILES: F.array_join(F.filter(urls, lambda u: u != ""), ","),
    }
    copied = {name: at(k) for k, name in COLUMNS.items()}
    return details.select(F.col("id").alias("Document ID"), *[text_or_empty(c).alias(n) for n, c in {**copied, **own}.items()])


def missing_ids(listed: DataFrame, known: DataFrame, limit: int | None = None, key: str = "id") -> DataFrame:
    """Listed ids that aren't known yet; with a limit the first of them by id, for one run."""
    new = listed.join(known.select(key), key, "left_anti")
    return new.orderBy(key).limit(limit) if limit else new


def local_counts(rows: DataFrame, today: str, posted: str = "posted") -> DataFrame:
    """total, today: what a remote count is compared with."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.substring(text_or_empty(posted), 1, 10) == today).alias("today"))


# --- withdrawals ----------------------------------------------------------------------------------------------------

RECORD = ["id", "reason", "detected", "posted", "text_available", "tracking", "received", "submitter", "organization", "text"]


def _record(**fields: Column) -> list[Column]:
    return [fields.get(n, F.lit(True if n == "text_available" else "")).alias(n) for n in RECORD]


def already_withdrawn(export: DataFrame, today: str) -> DataFrame:
    """Records of export rows that came withdrawn, and so without their text."""
    gone = export.where(F.lower(text_or_empty(F.col(f"`{WITHDRAWN}`"))) == "true")
    return gone.select(*_record(id=F.col("`Document ID`"), reason=text_or_empty(F.col("`Reason Withdrawn`")), detected=F.lit(today), posted=text_or_empty(F.col(f"`{POSTED}`")), text_available=F.lit(False)))


def newly_withdrawn(details: DataFrame, export: DataFrame, today: str) -> DataFrame:
    """Records of fetched rows that are withdrawn now, with what the export still has of them."""
    gone = details.where(F.col(f"`{WITHDRAWN}`") == "true").select(F.col("`Document ID`").alias("id"), F.col("`Reason Withdrawn`").alias("reason"), F.col(f"`{POSTED}`").alias("posted"))
    c = lambda name: text_or_empty(F.col(f"`{name}`"))
    had = export.select(F.col("`Document ID`").alias("id"), c("Tracking Number").alias("tracking"), c(RECEIVED).alias("received"), collapse(F.concat(c("First Name"), F.lit(" "), c("Last Name"))).alias("submitter"), c("Organization Name").alias("organization"), c("Comment").alias("text"))
    told = gone.join(had.dropDuplicates(["id"]), "id", "left")
    return told.select(*_record(detected=F.lit(today), **{n: text_or_empty(n) for n in ("reason", "posted", "tracking", "received", "submitter", "organization", "text")}, id=F.col("id")))


def with_records(record: DataFrame, found: DataFrame) -> DataFrame:
    """The record with new entries; what is there stays as it is.  Sorted by id."""
    return record.unionByName(found.dropDuplicates(["id"]).join(record.select("id"), "id", "left_anti")).orderBy("id")


def next_mark(listed: DataFrame, mark: str, complete: bool, modified: str = "modified") -> str:
    """The high-water mark after a check: it moves only if every candidate was checked."""
    top = listed.agg(F.max(modified)).first()[0] or ""
    return max(mark, top) if complete else mark
