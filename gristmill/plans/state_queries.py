"""Queries over text forms, ids, logs, stored tables, withdrawals and evaluation sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import numbers, text as T
from gristmill.operators import evaluate, gates, ingest, score
from gristmill.plans.page_queries import RICH, rich
from gristmill.plans.registry import query
from gristmill.plans.report_queries import C
from gristmill.sources import files, remote, sinks
from gristmill.sources.fixture import comments, table
from gristmill.storage import scratch_path
from gristmill.streaming import incremental

# --- texts ----------------------------------------------------------------------------------------------------------

_RUNS = "list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' ')))"
_ONE_LINE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    rf"""WITH f AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS family FROM documents),
    w AS (SELECT doc_id, trim(regexp_replace(family, ' +', ' ', 'g')) AS form, list_filter(string_split_regex(family, ' +'), lambda x: x <> '') AS words FROM f)
    SELECT doc_id, md5(form) AS form, CAST(CASE WHEN len(words) >= 5 THEN len({_RUNS.format("words")}) ELSE 0 END AS INTEGER) AS shingles, CAST(CASE WHEN len(words) >= 5 THEN len({_RUNS.format("words")}) ELSE 1 END AS INTEGER) AS family_shingles FROM w"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that campaigns and families are compared in, and how many runs of five words each has."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.campaign_form("text").alias("form"), T.words(T.family_form("text")).alias("words"))
    words = F.col("words")
    return d.select("doc_id", F.md5("form").alias("form"), F.size(T.shingles(words)).alias("shingles"), F.size(T.shingles(words, short_ok=True)).alias("family_shingles"))


@query(
    r"""WITH b AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b, role FROM conversations),
    w AS (SELECT conv_id, turn, regexp_replace(CASE WHEN len(b) < 60 THEN b || ' || ATTACHMENT: ' || role ELSE b END, '^\s+|\s+$', '', 'g') AS w FROM b)
    SELECT conv_id, turn, CASE WHEN len(w) > 40 THEN left("""
    + _ONE_LINE.format("w")
    + """, 1500) END AS shown FROM w"""
)
def audit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown of each turn, with its role as the attachment of short ones."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", score.audit_text(F.col("text"), F.col("role")).alias("shown"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[0-9]+', 0), '') AS INTEGER) AS number FROM documents")
def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of each text, null where there is none or it is too long for one."""
    return table(spark, sf_dir, "documents").select("doc_id", numbers.safe_int(F.regexp_extract("text", "[0-9]+", 0)).alias("number"))


# --- ids, times, logs -----------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS cursor, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS back FROM events")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as a listing's filter takes them, and back."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return e.select("event_id", incremental.to_cursor(F.col("iso")).alias("cursor")).withColumn("back", incremental.from_cursor(F.col("cursor")))


@query("SELECT strftime(max(CAST(ts AS DATE)) - 1, '%Y-%m-%d') AS since FROM events")
def fetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.fetch_window(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("posted")))


@query(
    """WITH o AS (SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || '-' || CAST(o_orderkey AS VARCHAR) END AS a, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'C' || CAST(o_custkey AS VARCHAR) END AS b FROM orders)
    SELECT row_idx, coalesce(nullif(a, ''), nullif(trim(b), ''), 'comment_' || CAST(row_idx AS VARCHAR)) AS id FROM o
    UNION ALL SELECT c_custkey, 'only ' || c_name FROM customer"""
)
def given_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled of two columns or the row's number; a table that lacks one of them is united with it."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("row_idx"), F.when(k % 3 == 0, "").otherwise(F.concat("o_orderpriority", F.lit("-"), k.cast("string"))).alias("a"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("b"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit("only "), "c_name").alias("a"))
    return ingest.with_id(ingest.united([o, c]), "a", "b").select("row_idx", "id")


@query("SELECT doc_id FROM (SELECT doc_id, CAST('0x' || substr(md5('42' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents) ORDER BY h, doc_id LIMIT 100")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a hundred documents, the same on every run."""
    return ingest.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id", "42")


@query("SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed ids that aren't known yet."""
    return remote.missing_ids(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query(C + "SELECT count(*) AS total, count(*) FILTER (posted = '2024-01-20') AS today FROM comments")
def known_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remote.local_counts(comments(spark, sf_dir), "2024-01-20")


@query("SELECT event_id, event_type, value FROM events")
def log_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is appended to twice, as its lines say."""
    path, e = scratch_path(spark, "log"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for half in (0, 1):
        sinks.append_log(e.where(F.pmod("event_id", F.lit(2)) == half), path)
    return files.read_log(spark, path, e.schema)


@query("SELECT doc_id, md5(text) AS body, CAST(NULL AS VARCHAR) AS later FROM documents")
def guarded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a much smaller one may not replace, read under a schema with a column that it lacks."""
    path, d = scratch_path(spark, "guarded"), table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"))
    gates.save_guarded(d, path)
    try:
        gates.save_guarded(d.where("doc_id < 0"), path)
    except gates.Refused:
        return files.read_stored(spark, path, "doc_id long, body string, later string")
    raise RuntimeError("the smaller table was taken")


# --- withdrawals ----------------------------------------------------------------------------------------------------


@query(
    """SELECT 'D' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 14 = 0 THEN '' ELSE 'asked by ' || source END AS reason, '2024-02-01' AS detected, lang AS posted, false AS text_available, '' AS tracking, '' AS received, '' AS submitter, '' AS organization, '' AS text
    FROM documents WHERE doc_id % 7 = 0"""
)
def withdrawn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an export that came withdrawn, beside those that a first record has."""
    k = F.col("doc_id")
    told = {"Document ID": F.concat(F.lit("D"), k.cast("string")), "Reason Withdrawn": F.when(k % 14 != 0, F.concat(F.lit("asked by "), "source")), remote.WITHDRAWN: F.when(k % 7 == 0, "True").when(k % 7 == 1, "false"), remote.POSTED: F.col("lang")}
    d = table(spark, sf_dir, "documents")
    found = remote.already_withdrawn(d.select(*[c.alias(n) for n, c in told.items()]), "2024-02-01")
    return remote.with_records(found.where(F.length("id") < 4), found)


# --- evaluation sheets ----------------------------------------------------------------------------------------------

_SHEET = RICH + """, d AS (SELECT row_idx, id, CASE WHEN pos IN ('Oppose', 'Support') THEN 'Position: ' || pos ELSE '(none)' END AS pipeline_label, CASE pos WHEN 'Oppose' THEN 'oppose' WHEN 'Support' THEN 'support' ELSE 'no_position' END AS pipeline_norm,
      CASE WHEN row_idx % 9 = 8 THEN '' WHEN row_idx % 9 < 3 THEN 'support' WHEN row_idx % 9 < 5 THEN 'oppose' WHEN row_idx % 9 = 5 THEN 'unclear_junk' ELSE 'no_position' END AS draft, CASE WHEN row_idx % 4 = 0 THEN 'hard' ELSE '' END AS hard, CASE WHEN row_idx % 6 = 0 THEN '' ELSE CAST(1.0 + row_idx % 3 AS VARCHAR) END AS weight, CASE row_idx % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' x ' ELSE 'no' END AS reviewed FROM rich),
    s AS (SELECT *, pipeline_norm = draft AS agrees FROM d),
    l AS (SELECT id, CASE draft WHEN 'unclear_junk' THEN 'no_position' ELSE draft END AS truth, pipeline_norm AS pred, coalesce(TRY_CAST(weight AS DOUBLE), 1.0) AS weight, reviewed <> 'no' AS seen FROM s WHERE draft <> '') """


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_idx")
    r = rich(spark, sf_dir)
    drawn = r.select("row_idx", "id", F.when(F.col("position") == "Unclear", score.NONE).otherwise(F.concat(F.lit("Position: "), "position")).alias("pipeline_label"), F.lit("").alias("label"), F.when(k % 6 == 0, "").otherwise((1.0 + k % 3).cast("string")).alias("weight"), F.when(k % 5 == 0, "Yes").when(k % 5 == 1, " x ").otherwise("no").alias("reviewed"))
    draft = F.when(k % 9 < 3, "support").when(k % 9 < 5, "oppose").when(k % 9 == 5, "unclear_junk").otherwise("no_position")
    drafts = r.where(k % 9 != 8).select("id", draft.alias("draft_label"), *[F.when((k % 4 == 0) & F.lit(f == "what_makes_it_hard"), "hard").otherwise("").alias(f) for f in score.EVIDENCE])
    return score.review_sheet(drawn, drafts)


@query(_SHEET + "SELECT id, pipeline_norm, draft AS label, agrees, NOT agrees OR (hard <> '' AND draft <> '') AS review_first FROM s")
def draft_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments with a model's drafts, and which of them are worth a person's attention first."""
    return _sheet(spark, sf_dir).select("id", "pipeline_norm", "label", "agrees", "review_first")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet as people hand it back: a CSV file."""
    path = scratch_path(spark, "sheet")
    sinks.write_csv(_sheet(spark, sf_dir).select("id", "pipeline_norm", "label", "weight", "reviewed"), path)
    return score.labelled(files.read_labelled(spark, path))


@query(_SHEET + "SELECT count(*) AS n, count(*) FILTER (seen) AS seen, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS agreement FROM l")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.agreement(_labelled(spark, sf_dir))


@query(_SHEET + "SELECT id, truth, pred, weight, seen FROM l WHERE truth = 'support' AND pred = 'no_position' AND contains(lower(id), 'doc-1')")
def accuracy_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind one cell of the confusion table that hold a text."""
    rows = score.accuracy_rows(_labelled(spark, sf_dir), "mismatch", ("support", "no_position"), "DOC-1")
    return rows.select("id", "truth", "pred", "weight", "seen")


@query(_SHEET + "SELECT truth AS class, sum(weight) AS labelled FROM l WHERE seen GROUP BY 1")
def seen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of what people have checked, by true class."""
    metrics = evaluate.class_metrics(_labelled(spark, sf_dir).where("seen"), weight=F.col("weight"))
    return metrics.where("tp + fn > 0").select("class", (F.col("tp") + F.col("fn")).alias("labelled"))
