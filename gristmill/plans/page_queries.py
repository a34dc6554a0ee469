"""Queries over pages, exports, model runs and evaluation sets, on the comment table with all fields of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import position, text as T
from gristmill.operators import export, flags, infer, model, pages, report, score
from gristmill.plans.registry import query
from gristmill.plans.report_queries import _SPLIT, C, _pct
from gristmill.plans.text_queries import CITATION
from gristmill.sources import attachments, files
from gristmill.sources.fixture import comments, table
from gristmill.storage import scratch_path

STATES = ["src1", "src2", "src3"]


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment table with entity, state, party, first sentence as quote, attachments and campaigns."""
    k, c = F.col("row_idx"), comments(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.concat(F.lit("turn "), "turn", F.lit(".txt")).alias("filename"), "text")
    att = files.attachment_text(files.attachment_groups(turns)).select(F.col("doc").alias("row_idx"), "attachment_text")
    source = F.regexp_extract("source", r"^src(\d+)$", 1).try_cast("int")
    fields = {
        "stances": F.col("analysis.stances"),
        "verified_stance": F.col("analysis.verified_stance"),
        "entity_type": F.when(F.col("lang") == "en", infer.ATTORNEY).when(F.col("lang") == "fr", "Organization").otherwise(pages.NOBODY),
        "state_identified": infer.known_or(F.col("source"), STATES),
        "political_affiliation": F.when(k % 4 == 0, "Democrat").when(k % 4 == 1, "Republican").otherwise(""),
        "key_quote": F.regexp_extract("text", "^[^.!?]*[.!?]", 0),
    }
    analysis = F.when(F.col("analysis").isNotNull(), F.struct(*[v.alias(n) for n, v in fields.items()]))
    out = c.join(att, "row_idx", "left").withColumn("attachment_text", T.text_or_empty("attachment_text"))
    out = out.withColumn("campaign_id", F.when(source < 8, source)).withColumn("position", position.shown(F.col("analysis"))).withColumn("analysis", analysis)
    return out.withColumn("licensed", T.any_match(F.col("text"), ["licen[cs]e", "copyright"]))


RICH = (
    C
    + f""", rich AS (SELECT c.*, coalesce(c.pos, 'Unclear') AS position, coalesce(a.text, '') AS attachment_text, CASE WHEN TRY_CAST(nullif(regexp_extract(source, '^src(\\d+)$', 1), '') AS INTEGER) < 8 THEN TRY_CAST(nullif(regexp_extract(source, '^src(\\d+)$', 1), '') AS INTEGER) END AS campaign_id,
      CASE WHEN analysed THEN CASE lang WHEN 'en' THEN 'Attorney/Lawyer' WHEN 'fr' THEN 'Organization' ELSE 'Individual/Other' END END AS kind, CASE WHEN analysed AND source IN ('src1', 'src2', 'src3') THEN source ELSE '' END AS state,
      CASE WHEN analysed THEN CASE row_idx % 4 WHEN 0 THEN 'Democrat' WHEN 1 THEN 'Republican' ELSE '' END ELSE '' END AS party, CASE WHEN analysed THEN regexp_extract(c.text, '^[^.!?]*[.!?]', 0) ELSE '' END AS key_quote
      FROM comments c LEFT JOIN (SELECT conv_id, string_agg(trim(text), '{files.BETWEEN}' ORDER BY turn) FILTER (trim(text) <> '') AS text FROM conversations GROUP BY conv_id) a ON a.conv_id = c.row_idx)
    """
)

# --- pages ----------------------------------------------------------------------------------------------------------


@query(
    RICH
    + """, t AS (SELECT unnest(list_filter(['Position: ' || pos, 'Concern: ' || lang, CASE WHEN licensed THEN 'Concern: license' END], lambda x: x IS NOT NULL AND x <> 'Position: Unclear')) AS v FROM rich WHERE analysed),
    u AS (SELECT 'stances' AS filter, v AS value FROM t UNION SELECT 'positions', replace(v, 'Position: ', '') FROM t WHERE v LIKE 'Position:%' UNION SELECT 'positions', 'Unclear' UNION SELECT 'concerns', replace(v, 'Concern: ', '') FROM t WHERE v LIKE 'Concern:%'
      UNION SELECT 'entity_types', kind FROM rich WHERE kind IS NOT NULL UNION SELECT 'states', state FROM rich WHERE state <> '' UNION SELECT 'political', party FROM rich WHERE party <> ''),
    k AS (SELECT campaign_id, count(*) AS n, min(row_idx) AS f FROM rich WHERE campaign_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS place FROM k)
    SELECT filter, row_number() OVER (PARTITION BY filter ORDER BY value) AS place, value FROM u UNION ALL SELECT 'campaigns', place, 'Campaign ' || CAST(place AS VARCHAR) || ' (' || format('{:,}', n) || ')' FROM r"""
)
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.filter_values(rich(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    RICH
    + r""", k AS (SELECT campaign_id, count(*) AS n, min(row_idx) AS f, count(*) FILTER (position = 'Oppose') AS o, count(*) FILTER (position = 'Support') AS s, count(*) FILTER (position = 'Unclear') AS u FROM rich WHERE campaign_id IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS rank, CASE WHEN o > s AND o > u THEN 'Oppose' WHEN s > o AND s > u THEN 'Support' ELSE 'Mixed' END AS stance FROM k)
    SELECT row_idx, id, CASE WHEN submitter = 'Anonymous Anonymous' THEN 'Anonymous' ELSE submitter END AS submitter, organization, posted, received, coalesce(kind, 'Individual/Other') AS entity_type, state AS state_identified, party AS political_affiliation, md5(key_quote) AS key_quote,
      CASE WHEN analysed AND pos <> 'Unclear' THEN pos ELSE '' END AS positions, CASE WHEN analysed THEN concat_ws('|', lang, CASE WHEN licensed THEN 'license' END) ELSE '' END AS concerns, licensed,
      array_to_string(list_distinct_ordered, '|') AS citations, CASE WHEN len(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview, r.rank AS campaign_rank, r.n AS campaign_size, coalesce(r.stance, '') AS campaign_stance
    FROM (SELECT *, list_filter(regexp_extract_all(text, '\d{3}\.\d{3}'), lambda x, i: list_position(regexp_extract_all(text, '\d{3}\.\d{3}'), x) = i) AS list_distinct_ordered FROM rich) rich LEFT JOIN r USING (campaign_id)"""
)
def prepare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rich(spark, sf_dir)
    ranked = report.campaign_stats(c, "campaign_id").select("campaign_id", F.col("rank").cast("long").alias("rank"), F.col("n").alias("size"), "stance")
    rows = pages.prepared(c, ["licensed"], {"citation": CITATION}, ranked)
    joined = {n: F.array_join(n, "|").alias(n) for n in ("positions", "concerns")}
    return rows.select("row_idx", "id", "submitter", "organization", "posted", "received", "entity_type", "state_identified", "political_affiliation", F.md5("key_quote").alias("key_quote"), *joined.values(), "licensed", F.array_join("citation_values", "|").alias("citations"), "preview", "campaign_rank", "campaign_size", "campaign_stance")


@query(
    RICH
    + r""", v AS (SELECT DISTINCT row_idx, id, position, submitter, key_quote, text, unnest(list_concat(regexp_extract_all(text, '\d{3}\.\d{3}'), regexp_extract_all(text, '(?i)\bsection \d+'))) AS number FROM rich),
    s AS (SELECT lpad(CAST(item_id * 25 % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(item_id * 7 % 1000 AS VARCHAR), 3, '0') AS number, min(item_id) AS place FROM benchmark GROUP BY 1),
    k AS (SELECT number, count(*) AS n, count(*) FILTER (position = 'Oppose') AS oppose, count(*) FILTER (position = 'Support') AS support FROM v GROUP BY number),
    l AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN trim(key_quote) <> '' THEN key_quote ELSE text END, '\s+', ' ', 'g'), '^ | $', '', 'g') AS q, row_number() OVER (PARTITION BY number ORDER BY row_idx) AS i FROM v WHERE number IN (SELECT number FROM s)),
    p AS (SELECT number, string_agg(id || '/' || CASE WHEN submitter = 'Anonymous Anonymous' THEN 'Anonymous' ELSE submitter END || '/' || position || '/' || CASE WHEN len(q) > 120 THEN regexp_replace(left(q, 120), '\s+$', '') || '…' ELSE q END, '|' ORDER BY i) FILTER (i <= 8) AS sample FROM l GROUP BY number),
    a AS (SELECT s.number, true AS amended, place, coalesce(n, 0) AS n, coalesce(oppose, 0) AS oppose, coalesce(support, 0) AS support, coalesce(sample, '') AS sample FROM s LEFT JOIN k USING (number) LEFT JOIN p USING (number)
      UNION ALL SELECT number, false, row_number() OVER (ORDER BY n DESC, number), n, oppose, support, '' FROM k WHERE number NOT IN (SELECT number FROM s)),
    x AS (SELECT *, CAST(CASE WHEN oppose + support > 0 THEN round_even(oppose * 100.0 / (oppose + support), 0) ELSE 100 END AS INTEGER) AS oppose_pct FROM a) SELECT number, amended, place, n, oppose, support, oppose_pct, CAST(CASE WHEN oppose + support > 0 THEN 100 - oppose_pct ELSE 0 END AS INTEGER) AS support_pct, md5(sample) AS sample FROM x"""
)
def rule_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda f: F.lpad((F.col("item_id") * f % 1000).cast("string"), 3, "0")
    s = table(spark, sf_dir, "benchmark").select("item_id", F.concat(part(25), F.lit("."), part(7)).alias("number")).groupBy("number").agg(F.min("item_id").alias("place"))
    out = pages.rule_page(rich(spark, sf_dir), s, [CITATION, r"\bsection \d+"])
    lines = F.array_join(F.transform("sample", lambda x: F.concat_ws("/", x["id"], x["name"], x["position"], x["snippet"])), "|")
    return out.withColumn("sample", F.md5(lines)).withColumn("place", F.col("place").cast("long"))


@query(
    RICH
    + f"""SELECT total, oppose, support, unclear, with_attachments, {_pct("oppose", "total")} AS oppose_pct, {_pct("support", "total")} AS support_pct, {_pct("unclear", "total")} AS unclear_pct FROM (
    SELECT count(*) AS total, count(*) FILTER (position = 'Oppose') AS oppose, count(*) FILTER (position = 'Support') AS support, count(*) FILTER (position = 'Unclear') AS unclear, count(*) FILTER (trim(attachment_text) <> '') AS with_attachments FROM rich)"""
)
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.headline(rich(spark, sf_dir))


@query(
    RICH
    + f""", s AS (SELECT source AS campaign, {_SPLIT}, string_agg(id, ',' ORDER BY row_idx) AS ids FROM rich GROUP BY source), w AS (SELECT *, trim(text, ' ' || chr(10) || chr(9)) AS t FROM rich),
    l AS (SELECT source AS campaign, t, count(*) AS n, min(row_idx) AS f FROM w GROUP BY 1, 2), m AS (SELECT campaign, t FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, f) AS k FROM l) WHERE k = 1), e AS (SELECT t, count(*) AS exact FROM w WHERE t <> '' GROUP BY t)
    SELECT s.campaign, n, oppose, support, unclear, oppose_pct, CASE WHEN oppose + support > 0 THEN 100 - oppose_pct ELSE 0 END AS support_pct, CASE WHEN oppose > support AND oppose > unclear THEN 'Oppose' WHEN support > oppose AND support > unclear THEN 'Support' ELSE 'Mixed' END AS stance,
    row_number() OVER (ORDER BY n DESC, first_idx) AS rank, coalesce(exact, 0) AS exact, md5(CASE WHEN len(t) > 200 THEN left(t, 200) || '...' ELSE t END) AS preview, array_to_string(list_slice(string_split(ids, ','), 1, 10), ',') AS samples FROM s JOIN m USING (campaign) LEFT JOIN e USING (t)"""
)
def campaign_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators import cluster

    c = rich(spark, sf_dir).withColumn("campaign", F.col("source")).withColumn("t", T.strip("text"))
    label = cluster.canonical(c.select("row_idx", F.col("t").alias("label")), c.select("row_idx", F.col("campaign").alias("campaign_id"))).withColumnRenamed("campaign_id", "campaign")
    out = report.campaign_stats(c, canonical=label)
    return out.select("campaign", "n", "oppose", "support", "unclear", "oppose_pct", "support_pct", "stance", F.col("rank").cast("long").alias("rank"), "exact", F.md5("preview").alias("preview"), F.array_join("samples", ",").alias("samples"))


def _groups(column: str, name: str) -> str:
    return f"SELECT '{name}' AS kind, {column} AS value, count(*) AS n, string_agg(id || '/' || key_quote, '|' ORDER BY row_idx) FILTER (k <= 200) AS s FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY row_idx) AS k FROM rich) WHERE {column} <> '' GROUP BY 2"


@query(RICH + f"SELECT kind, value, n, md5(s) AS samples FROM ({_groups('state', 'state')} UNION ALL {_groups('party', 'party')})")
def group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rich(spark, sf_dir).withColumn("key_quote", F.coalesce("analysis.key_quote", F.lit("")))
    out = []
    for kind, name in (("state", "state_identified"), ("party", "political_affiliation")):
        g = report.group_samples(c.withColumn("value", F.coalesce(F.col("analysis")[name], F.lit(""))), "value", ["id", "key_quote"])
        out.append(g.select(F.lit(kind).alias("kind"), "value", "n", F.md5(F.array_join(F.transform("samples", lambda x: F.concat_ws("/", x["id"], x["key_quote"])), "|")).alias("samples")))
    return out[0].unionByName(out[1])


@query(RICH + "SELECT row_idx, posted FROM rich ORDER BY CASE WHEN posted <> '' THEN 0 ELSE 1 END, posted DESC, row_idx LIMIT 25 OFFSET 50")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a table sorted by day, newest first: a page is the feature."""
    return pages.table_page(rich(spark, sf_dir), "posted", page=3, descending=True).select("row_idx", "posted")


@query(RICH + "SELECT count(*) AS broken, (SELECT count(*) FROM rich WHERE posted <> '' AND received <> '' AND received = posted) AS same_day FROM rich WHERE posted <> '' AND received <> '' AND received > posted")
def date_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rich(spark, sf_dir)
    broken = pages.out_of_order(c).agg(F.count(F.lit(1)).alias("broken"))
    return broken.crossJoin(c.agg(F.count_if((F.col("posted") != "") & (F.col("received") == F.col("posted"))).alias("same_day")))


@query(RICH + r"SELECT count(DISTINCT v) AS distinct FROM (SELECT unnest(regexp_extract_all(text, '\d{3}\.\d{3}')) AS v FROM rich)")
def facet_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.facet_total(rich(spark, sf_dir), CITATION)


_ABOUT = "CAST(round_even(n / pow(10, floor(log10(n)) - 1), 0) * pow(10, floor(log10(n)) - 1) AS BIGINT)"


@query(
    RICH
    + f""", q AS (SELECT *, campaign_id IS NOT NULL AND campaign_id > 1 AS member FROM rich), b AS (SELECT 'stance' AS section, 0 AS place, 'Oppose' AS label, count(*) FILTER (position = 'Oppose') AS n FROM q UNION ALL SELECT 'stance', 1, 'Support', count(*) FILTER (position = 'Support') FROM q UNION ALL SELECT 'stance', 2, 'Unclear', count(*) FILTER (position = 'Unclear') FROM q
      UNION ALL SELECT 'campaigns', 3, 'in a campaign', count(*) FILTER (member) FROM q UNION ALL SELECT 'campaigns', 4, 'unique', count(*) FILTER (NOT member) FROM q UNION ALL SELECT 'attachments', 5, 'with attachment text', count(*) FILTER (trim(attachment_text) <> '') FROM q
      UNION ALL SELECT 'in a campaign by stance', 6, 'Oppose', count(*) FILTER (member AND position = 'Oppose') FROM q UNION ALL SELECT 'in a campaign by stance', 7, 'Support', count(*) FILTER (member AND position = 'Support') FROM q UNION ALL SELECT 'in a campaign by stance', 8, 'Unclear', count(*) FILTER (member AND position = 'Unclear') FROM q),
    e AS (SELECT coalesce(kind, 'Individual/Other') AS label, count(*) AS n, min(row_idx) AS f FROM q GROUP BY 1), t AS (SELECT row_idx, position, lang AS label FROM q WHERE analysed UNION ALL SELECT row_idx, position, 'license' FROM q WHERE analysed AND licensed),
    c AS (SELECT label, count(*) AS n, min(row_idx) AS f FROM t GROUP BY 1), s AS (SELECT label, count(*) AS n, min(row_idx) AS f FROM t WHERE position = 'Support' GROUP BY 1),
    v AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT row_idx, unnest(regexp_extract_all(text, '\\d{{3}}\\.\\d{{3}}')) AS label FROM q) GROUP BY 1),
    a AS (SELECT * FROM b UNION ALL SELECT 'submitters', row_number() OVER (ORDER BY n DESC, f), label, n FROM e UNION ALL SELECT 'concerns', row_number() OVER (ORDER BY n DESC, f), label, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, f) <= 15
      UNION ALL SELECT 'concerns of supporters', row_number() OVER (ORDER BY n DESC, f), label, n FROM s QUALIFY row_number() OVER (ORDER BY n DESC, f) <= 10 UNION ALL SELECT 'citations', row_number() OVER (ORDER BY n DESC, label), label, n FROM v QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 12)
    SELECT section, CAST(place AS INTEGER) AS place, label, n, CASE WHEN n = 0 THEN 0 ELSE {_ABOUT} END AS about, CAST(round_even(n * 100.0 / (SELECT count(*) FROM q), 0) AS INTEGER) AS pct FROM a"""
)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(rich(spark, sf_dir).withColumn("campaign_size", F.col("campaign_id")), CITATION)


@query(
    RICH
    + """SELECT row_idx, kind AS entity_type, CASE WHEN organization <> '' THEN organization ELSE submitter END AS organization, position, md5(left(trim(key_quote, ' ' || chr(10)), 400)) AS quote FROM rich
    WHERE kind IS NOT NULL AND kind <> 'Individual/Other' AND NOT coalesce(campaign_id > 1, false) AND trim(key_quote) <> '' ORDER BY len(text) DESC, row_idx LIMIT 40"""
)
def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rich(spark, sf_dir).withColumn("campaign_size", F.col("campaign_id"))
    c = c.withColumn("analysis", F.when(F.col("analysis").isNotNull(), F.col("analysis").withField("key_quote_match_score", F.length("text").cast("double"))))
    return pages.quote_candidates(c).select("row_idx", "entity_type", "organization", "position", F.md5("quote").alias("quote"))


# --- exports --------------------------------------------------------------------------------------------------------


@query(
    RICH
    + r"""SELECT 'DOC-' || CAST(d.doc_id AS VARCHAR) AS "Document ID", d.source AS "Source Name", d.n_chars AS "Size", r.position, concat_ws(' | ', CASE WHEN analysed AND pos <> 'Unclear' THEN 'Position: ' || pos END, CASE WHEN analysed THEN 'Concern: ' || r.lang END, CASE WHEN analysed AND licensed THEN 'Concern: license' END) AS stances,
    coalesce(kind, '') AS entity_type, CASE WHEN analysed AND pos = 'Oppose' THEN 'True' ELSE 'False' END AS stances__position_oppose, CASE WHEN analysed AND pos = 'Support' THEN 'True' ELSE 'False' END AS stances__position_support, CASE WHEN kind = 'Organization' THEN 'True' ELSE 'False' END AS entity_type__organization,
    CASE WHEN licensed THEN 'True' ELSE 'False' END AS licensed, array_to_string(list_filter(regexp_extract_all(r.text, '\d{3}\.\d{3}'), lambda x, i: list_position(regexp_extract_all(r.text, '\d{3}\.\d{3}'), x) = i), ' | ') AS citation_values, CAST(len(attachment_text) AS VARCHAR) AS attachment_char_count FROM rich r JOIN documents d ON d.doc_id = r.row_idx"""
)
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with all columns of its source row, found by id and text, and flat derived ones."""
    c = rich(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_idx"), F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("Document ID"), F.col("source").alias("Source Name"), F.col("text").alias("Body"), F.lit("").alias("Tracking Number"), F.col("n_chars").alias("Size"))
    a = F.col("analysis")
    derived = {"position": F.col("position"), "stances": a["stances"], "entity_type": a["entity_type"]}
    derived |= export.option_columns(a, c.schema["analysis"].dataType, {"stances": [position.OPPOSE, position.SUPPORT], "entity_type": ["Organization"]})
    derived |= {"licensed": F.col("licensed")} | export.value_columns(F.col("text"), {"citation": CITATION}) | {"attachment_char_count": F.length("attachment_text")}
    out = export.full_export(c, source, derived, {"id": "Document ID", "tracking": "Tracking Number", "text": "Body"})
    return out.drop("Body", "Tracking Number")


def _ranked(section: str, source: str, name: str, many: int) -> str:
    return f"""SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY n DESC, first_idx) AS INTEGER) AS place, name, n, oppose, support, unclear, oppose_pct, CASE WHEN oppose + support > 0 THEN 100 - oppose_pct ELSE 0 END AS support_pct, {_pct("n", "(SELECT count(*) FROM rich)")} AS pct, samples
    FROM (SELECT CAST({name} AS VARCHAR) AS name, {_SPLIT}, string_agg(id, ',' ORDER BY row_idx) FILTER (k <= {many}) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY row_idx) AS k FROM ({source})) GROUP BY {name})"""


_TAGGED = "SELECT *, lang AS concern FROM rich WHERE analysed UNION ALL SELECT *, 'license' FROM rich WHERE analysed AND licensed"
_SECTIONS = [("concerns", _TAGGED, "concern", 200), ("entity types", "SELECT *, coalesce(kind, 'Individual/Other') AS entity FROM rich", "entity", 200), ("states", "SELECT * FROM rich WHERE state <> ''", "state", 200), ("parties", "SELECT * FROM rich WHERE party <> ''", "party", 200), ("campaigns", "SELECT * FROM rich WHERE campaign_id IS NOT NULL", "campaign_id", 10)]
_TOTALS = [("comments", "true"), ("with attachments", "trim(attachment_text) <> ''"), ("in campaigns", "campaign_id IS NOT NULL")]


@query(
    RICH
    + " UNION ALL ".join(
        [f"SELECT 'totals' AS section, {i} AS place, '{name}' AS name, n, oppose, support, unclear, oppose_pct, CASE WHEN oppose + support > 0 THEN 100 - oppose_pct ELSE 0 END AS support_pct, {_pct('n', '(SELECT count(*) FROM rich)')} AS pct, '' AS samples FROM (SELECT {_SPLIT} FROM rich WHERE {cond})" for i, (name, cond) in enumerate(_TOTALS, 1)]
        + [_ranked(*x) for x in _SECTIONS]
    )
)
def whole_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.whole_briefing(rich(spark, sf_dir)).withColumn("samples", F.array_join("samples", ","))


# --- model runs -----------------------------------------------------------------------------------------------------

_ANSWERED = r"""CASE WHEN regexp_matches(p, '(?i)idiot|disgusting') THEN 'Position: Oppose' WHEN regexp_matches(p, '(?i)\bthe\b') THEN 'Position: Support' ELSE '' END"""


@query(
    C
    + rf""", q AS (SELECT row_idx, text, concat_ws(chr(10), CASE WHEN submitter <> '' THEN 'Submitter: ' || submitter END, CASE WHEN organization <> '' THEN 'Organization: ' || organization END, text) AS p FROM comments),
    f AS (SELECT *, regexp_matches(p, '(?i)licen[cs]e') AS failed FROM q)
    SELECT row_idx, CASE WHEN failed THEN 'stronger' ELSE 'scripted' END AS model_used, CASE WHEN failed THEN 5 ELSE 1 END AS attempts, {_ANSWERED} AS stances, CASE WHEN contains(lower(p), 'copyright') THEN 'Organization' ELSE 'Individual/Other' END AS entity_type FROM f"""
)
def model_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in waves with a log; where the first model fails, all its tries are spent and the stronger one answers."""
    c = comments(spark, sf_dir)
    calls = model.Calls(required=model.REQUIRED, fallback=model.Scripted("gristmill.plans.scripted:second_model", "stronger"))
    prompt = model.comment_prompt(F.col("text"), F.col("submitter"), F.col("organization"))
    said = model.ask_in_waves(c, "row_idx", prompt, model.Scripted("gristmill.plans.scripted:first_pass"), "", scratch_path(spark, "model-log"), waves=2, calls=calls)
    told = model.read_answers(said, "stances array<string>, entity_type string")
    kinds = infer.known_or(F.col("analysis.entity_type"), ["Organization"], pages.NOBODY)
    return told.select("row_idx", "model_used", "attempts", F.array_join(infer.only_known(F.col("analysis.stances"), [position.OPPOSE, position.SUPPORT]), "|").alias("stances"), kinds.alias("entity_type"))


@query(
    C
    + rf""", q AS (SELECT *, left(text, 2000) AS p, pos = 'Support' OR (pos = 'Oppose' AND len(text) < 800) AS fires FROM comments WHERE analysed), v AS (SELECT *, CASE WHEN fires THEN replace(CASE {_ANSWERED} WHEN '' THEN 'Unclear' ELSE {_ANSWERED} END, 'Position: ', '') END AS verdict FROM q)
    SELECT row_idx, CASE WHEN verdict IS NULL THEN NULL WHEN verdict = pos THEN 'confirmed' ELSE 'changed' END AS outcome, coalesce(verdict, CASE WHEN pos = 'Unclear' THEN 'Unclear' END) AS verified,
    concat_ws('|', CASE WHEN coalesce(verdict, pos) <> 'Unclear' THEN 'Position: ' || coalesce(verdict, pos) END, 'Concern: ' || lang, CASE WHEN licensed THEN 'Concern: license' END) AS tags, CASE WHEN fires THEN 'by words' END AS reasoning FROM v"""
)
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir).where("analysis is not null").withColumn("analysis", F.col("analysis").withField("verification_reasoning", F.lit(None).cast("string")))
    check = model.load_checks({"stance": "Which position?", "entity": "Who writes?"}, {})["stance"]
    out = model.second_pass(c, infer.stance_trigger(F.col("analysis"), F.col("text"), short_oppose=800), check, F.col("text"), model.Scripted("gristmill.plans.scripted:second_pass"))
    return out.select("row_idx", "outcome", F.col("analysis.verified_stance").alias("verified"), F.array_join("analysis.stances", "|").alias("tags"), F.col("analysis.verification_reasoning").alias("reasoning"))


# --- evaluation sets ------------------------------------------------------------------------------------------------

_CANDIDATES = (
    RICH
    + r""", j AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN trim(attachment_text) <> '' THEN text || chr(10) || '--- ATTACHMENT CONTENT ---' || chr(10) || attachment_text ELSE text END, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t, CASE WHEN pos IN ('Oppose', 'Support') THEN 'Position: ' || pos ELSE '(none)' END AS label FROM rich),
    e AS (SELECT *, CAST('0x' || substr(md5('eval' || id), 1, 8) AS BIGINT) AS h, count(*) OVER (PARTITION BY label) AS big FROM j WHERE len(t) > 40), cut AS (SELECT coalesce(nullif(CAST(floor(quantile_cont(len(t), 0.5) / 2) AS BIGINT), 0), 180) AS c FROM e)
    """
)


@query(_CANDIDATES + "SELECT label AS pipeline_label, count(*) AS n, count(*) FILTER (len(t) < (SELECT c FROM cut)) AS short FROM e GROUP BY 1")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many comments of each position can be judged, and how many of those are short."""
    c = score.judged(rich(spark, sf_dir), [position.OPPOSE, position.SUPPORT])
    return c.groupBy("pipeline_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < F.col("short_cutoff")).alias("short"))


@query(
    _CANDIDATES
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS k, 5 AS take FROM e)
    SELECT row_idx, label AS pipeline_label, round(CAST(big AS DOUBLE) / take, 2) AS weight, len(t) < (SELECT c FROM cut) AS is_short, organization <> '' AS is_org, campaign_id IS NOT NULL AS in_campaign FROM r WHERE k <= take"""
)
def candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen comments, five of each position: an evaluation set is a sample by design."""
    drawn = score.candidates(rich(spark, sf_dir), [position.OPPOSE, position.SUPPORT], size=15, floor=5)
    return drawn.select("row_idx", "pipeline_label", "weight", "is_short", "is_org", "in_campaign")


@query(RICH + "SELECT count(*) AS unreadable FROM rich WHERE regexp_matches(text, '(?i)attach|enclosed') AND len(text) < 400 AND trim(attachment_text) = ''")
def unreadable_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.unreadable(rich(spark, sf_dir))


# --- attachments ----------------------------------------------------------------------------------------------------


@query(
    r"""WITH f AS (SELECT conv_id AS doc, turn + 1 AS pos, 'attachment_' || CAST(turn + 1 AS VARCHAR) || '_' || CASE WHEN turn % 3 = 0 THEN 'Letter' || CASE turn % 2 WHEN 0 THEN '.txt' ELSE '.xyz' END ELSE 'annex' || CAST(turn AS VARCHAR) || '.txt' END AS filename, coalesce(text, '') AS text FROM conversations),
    c AS (SELECT doc, filename FROM f WHERE doc % 3 = 0 AND pos % 2 = 0), r AS (SELECT f.*, c.doc IS NOT NULL AND trim(text) <> '' AS cached FROM f LEFT JOIN c USING (doc, filename))
    SELECT doc, filename, md5(CASE WHEN cached OR filename LIKE '%.txt' THEN text ELSE '' END) AS text, CASE WHEN cached THEN '' WHEN filename LIKE '%.txt' THEN CASE WHEN trim(text) = '' THEN 'no text extracted' ELSE '' END ELSE 'no reader' END AS reason FROM r"""
)
def attachment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files, from a cache where that has them, else read by format."""
    t = F.col("turn")
    name = F.concat(F.lit("attachment_"), (t + 1).cast("string"), F.lit("_"), F.when(t % 3 == 0, F.concat(F.lit("Letter"), F.when(t % 2 == 0, ".txt").otherwise(".xyz"))).otherwise(F.concat(F.lit("annex"), t.cast("string"), F.lit(".txt"))))
    f = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (t + 1).alias("pos"), name.alias("filename"), T.text_or_empty("text").alias("body"))
    files = f.select("doc", "pos", "filename", F.col("body").cast("binary").alias("content"))
    cache = f.where("doc % 3 = 0 and pos % 2 = 0").select("doc", "filename", F.col("body").alias("text"))
    told, _ = attachments.read_through(files, cache, attachments.extracted)
    return told.select("doc", "filename", F.md5("text").alias("text"), "reason")


@query("SELECT coalesce(nullif(CAST(floor(quantile_cont(len(text), 0.5) / 2) AS BIGINT), 0), 180) AS short_cutoff FROM documents")
def short_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.short_cutoff(table(spark, sf_dir, "documents"))
