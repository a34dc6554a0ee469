"""Registered queries over all rows and whole texts: each against plain SQL or Python that leaves nothing out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import infer
from gristmill.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def oracle(sf, sql, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return con.execute(sql).fetchall()


def test_canonical_labels_of_all_users(spark, tmp_path):
    rows = [(i, (i * 7 % 5) * 200, "abc"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == u]
        labels = {r[2] for r in mine}
        want[u] = min(labels, key=lambda x: (-sum(r[2] == x for r in mine), min(r[0] for r in mine if r[2] == x)))
    assert max(want) == 800
    assert dict(QUERIES["canonical_labels"](spark, str(tmp_path)).collect()) == want


def test_previous_corpus_is_by_date(spark, sf):
    assert "row_idx < 800" not in SQL["quality_gate"]
    want = {(r[0], r[1]): r[2:] for r in oracle(sf, SQL["quality_gate"], "documents", "events", "labels")}
    got = {(r["scope"], r["bucket"]): tuple(r)[2:] for r in QUERIES["quality_gate"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(r[1] is not None for r in want.values())
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 and got[k][2] == want[k][2]


def test_gibberish_judges_whole_texts(spark, tmp_path):
    prose = "This is a long and clean sentence about the proposed rule. " * 20
    kinds = {prose: False, prose + "\x01\x02" * 40: True, "0123 4567 " * 60: True, prose[:600] + "0123456789" * 1500: True, "tiny": True}
    rows = [(i, t) for i, t in enumerate(t for t in kinds for _ in range(5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(QUERIES["gibberish"](spark, str(tmp_path)).collect()) == {i: kinds[t] for i, t in rows}


def test_gibberish_cases(spark):
    cases = {"abcde": True, "123 456 789 0123 17": True, "forty plain characters of a text or so..\x01\x02": True, "one line of plain text that is clean": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", T.gibberish("t")).collect()) == cases


def test_gibberish_as_whole_sql(spark, sf):
    assert "% 5" not in SQL["gibberish"] and "left(" not in SQL["gibberish"]
    assert dict(QUERIES["gibberish"](spark, sf).collect()) == dict(oracle(sf, SQL["gibberish"], "documents"))


def test_campaign_labels_of_whole_texts(spark, sf):
    assert "% 3" not in SQL["campaign_labels"] and "left(" not in SQL["campaign_labels"]
    assert dict(QUERIES["campaign_labels"](spark, sf).collect()) == dict(oracle(sf, SQL["campaign_labels"], "documents"))


def test_label_cases(spark):
    long, att = "twelve words make a body that stands for itself and needs nothing else", "what the file says"
    rows = [("Please see the attached file", att, att), (long[:30], att, att), (long, att, long), ("short", "", "short"), ("", "", "")]
    df = spark.createDataFrame(rows, "body string, att string, want string")
    assert [r[0] for r in df.select(T.label_text(F.col("body"), F.col("att")) != F.col("want")).collect()] == [False] * 5


@pytest.mark.parametrize("name", ["verify_field_triggers", "verify_field_writeback", "verify_outcomes"])
def test_second_pass_queries(spark, sf, name):
    got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    assert got and sorted(got, key=str) == sorted(oracle(sf, SQL[name], "documents", "events", "labels"), key=str)


FIELDS = "entity_type, verified_entity_type, entity_verification_reasoning, state_identified, state_quote, verified_state, state_verification_reasoning, political_affiliation, political_affiliation_quote, verified_political, political_verification_reasoning"


def test_second_pass_fields(spark):
    def row(text, **x):
        return (text, tuple(x.get(f) for f in FIELDS.split(", ")))

    rows = [
        row("I am an attorney in Ohio", entity_type="Attorney/Lawyer", state_identified="OH", state_quote="IN ohio"),
        row("The rule is bad", entity_type="Attorney/Lawyer", state_identified="OH", state_quote="in Ohio", political_affiliation="Democrat", political_affiliation_quote="q"),
        row("x", entity_type="Organization", verified_entity_type="", state_identified="OH", state_quote="q", verified_state="", political_affiliation="Democrat", verified_political=""),
        row("x", entity_type="Organization", verified_entity_type="Organization", state_quote="q"),
        ("x", None),
    ]
    df = spark.createDataFrame(rows, "text string, analysis struct<" + ", ".join(f"{f}: string" for f in FIELDS.split(", ")) + ">")
    a, t = F.col("analysis"), F.col("text")
    fires = [infer.entity_trigger(a, t, ["Organization"], True), infer.state_trigger(a, t), infer.political_trigger(a), infer.state_trigger(a, t, every=True)]
    got = [tuple(bool(x) for x in r) for r in df.select(*[F.coalesce(f, F.lit(False)) for f in fires]).collect()]
    assert got == [(False, False, False, True), (True, True, True, True), (True, False, False, False), (False, False, False, False), (False, False, False, False)]
    one = df.where("text like 'The%'")
    for verdict, state, quote, checked, why, outcome in ((None, "OH", "in Ohio", None, None, "error"), (" OH ", "OH", "in Ohio", "OH", "r", "confirmed"), (" ", "", "", "", "r", "cleared"), ("TX", "TX", "in Ohio", "TX", "r", "changed")):
        v = F.lit(verdict).cast("string")
        r = one.select(infer.STATE.write(a, v, F.lit("r")).alias("a"), infer.STATE.outcome(a, v).alias("o")).first()
        assert (r["a"]["state_identified"], r["a"]["state_quote"], r["a"]["verified_state"], r["a"]["state_verification_reasoning"], r["o"]) == (state, quote, checked, why, outcome)
        assert (r["a"]["political_affiliation"], r["a"]["entity_type"]) == ("Democrat", "Attorney/Lawyer")


@pytest.mark.parametrize(("name", "limit"), [("flag_sections", "k <= 500)"), ("entity_samples", "k <= 200)")])
def test_ids_up_to_the_limits(spark, name, limit):
    sf = "/root/testdata/sf0.01"  # sf0.001 has too few rows a group to tell
    assert limit in SQL[name]
    got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    assert sorted(got) == sorted(oracle(sf, SQL[name], "documents", "events", "labels"))
