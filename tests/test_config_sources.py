import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gristmill import config
from gristmill.operators import infer, model
from gristmill.sources import listing, sinks

RAW = {
    "fields": {"stances": {"type": "multi_enum", "options": ["Position: Oppose", "Position: Support"]}, "entity": {"type": "single_enum", "options": ["Person", "Firm"], "default": "Person"}, "note": {"description": "why"}, "cites": {"source": "regex", "pattern": "x"}},
    "regex_flags": {"mentions_cost": {"patterns": ["cost"]}, "odd": "ignored"},
    "quality_gate": {"min_batch": 7},
}


def test_config(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps(RAW))
    c = config.load(tmp_path)
    assert c.gate.min_batch == 7 and c.label("mentions_cost") == "Cost" and list(c.regex_flags) == ["mentions_cost"]
    assert c.schema().fieldNames()[:5] == ["stances", "entity", "note", "verified_stance", "verification_reasoning"]
    assert "Position: Oppose" in c.prompt() and "cites" not in c.prompt()
    df = spark.createDataFrame([({"stances": ["Position: Oppose", "?"], "entity": "Robot", "verified_state": "OH", "cosigner_checked": True},), (None,)], StructType([StructField("a", c.schema())]))
    got = [r[0] for r in df.select(c.repaired(F.col("a"))).collect()]
    assert tuple(got[0])[:3] == (["Position: Oppose"], "Person", "") and got[0]["verified_state"] == "OH" and got[0]["cosigner_checked"] and got[1] is None


def test_a_configured_record_goes_through_the_whole_second_pass(spark):
    """Triggers, verdicts and signers find their fields in the schema of any configuration."""
    c = config.parse({"fields": {"stances": {"type": "multi_enum", "options": ["Position: Oppose the rule", "Position: Support the rule"]}, "entity_type": {"type": "single_enum", "options": ["Firm", "Person"]}}})
    rows = spark.createDataFrame([(1, "We, the undersigned, agree.\nAnn Lee\nBob Ray", {"stances": ["Position: Support the rule"], "entity_type": "Firm", "state_identified": "OH", "state_quote": "Ohio", "political_affiliation": "Green"})], StructType([StructField("row_idx", LongType()), StructField("text", StringType()), StructField("analysis", c.schema())]))
    a, t, options = F.col("analysis"), F.col("text"), list(c.fields[0].options)
    checks = model.load_checks({"stance": "s", "entity": "e"}, {"state": "st", "political": "p"}, ("Firm", "Person"))
    told = {"stance": '{"verified_stance": "Oppose", "reasoning": "why"}', "entity": '{"verified_entity_type": "Person", "reasoning": "who"}', "state": '{"verified_state": "", "reasoning": "where"}', "political": '{"verified_political": "Green", "reasoning": "so"}'}
    triggers = {"stance": infer.stance_trigger(a, t), "entity": infer.entity_trigger(a, t, ["Firm"]), "state": infer.state_trigger(a, t), "political": infer.political_trigger(a)}
    for name, check in checks.items():
        rows = model.second_pass(rows, triggers[name], check, t, model.Recorded({rows.first()["text"]: told[name]}), options=options).withColumnRenamed("outcome", f"{name}_outcome")
    signed = model.Recorded({rows.first()["text"]: '{"has_cosigners": true, "block_start": "Ann Lee", "block_end": "Bob Ray", "reasoning": "two names"}'})
    rows = model.find_signers(rows, infer.signer_trigger(a, t, ["undersigned"]), "text", signed, "")
    got = rows.first()
    assert [got[f"{n}_outcome"] for n in checks] == ["changed", "changed", "cleared", "confirmed"] and got["outcome"] == "found"
    x = got["analysis"]
    assert x["stances"] == ["Position: Oppose the rule"] and (x["verified_stance"], x["verification_reasoning"]) == ("Oppose", "why")
    assert (x["entity_type"], x["verified_entity_type"], x["state_identified"], x["state_quote"], x["verified_political"]) == ("Person", "Person", "", "", "Green")
    assert (x["cosigner_checked"], x["cosigner_has_flag"], x["cosigner_names"], x["cosigner_count"], x["cosigner_reasoning"]) == (True, True, ["Ann Lee", "Bob Ray"], 2, "two names")
    assert rows.select(*[F.coalesce(f, F.lit(False)).alias(n) for n, f in {**triggers, "signers": infer.signer_trigger(a, t, ["undersigned"])}.items()]).first().asDict() == {"stance": False, "entity": False, "state": False, "political": False, "signers": False}
    assert c.schema().fieldNames() == rows.select(c.repaired(a).alias("a")).schema["a"].dataType.fieldNames()


def test_no_configuration_declares_nothing(tmp_path):
    assert config.load(tmp_path / "none") == config.Config()


def test_listing_walks_past_the_cap(spark, tmp_path):
    rows = [{"id": f"d{i}", "modified": f"2024-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}", "n": i} for i in range(120)]
    fetch = lambda since, page: [r for r in rows if r["modified"] >= since][(page - 1) * 10 : page * 10]
    assert [r["id"] for r in listing.walk(fetch, page_rows=10, pages=3)] == [r["id"] for r in rows]
    same = [{"id": f"s{i}", "modified": "t"} for i in range(40)]
    assert len(list(listing.walk(lambda s, p: same[(p - 1) * 10 : p * 10], page_rows=10, pages=3))) == 30  # a stalled cursor ends
    p = tmp_path / "l.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    assert listing.read_listing(spark, str(p), since="2024-01-01 00:01:00").count() == 60


def test_shards_and_lookup(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").alias("row_idx"), F.concat(F.lit("c"), F.col("id")).alias("id"), F.lit("v").alias("f"))
    sinks.write_shards(rows, f"{tmp_path}/s", ["f"], size=5)
    assert json.loads(sinks.lookup(spark, f"{tmp_path}/s", "c7", 1)) == {"f": "v"}
    assert sinks.lookup(spark, f"{tmp_path}/s", "c7", 0) is None
    sinks.append_log(rows, f"{tmp_path}/log")
    sinks.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 24
