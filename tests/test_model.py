"""Model calls over tables, with stand-ins that fail, wait and answer by rule."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gristmill.operators import infer, model

ANSWER = json.dumps({"stances": [], "key_quote": "", "rationale": ""})


class Says:
    """Raises or returns what it is given, one after the other."""

    def __init__(self, *said, name="says"):
        self.said, self.name = list(said), name

    def ask(self, system, prompt):
        x = self.said.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def test_tries_required_fields_and_fallback():
    calls = model.Calls(required=model.REQUIRED)
    assert model.one_answer(Says(ValueError("x"), "no json", '{"stances": []}', ANSWER), "", "", calls) == (ANSWER, None, 4)
    answer, error, tries = model.one_answer(Says(*["[1]"] * 4), "", "", calls)
    assert answer is None and "lacks" in error and tries == 4
    second = model.Calls(retries=0, fallback=Says(ANSWER, name="b"))
    assert model.put_question(Says(ValueError("x")), "", "", second) == (ANSWER, None, "b", 2)
    second = model.Calls(retries=0, fallback=Says(ValueError("y"), name="b"))
    assert model.put_question(Says(ValueError("x")), "", "", second) == (None, "ValueError: y", "b", 2)


class AuthenticationError(Exception):
    pass


@pytest.mark.parametrize("said", [AuthenticationError("no"), *[RuntimeError(f"Sorry: {m.upper()}") for m in infer.CREDENTIAL_MARKERS]], ids=str)
def test_rejected_credentials_end_the_run(said):
    with pytest.raises(model.CredentialsRejected):
        model.one_answer(Says(said), "", "", model.Calls())


def test_answers_cut_off_anywhere_are_tried_again():
    whole = json.dumps({"stances": [], "key_quote": "x" * 400, "rationale": "error code: 401 429"})
    waited = []
    for n in range(380, 440):
        calls = model.Calls(retries=1, required=model.REQUIRED, sleep=waited.append)
        assert model.one_answer(Says(whole[:n], whole), "", "", calls) == (whole, None, 2)
        assert model.one_answer(Says(whole[:n], whole[:n]), "", "", calls)[0] is None
    assert not waited


def test_what_a_prompt_says_is_no_error_of_credentials():
    answer, error, tries = model.one_answer(model.Recorded({}), "", "my 401(k), error code: 401, invalid_api_key, 429", model.Calls(retries=1))
    assert answer is None and "401" not in error and tries == 2


class Slow:
    name = "slow"

    def __init__(self, most=0):
        self.under_way = self.most = 0
        self.lock = threading.Lock()

    def ask(self, system, prompt):
        with self.lock:
            self.under_way += 1
            self.most = max(self.most, self.under_way)
        time.sleep(0.3)
        with self.lock:
            self.under_way -= 1
        return json.dumps({"said": prompt})


def test_calls_run_at_once_and_keep_their_order():
    slow, prompts, began = Slow(), [f"p{i}" for i in (3, 1, 2, 0, 7, 5, 6, 4, 1)], time.time()
    told = model.answered(prompts, slow, "", model.Calls(at_once=8))
    assert time.time() - began < 0.9 and slow.most == 8
    assert [json.loads(t[0])["said"] for t in told] == prompts
    one = Slow()
    model.answered(prompts[:3], one, "", model.Calls())
    assert one.most == 1


def counted_or_broken(system, prompt):
    """Notes that it was asked; breaks while there is a file that says so."""
    folder, _, name = prompt.rpartition("|")
    with open(f"{folder}/asked", "a") as f:
        f.write(f"{name}\n")
    if os.path.exists(f"{folder}/broken") and name == "t17":
        raise RuntimeError("insufficient_quota")
    return json.dumps({"said": name})


def test_a_broken_wave_loses_one_slice(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{tmp_path}|t{i}") for i in range(40)], "id long, text string")
    ask = lambda: model.ask_in_waves(rows, "id", F.col("text"), model.Scripted("tests.test_model:counted_or_broken"), "", f"{tmp_path}/log", 1, model.Calls(retries=0), size=4)
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="insufficient_quota"):
        ask().collect()
    first = (tmp_path / "asked").read_text().split()
    kept = sum(len(json.loads(f.read_text())) for f in tmp_path.glob("log.slices/*/*.json"))
    assert kept >= 4 and "t17" in first
    (tmp_path / "broken").unlink()
    got = {r["id"]: json.loads(r["answer"])["said"] for r in ask().collect()}
    assert got == {i: f"t{i}" for i in range(40)}
    again = (tmp_path / "asked").read_text().split()[len(first) :]
    assert len(again) == 40 - kept and "t17" in again  # only what no file had was asked again
    assert not list(tmp_path.glob("log.slices"))


def test_nothing_to_ask(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, text string")
    got = model.ask_in_waves(rows, "id", F.col("text"), model.Scripted("tests.test_model:all_right"), "", f"{tmp_path}/log")
    assert got.columns == ["id", "answer", "error", "model_used", "attempts"] and got.count() == 0


def test_rate_limits_are_waited_for():
    waited = []
    calls = model.Calls(retries=0, sleep=waited.append)
    assert model.one_answer(Says(*[RuntimeError("429")] * 3, ANSWER), "", "", calls)[0] == ANSWER and waited == [1, 2, 4]
    waited.clear()
    assert model.one_answer(Says(*[RuntimeError("429")] * 9), "", "", calls)[0] is None and waited == [1, 2, 4, 8]


def test_a_call_has_a_time_limit():
    import time

    with pytest.raises(TimeoutError):
        model.within(0.05, lambda: time.sleep(0.5) or "late")
    assert model.within(1, lambda: "in time") == "in time"


def broken_once(system, prompt):
    if prompt == "bad":
        raise RuntimeError("no")
    return json.dumps({"disputed": prompt.endswith("x"), "reasoning": prompt, "label": " oppose ", "evidence": "e"})


def all_right(system, prompt):
    return json.dumps({"disputed": False, "reasoning": "again"})


def test_waves_resume_from_the_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(9)], "id long, text string")
    log, none = str(tmp_path / "log"), model.Calls(retries=0)
    first = {r["id"]: r for r in model.ask_in_waves(rows, "id", F.col("text"), model.Scripted("tests.test_model:broken_once"), "", log, 3, none).collect()}
    assert len(first) == 9 and first[3]["answer"] is None and "no" in first[3]["error"] and json.loads(first[4]["answer"])["reasoning"] == "t4"
    again = {r["id"]: r for r in model.ask_in_waves(rows, "id", F.col("text"), model.Scripted("tests.test_model:all_right"), "", log, 3, none).collect()}
    assert json.loads(again[3]["answer"])["reasoning"] == "again"  # only what failed was asked again
    assert json.loads(again[4]["answer"])["reasoning"] == "t4"
    assert spark.read.parquet(log).count() == 10


def test_audit_and_drafts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Oppose", "x"), ("b", "Oppose", "y")], "id string, position string, text string")
    judge = model.Scripted("tests.test_model:broken_once")
    got = model.audit(rows, judge, "", str(tmp_path / "a"), waves=1)
    assert {r["id"]: r["disputed"] for r in got.collect()} == {"a": True, "b": False}
    assert [r["id"] for r in model.disputed_ids(got).collect()] == ["a"]
    drafts = model.draft_labels(rows, judge, "", str(tmp_path / "b"), waves=1).collect()
    assert {(r["draft_label"], r["evidence"], r["what_makes_it_hard"]) for r in drafts} == {("oppose", "e", "")} and len(drafts) == 2


def test_recorded_answers_and_records(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p")], "k int, text string")
    said = model.ask_all(rows, "k", F.col("text"), model.Recorded({"p": '{"stances": ["Position: Oppose"]}'}), "", model.Calls(retries=0))
    got = {r["k"]: r["analysis"] for r in model.read_answers(said, "stances array<string>").collect()}
    assert got[2] is None and got[1]["stances"] == ["Position: Oppose"] == got[3]["stances"]


def test_second_pass_needs_its_prompts_and_writes_back(spark):
    with pytest.raises(ValueError, match="stance and entity"):
        model.load_checks({}, {})
    checks = model.load_checks({"stance": "s", "entity": "e"}, {"state": "which state"}, ("Business",))
    assert checks["state"].prompt == "which state" and checks["entity"].allowed == ("Business", "Individual/Other")
    kind = "row_idx int, text string, analysis struct<stances:array<string>,verified_stance:string,entity_type:string,verified_entity_type:string,entity_verification_reasoning:string,verification_reasoning:string>"
    rows = spark.createDataFrame([(0, "a", (["Position: Support"], None, "Business", None, None, None)), (1, "b", (["Position: Support", "Concern: x"], None, "Business", None, None, None)), (2, "c", (["Position: Oppose"], None, "Robot", None, None, None)), (3, "d", None)], kind)
    judge = model.Recorded({"a": '{"verified_stance": "Support"}', "b": '{"verified_stance": "Oppose", "reasoning": "says so"}', "c": '{"verified_entity_type": "Business", "reasoning": "r"}'})
    out = {r["row_idx"]: r for r in model.second_pass(rows, infer.stance_trigger(F.col("analysis"), F.col("text")), checks["stance"], F.col("text"), judge).collect()}
    assert [out[i]["outcome"] for i in range(4)] == ["confirmed", "changed", None, None]
    assert out[1]["analysis"]["stances"] == ["Position: Oppose", "Concern: x"] and out[1]["analysis"]["verified_stance"] == "Oppose" and out[1]["analysis"]["verification_reasoning"] == "says so" and out[3]["analysis"] is None
    out = {r["row_idx"]: r for r in model.second_pass(rows, infer.entity_trigger(F.col("analysis"), F.col("text"), ["Robot", "Business"]), checks["entity"], F.col("text"), judge).collect()}
    assert [out[i]["outcome"] for i in range(4)] == ["error", "error", "changed", None]
    assert out[2]["analysis"]["entity_type"] == "Business" and out[2]["analysis"]["entity_verification_reasoning"] == "r" and out[0]["analysis"]["entity_type"] == "Business"


def test_prompts(spark):
    row = spark.createDataFrame([("text " * 20_000, "Ann", "")], "t string, s string, o string")
    got = row.select(model.comment_prompt(F.col("t"), F.col("s"), F.col("o"), 9).alias("p"), model.signer_prompt(F.col("t")).alias("l")).first()
    assert got["p"] == "Submitter: Ann\ntext text" and got["l"].startswith("text ") and len(got["l"]) < 60_100
    a, b = model.quotes_of(F.lit('{"block_start": "Ann"}'))
    assert tuple(row.select(a, b).first()) == ("Ann", "")
