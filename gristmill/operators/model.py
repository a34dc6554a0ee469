"""Questions to a model over a table: retries, a fallback model, time limits, resumable waves and recorded answers.

A model is any picklable object with ``name`` and ``ask(system, prompt) -> str`` (JSON).  The calls run in ``mapInPandas``, a
row's answer and error come back as text, and all that is judged about answers (schema, domains, outcomes) is done by
Column expressions on them.  No network is needed: ``Scripted`` answers by an importable function, ``Recorded`` from
earlier answers.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.functions.text import head_tail, strip, text_or_empty
from gristmill.operators.infer import CREDENTIAL_MARKERS, ENTITY, POLITICAL, STATE, Verified, signer_outcome, signers, slice_blocks, write_signers, write_stance
from gristmill.operators.score import EVIDENCE
from gristmill.sources import shared
from gristmill.sources.files import holds_parquet
from gristmill.storage import materialize, remove

#: Rows whose answers are kept together while a wave is under way.
SLICE = 64
ANSWER = "answer string, error string, model_used string, attempts int"
#: fixed values: seconds between tries when a service limits its rate, and how it says so
RATE_WAITS = (1, 2, 4, 8)
RATE_MARKERS = ("429", "RESOURCE_EXHAUSTED")
#: fixed value: what the first pass must answer
REQUIRED = ("stances", "key_quote", "rationale")


class CredentialsRejected(RuntimeError):
    """A rejected key or an empty account: every further call would fail alike, so the run ends."""


class Model(Protocol):
    name: str

    def ask(self, system: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class Scripted:
    """Answers by a function ``module:name`` of (system, prompt), imported where the call runs."""

    function: str
    name: str = "scripted"

    def ask(self, system: str, prompt: str) -> str:
        module, _, name = self.function.partition(":")
        return getattr(import_module(module), name)(system, prompt)


@dataclass(frozen=True)
class Recorded:
    """Answers by prompt from a mapping of bounded size; an unknown prompt is an error, which doesn't repeat it."""

    answers: dict[str, str]
    name: str = "recorded"

    def ask(self, system: str, prompt: str) -> str:
        if prompt not in self.answers:
            raise LookupError("no answer is recorded for this prompt")
        return self.answers[prompt]


@dataclass(frozen=True)
class Calls:
    """How a question is put: tries after the first, the limit of one call, what an answer must hold, who is asked next.

    ``at_once`` calls of a task are under way at a time.
    """

    retries: int = 3
    seconds: float = 30.0
    at_once: int = 1
    required: tuple[str, ...] = ()
    waits: tuple[float, ...] = RATE_WAITS
    fallback: Model | None = None
    sleep: Callable[[float], None] = field(default=time.sleep)


def within(seconds: float, call: Callable[[], str]) -> str:
    """The call's result; TimeoutError where it takes longer (its thread is left behind)."""
    box: dict[str, Any] = {}

    def run() -> None:
        try:
            box["value"] = call()
        except Exception as e:  # handed to the caller
            box["error"] = e

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if "error" in box:
        raise box["error"]
    if "value" not in box:
        raise TimeoutError(f"no answer within {seconds:g} s")
    return box["value"]


def lacking(answer: str, required: tuple[str, ...]) -> str | None:
    """What is wrong with an answer: no JSON, or fields that it lacks."""
    try:
        found = json.loads(answer)
    except ValueError as e:
        return f"{type(e).__name__}: {e}"
    lacks = [k for k in required if not isinstance(found, dict) or k not in found]
    return f"the answer lacks {', '.join(lacks)}" if lacks else None


def one_answer(model: Model, system: str, prompt: str, calls: Calls) -> tuple[str | None, str | None, int]:
    """answer, error, tries.  A service that limits its rate is waited for; that doesn't count as one of the tries.

    Only what the service raises is held against the markers of credentials and rates, never an answer or its place.
    """
    error, tries, waited = None, 0, 0
    while tries <= calls.retries:
        tries += 1
        try:
            answer = within(calls.seconds, lambda: model.ask(system, prompt))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if any(m in error.lower() for m in CREDENTIAL_MARKERS):
                raise CredentialsRejected(error) from e
            if any(m in error for m in RATE_MARKERS) and waited < len(calls.waits):
                calls.sleep(calls.waits[waited])
                waited, tries = waited + 1, tries - 1
            continue
        error = lacking(answer, calls.required)
        if error is None:
            return answer, None, tries
    return None, error, tries


def put_question(model: Model, system: str, prompt: str, calls: Calls) -> tuple[str | None, str | None, str, int]:
    """answer, error, model_used, tries: the fallback model is asked once all tries of the first have failed."""
    answer, error, tries = one_answer(model, system, prompt, calls)
    if answer is None and calls.fallback is not None:
        answer, error, more = one_answer(calls.fallback, system, prompt, calls)
        return answer, error, calls.fallback.name, tries + more
    return answer, error, model.name, tries


def answered(prompts: list[str], model: Model, system: str, calls: Calls) -> list[tuple]:
    """What ``put_question`` gives for each prompt, in their order; equal ones are asked once, ``at_once`` at a time."""
    known = list(dict.fromkeys(prompts))
    with ThreadPoolExecutor(max_workers=max(1, calls.at_once)) as pool:
        asked = [pool.submit(put_question, model, system, p, calls) for p in known]
        try:
            told = {p: a.result() for p, a in zip(known, asked, strict=True)}
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)  # what has not begun is not asked any more
            raise
    return [told[p] for p in prompts]


def ask_all(rows: DataFrame, key: str, prompt: Column, model: Model, system: str, calls: Calls = Calls()) -> DataFrame:
    """key, answer, error, model_used, attempts of every row.  Equal prompts of a batch are asked once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = pd.DataFrame(answered(frame["prompt"].tolist(), model, system, calls), columns=["answer", "error", "model_used", "attempts"], index=frame.index)
            yield pd.concat([frame[[key]], told], axis=1)

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text_or_empty(prompt).alias("prompt")).mapInPandas(run, f"{key} {kind}, {ANSWER}")


def ask_slices(rows: DataFrame, key: str, model: Model, system: str, calls: Calls, folder: str, size: int = SLICE) -> DataFrame:
    """As ``ask_all`` for ``rows`` (key, _prompt), with the answers of every ``size`` rows or so kept in a file when they are there.

    A task that is lost asks again for one slice only, as its next try finds the files of the others; so does a run that is
    started again.  An answer is taken from a file if key and prompt are the same.
    """
    slices = max(1, -(-rows.count() // size))
    kind, spark = dict(rows.dtypes)[key], rows.sparkSession
    dealt = rows.select(F.col(key).cast("string").alias("id"), text_or_empty("_prompt").alias("prompt"), F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices)).cast("int").alias("slice"))
    tasks = max(1, min(slices, spark.sparkContext.defaultParallelism * 4))
    dealt = dealt.repartition(tasks, "slice").sortWithinPartitions("slice", "id")
    names = ["answer", "error", "model_used", "attempts"]

    def done(part: pd.DataFrame, number: int) -> pd.DataFrame:
        path = f"{folder}/{slices}-{number}.json"
        asked = {(r.id, hashlib.md5(r.prompt.encode()).hexdigest()): r.prompt for r in part.itertuples()}
        told = {(x["id"], x["asked"]): x for x in json.loads(shared.read_file(path) or "[]") if x["error"] is None}
        rest = [k for k in asked if k not in told]
        for (i, h), found in zip(rest, answered([asked[k] for k in rest], model, system, calls), strict=True):
            told[i, h] = {"id": i, "asked": h} | dict(zip(names, found, strict=True))
        if rest:
            shared.write_file(path, json.dumps([told[k] for k in asked]).encode())
        return pd.DataFrame([[k[0], *(told[k][n] for n in names)] for k in asked], columns=["id", *names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            parts = list(frame.groupby("slice", sort=True))
            for number, part in parts[:-1]:
                yield done(part, number)
            held = parts[-1][1] if parts else None
        if held is not None:
            yield done(held, int(held["slice"].iloc[0]))

    return dealt.mapInPandas(run, f"id string, {ANSWER}").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)


def comment_prompt(text: Column, submitter: Column, organization: Column, clip: int | None = None) -> Column:
    """Who writes, where that is known, and the text, of which the first ``clip`` characters."""
    said = lambda name, c: F.when(text_or_empty(c) != "", F.concat(F.lit(f"{name}: "), c))
    body = F.substring(text_or_empty(text), 1, clip) if clip else text_or_empty(text)
    return F.concat_ws("\n", said("Submitter", submitter), said("Organization", organization), body)


def read_answers(answers: DataFrame, schema: StructType | str, repair: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Adds analysis: the answer as a record, its values held to their domains; null where there is no answer."""
    record = F.from_json("answer", schema if isinstance(schema, str) else schema.simpleString())
    return answers.withColumn("analysis", repair(F.when(F.col("answer").isNotNull(), record)))


def pending(rows: DataFrame, log: DataFrame | None, key: str) -> DataFrame:
    """Rows without an answer in the log; those whose last try ended in an error are asked again."""
    return rows if log is None else rows.join(log.where("error is null").select(key).distinct(), key, "left_anti")


def last_answers(log: DataFrame, key: str) -> DataFrame:
    """The answer of each key; an error only where there is no answer."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(F.col("error").isNull(), F.col("wave"))).alias("r")).select("r.*").drop("wave")


def ask_in_waves(rows: DataFrame, key: str, prompt: Column, model: Model, system: str, log: str, waves: int = 10, calls: Calls = Calls(), size: int = SLICE) -> DataFrame:
    """Ask what the log lacks, a wave of rows at a time; each wave is appended to the log when it ends, so a broken run goes on.

    The waves are slices by hash, so that no row is in two; inside a wave, answers are kept by smaller slices until it ends.
    What is open is found and stored once.  Returns key, answer, error, model_used, attempts of all rows.
    """
    spark = rows.sparkSession
    done = spark.read.parquet(log) if holds_parquet(spark, log) else None
    base = (done.agg(F.max("wave")).first()[0] if done is not None else None) or 0
    asked = materialize(rows.select(key, text_or_empty(prompt).alias("_prompt")), "questions")
    todo = materialize(pending(asked, done, key).withColumn("_wave", F.pmod(F.xxhash64(key), F.lit(waves))), "open-questions")
    folder = log.rstrip("/") + ".slices"
    for w in [r[0] for r in todo.select("_wave").distinct().orderBy("_wave").collect()]:  # at most as many as there are waves
        part = todo.where(F.col("_wave") == w).drop("_wave")
        ask_slices(part, key, model, system, calls, f"{folder}/{waves}-{w}", size).withColumn("wave", F.lit(base + w + 1)).write.mode("append").parquet(log)
    remove(spark, folder)
    if not holds_parquet(spark, log):  # nothing was asked, now or before
        return asked.select(key, *[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in ANSWER.split(", "))])
    return asked.select(key).join(last_answers(spark.read.parquet(log), key), key, "left")


# --- second pass ----------------------------------------------------------------------------------------------------

#: fixed values: how much of a text the second pass shows, and of a letter when signers are looked for
SECOND_PASS_CHARS = 2000
SIGNER_HEAD, SIGNER_TAIL = 15_000, 45_000


@dataclass(frozen=True)
class Check:
    """One field of the second pass: its prompt, where its verdict and reasoning stand in the answer, and what it changes."""

    name: str
    prompt: str
    verdict: str
    reasoning: str = "reasoning"
    fields: Verified | None = None
    allowed: tuple[str, ...] = ()

    def read(self, answer: Column) -> Column:
        value = F.get_json_object(answer, f"$.{self.verdict}")
        return F.when(value.isin(*self.allowed), value) if self.allowed else value


STANCES = ("Oppose", "Support", "Unclear")
CHECKS = {"entity": ("verified_entity_type", ENTITY), "state": ("verified_state", STATE), "political": ("verified_political", POLITICAL)}


def load_checks(prompts: dict[str, str], defaults: dict[str, str], entity_types: tuple[str, ...] = ()) -> dict[str, Check]:
    """The checks of a configuration: prompts for stance and entity must be there, the others have defaults."""
    if missing := [k for k in ("stance", "entity") if not prompts.get(k)]:
        raise ValueError(f"the second pass needs prompts for {' and '.join(missing)}")
    out = {"stance": Check("stance", prompts["stance"], "verified_stance", allowed=STANCES)}
    for name, (verdict, fields) in CHECKS.items():
        types = tuple(dict.fromkeys([*entity_types, "Individual/Other"])) if name == "entity" and entity_types else ()
        out[name] = Check(name, prompts.get(name) or defaults.get(name, ""), verdict, fields=fields, allowed=types)
    return out


def second_pass(rows: DataFrame, trigger: Column, check: Check, text: Column, model: Model, key: str = "row_idx", calls: Calls = Calls(retries=0), options: list[str] = ()) -> DataFrame:
    """``rows`` with the analysis after a check of those that the trigger picks, and its outcome (null: not asked).

    Only picked rows reach Python; the verdicts come back by a join on the key.  ``options``: the stances of the collection, whose
    position tags are written.
    """
    asked = ask_all(rows.where(F.coalesce(trigger, F.lit(False))), key, F.substring(text_or_empty(text), 1, SECOND_PASS_CHARS), model, check.prompt, calls)
    return with_verdicts(rows, asked, check, key, options)


def with_verdicts(rows: DataFrame, asked: DataFrame, check: Check, key: str = "row_idx", options: list[str] = ()) -> DataFrame:
    """``rows`` with what answers (key, answer; null: the call failed) say of one field, and the outcome (null: not asked)."""
    told = asked.select(key, F.struct(check.read(F.col("answer")).alias("verdict"), F.get_json_object("answer", f"$.{check.reasoning}").alias("why")).alias("_t"))
    out, a, verdict, why = rows.join(told, key, "left"), F.col("analysis"), F.col("_t.verdict"), F.col("_t.why")
    if check.fields is None:
        same = verdict.eqNullSafe(F.regexp_extract(F.array_join(F.coalesce(a["stances"], F.array().cast("array<string>")), "|"), "Position: (Oppose|Support)", 1))
        outcome = F.when(verdict.isNull(), "error").when(same, "confirmed").otherwise("changed")
        new = a.withField("stances", write_stance(a, verdict, options)).withField("verified_stance", F.coalesce(verdict, a["verified_stance"]))
        new = new.withField("verification_reasoning", F.when(verdict.isNotNull(), text_or_empty(why)).otherwise(a["verification_reasoning"]))
    else:
        outcome, new = check.fields.outcome(a, verdict), check.fields.write(a, verdict, why)
    asked_ = F.col("_t").isNotNull()
    return out.withColumn("outcome", F.when(asked_, outcome)).withColumn("analysis", F.when(asked_, new).otherwise(a)).drop("_t")


def signer_prompt(text: Column) -> Column:
    """A letter, or its head and its tail, where signers stand."""
    return head_tail(text, SIGNER_HEAD, SIGNER_TAIL)


def quotes_of(answer: Column) -> tuple[Column, Column]:
    """The first and last words of a signature block, as a model quotes them; empty where it names none."""
    return tuple(text_or_empty(F.get_json_object(answer, f"$.{k}")) for k in ("block_start", "block_end"))


def find_signers(rows: DataFrame, trigger: Column, text: str, model: Model, system: str, key: str = "row_idx", calls: Calls = Calls(retries=0)) -> DataFrame:
    """``rows`` with the signers of the letters that the trigger picks in their analysis, and the outcome (null: not asked).

    The model is shown a letter, or its head and tail, and quotes where the signers begin and end; the block between is cut
    from the whole text and its lines are read.
    """
    picked = rows.where(F.coalesce(trigger, F.lit(False)))
    return with_signers(rows, ask_all(picked, key, signer_prompt(F.col(text)), model, system, calls), text, key)


def with_signers(rows: DataFrame, said: DataFrame, text: str, key: str = "row_idx", rounds: int = 5) -> DataFrame:
    """``rows`` with the signers that answers (key, answer; null: the call failed) point at, and the outcome (null: not asked).

    A block goes on behind its last quote up to ``rounds`` times (``slice_blocks``); with 0 it is as it was quoted.
    """
    first, last = quotes_of(F.col("answer"))
    told = said.select(key, (F.get_json_object("answer", "$.has_cosigners") == "true").alias("_said"), first.alias("_first"), last.alias("_last"), text_or_empty(F.get_json_object("answer", "$.reasoning")).alias("_why"), F.col("answer").isNotNull().alias("_told"))
    found = rows.select(key, F.col(text).alias("_text")).join(told.where("_said"), key)
    cut = F.col("block") != ""  # no filter: it would be pushed down through all that the block is made of
    parsed = signers(slice_blocks(found, "_text", "_first", "_last", rounds=rounds), "block").select(key, F.when(cut, F.col("names")).alias("_names"), F.when(cut, F.col("count")).alias("_count"))
    told = told.select(key, F.struct(F.when(F.col("_told"), F.coalesce("_said", F.lit(False))).alias("said"), F.col("_why").alias("why")).alias("_t"))
    out, a, said_ = rows.join(told.join(parsed, key, "left"), key, "left"), F.col("analysis"), F.col("_t.said")
    asked = F.col("_t").isNotNull()
    out = out.withColumn("outcome", F.when(asked, signer_outcome(said_, F.col("_names"))))
    return out.withColumn("analysis", F.when(asked, write_signers(a, said_, F.col("_t.why"), F.col("_names"), F.col("_count"))).otherwise(a)).drop("_t", "_names", "_count")


# --- judging and labelling ------------------------------------------------------------------------------------------


def audit(rows: DataFrame, model: Model, system: str, log: str, key: str = "id", calls: Calls = Calls(retries=0), waves: int = 4) -> DataFrame:
    """key, disputed, reasoning: a judge's view of stated positions, resumed from the log; rows without a view are left out."""
    prompt = F.concat(F.lit("Position: "), F.col("position"), F.lit("\n\n"), F.col("text"))
    said = ask_in_waves(rows, key, prompt, model, system, log, waves, calls)
    view = F.get_json_object("answer", "$.disputed")
    return said.where(view.isin("true", "false")).select(key, (view == "true").alias("disputed"), text_or_empty(F.get_json_object("answer", "$.reasoning")).alias("reasoning"))


def disputed_ids(verdicts: DataFrame, key: str = "id") -> DataFrame:
    return verdicts.where("disputed").select(key).orderBy(key)


def draft_labels(candidates: DataFrame, model: Model, system: str, log: str, key: str = "id", calls: Calls = Calls(retries=2), waves: int = 4) -> DataFrame:
    """key, draft_label and the fields of EVIDENCE, empty where the model gave none: what ``score.review_sheet`` takes."""
    said = ask_in_waves(candidates, key, F.col("text"), model, system, log, waves, calls)
    part = lambda name: text_or_empty(F.get_json_object("answer", f"$.{name}"))
    return said.select(key, strip(part("label")).alias("draft_label"), *[part(f).alias(f) for f in EVIDENCE])
