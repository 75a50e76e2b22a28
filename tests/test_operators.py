import json
from datetime import datetime

import pytest
from builders import SUMMARY
from pyspark.sql import functions as F

from msgpipe.functions.content import assemble_messages, content_text
from msgpipe.functions.prompt import INSTRUCTION, render_prompt
from msgpipe.operators.conversation import (
    conversation_payloads,
    conversation_turns,
    system_prompts,
)
from msgpipe.operators.numbering import global_row_number, sample_names
from msgpipe.operators.records import flatten_records, record_json, unflatten_records
from msgpipe.operators.respond import (
    MissingResponseError,
    Reply,
    lookup_responses,
    missing_responses,
    require_responses,
    respond_with,
    validate_answers,
)
from msgpipe.operators.firsts import first_per_key, new_rows
from msgpipe.operators.store import Store
from msgpipe.operators.timing import slo_breaches, slowest_message, timing_summary
from msgpipe.operators.usage import (
    completion_lines,
    run_totals,
    running_usage,
    token_usage,
    totals_line,
)
from msgpipe.schemas import SUMMARY_RECORD, conform, constraint_error, require_valid


def contents(spark, *values):
    df = spark.createDataFrame([(None if v is None else json.dumps(v),) for v in values],
                               "j string")
    return df.select(F.try_parse_json("j").alias("v"))


def test_content_text(spark):
    values = [None, "plain", [{"type": "text", "text": "a"}, {"type": "image", "text": "x"},
                              {"type": "text", "text": "b"}, {"type": "text"}, "str"], [], {"a": 1}]
    df = contents(spark, *values).select(content_text(F.col("v")))
    assert [r[0] for r in df.collect()] == ["", "plain", "ab", "", ""]


def test_assemble_messages(spark):
    values = [
        "hi",
        [{"role": "system", "content": "One."}, {"role": "user", "content": "q"},
         {"role": "system", "content": "Two."}],
        [{"content": [{"type": "text", "text": "x"}]}, {"role": "assistant", "content": None}],
        [{"role": "system", "content": ""}], []]
    rows = [r[0] for r in contents(spark, *values).select(assemble_messages(F.col("v"))).collect()]
    assert [r.system for r in rows] == [None, "One.\n\nTwo.", None, "", None]
    assert [[tuple(t) for t in r.turns] for r in rows] == [
        [("user", "hi")], [("user", "q")], [("user", "x"), ("assistant", "")], [], []]


def test_conversation_table(spark):
    rows = [(1, 0, "system", "One."), (1, 1, "user", "q"), (1, 2, "system", "Two."),
            (1, 5000, "system", "Late."), (2, 0, None, "hi"), (3, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    system = {r.conv_id: r.system for r in system_prompts(df).collect()}
    assert system == {1: "One.\n\nTwo.\n\nLate.", 3: ""}
    assert sorted(map(tuple, conversation_turns(df).collect())) == [
        (1, 1, "user", "q"), (2, 0, "user", "hi")]
    got = {r.conv_id: (r.n_turns, r.turn_chars, r.system)
           for r in conversation_payloads(df).collect()}
    assert got == {1: (1, 1, system[1]), 2: (1, 2, None), 3: (0, 0, "")}
    assert "Exchange" not in conversation_turns(df)._jdf.queryExecution().executedPlan().toString()


def test_prompt(spark):
    row = spark.range(1).select(render_prompt(F.lit("S"), F.lit("F"), F.lit("B\nC"))).first()
    assert row[0] == INSTRUCTION + "\n\nSubject: S\nFrom: F\nBody:\nB\nC"


def answered(spark, *answers):
    rows = [(f"m{i}", a if a is None or isinstance(a, str) else json.dumps(a))
            for i, a in enumerate(answers)]
    return validate_answers(spark.createDataFrame(rows, "message_id string, answer string"))


def test_valid_answers(spark):
    minimal = {k: SUMMARY[k] for k in ("tl_dr", "summary", "category")}
    rows = answered(spark, SUMMARY, minimal, {**SUMMARY, "key_points": []}).collect()
    assert all(r.err is None for r in rows)
    assert rows[0].summary.asDict() == SUMMARY
    assert rows[1].summary.key_points == [] and rows[1].summary.action_items == []


INVALID = [
    ("{", "invalid JSON"), ('{"tl_dr":"a","tl_dr":"b"}', "invalid JSON"), ([1], "not a JSON"),
    ("\"x\"", "not a JSON object"), ({**SUMMARY, "note": 1}, "unknown fields: note"),
    ({k: v for k, v in SUMMARY.items() if k != "summary"}, "summary is missing"),
    ({**SUMMARY, "tl_dr": ""}, "tl_dr is empty"), ({**SUMMARY, "tl_dr": 5}, "tl_dr is not text"),
    ({**SUMMARY, "category": None}, "category is not text"),
    ({**SUMMARY, "key_points": None}, "key_points"), ({**SUMMARY, "key_points": "k"}, "key_points"),
    ({**SUMMARY, "key_points": [1]}, "key_points"), ({**SUMMARY, "key_points": [None]}, "key_po"),
    ({**SUMMARY, "action_items": ["a", None]}, "action_items"), (None, "invalid JSON"),
    ({**SUMMARY, "extra": "x" * 500}, "unknown fields: extra")]


def test_invalid_answers(spark):
    for (answer, reason), row in zip(INVALID, answered(spark, *(a for a, _ in INVALID)).collect()):
        assert row.summary is None and row.err.stage == "summarize", answer
        assert reason in row.err.error, (answer, row.err.error)
        assert len(row.err.error.split("raw_output=", 1)[1]) <= 205


def test_lookup_and_missing(spark):
    messages = spark.createDataFrame([("a",), ("b",), ("c",)], "message_id string")
    responses = spark.createDataFrame([("a", "{}"), ("x", "{}")],
                                      "message_id string, answer string")
    rows = {r.message_id: r.err for r in lookup_responses(messages, responses).collect()}
    assert rows["a"] is None and "no answer for message_id 'b'" in rows["b"].error
    assert sorted(r[0] for r in missing_responses(messages, responses).collect()) == ["b", "c"]
    with pytest.raises(MissingResponseError, match="b, c"):
        require_responses(messages, responses)
    require_responses(messages.filter("message_id = 'a'"), responses)


class Silent(Exception):
    def __str__(self):
        return ""


class Broken(Exception):
    def __str__(self):
        raise ValueError

    __repr__ = __str__


def test_responder_failures_stay_in_their_row(spark):
    summary = SUMMARY

    def make():
        def respond(prompt, system):
            if prompt == "silent":
                raise Silent
            if prompt == "broken":
                raise Broken
            if prompt == "boom":
                raise ValueError("boom text")
            if prompt == "tool":
                return Reply([{"type": "tool_use"}], [(3, None)], "max_tokens")
            if prompt == "none":
                return Reply("", [])
            assert system == "sys"
            return Reply([{"type": "text", "text": json.dumps(summary)[:9]},
                          {"type": "text", "text": json.dumps(summary)[9:]}],
                         [(5, None), (None, 3), (2, 0)])
        return respond

    from pyspark import cloudpickle
    import msgpipe
    import sys

    cloudpickle.register_pickle_by_value(msgpipe)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame(
        [(p, "s", p, p == "skip") for p in
         ("ok", "silent", "broken", "boom", "tool", "none", "skip")],
        "message_id string, subject string, prompt string, skip boolean",
    ).withColumn("err", F.when(F.col("skip"), F.struct(
        F.lit("parse").alias("stage"), F.lit("bad").alias("error"), F.lit("").alias("traceback"))))
    rows = {r.message_id: r for r in validate_answers(
        respond_with(df, make, system="sys")).collect()}
    ok = rows["ok"]
    assert ok.err is None and ok.summary.asDict() == SUMMARY
    assert (ok.tokens_prompt, ok.tokens_completion) == (7, 3)
    assert rows["boom"].err.error == "boom text" and "ValueError" in rows["boom"].err.traceback
    assert rows["silent"].err.error == "Silent()" and rows["broken"].err.error == "<Broken>"
    assert "max_tokens" in rows["tool"].err.error and "'tool_use'" in rows["tool"].err.error
    assert "no text" in rows["none"].err.error and rows["tool"].tokens_prompt == 3
    assert rows["skip"].err.error == "bad"


def record(message_id="m", **kw):
    return {"source_message_id": message_id, "subject": "s", "summary": SUMMARY, "model": "x",
            "tokens_prompt": None, "tokens_completion": None,
            "created_at": datetime(2026, 1, 1), **kw}


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SUMMARY_RECORD)


def test_flatten_roundtrip_and_json(spark):
    df = records(spark, record("a", tokens_prompt=5), record("b"))
    assert unflatten_records(flatten_records(df)).collect() == df.collect()
    first = json.loads(record_json(df).orderBy("value").first()[0])
    assert first == {**record("a", tokens_prompt=5), "created_at": "2026-01-01T00:00:00.000000Z"}


def test_constraints(spark):
    base = record()
    cases = [({}, None), ({"source_message_id": ""}, "source_message_id"), ({"model": ""}, "model"),
             ({"tokens_prompt": -1}, "tokens_prompt"), ({"created_at": None}, "created_at"),
             ({"summary": {**SUMMARY, "category": ""}}, "summary.category"),
             ({"summary": {**SUMMARY, "key_points": [None]}}, "key_points"),
             ({"tokens_completion": 0}, None)]
    df = records(spark, *({**base, **change} for change, _ in cases))
    for (_, expected), row in zip(cases, df.select(constraint_error("summary_record")).collect()):
        assert (row[0] is None) if expected is None else expected in row[0]


def test_conform_fills_defaults_and_refuses_unknown_columns(spark):
    df = spark.createDataFrame([("read", "e")], "stage string, error string")
    row = conform(df, "dead_letter").first()
    assert row.source_message_id is None and row.traceback == "" and row.failed_at is not None
    with pytest.raises(ValueError, match="unknown columns"):
        conform(df.withColumn("x", F.lit(1)), "dead_letter")
    with pytest.raises(ValueError, match="missing columns"):
        conform(df.select("error"), "dead_letter")
    with pytest.raises(Exception, match="stage must be one of"):
        require_valid(df.withColumn("stage", F.lit("other")), "dead_letter").collect()


def test_first_per_key_keeps_one_row_per_task_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")],
                               "k string, seq int, v string")
    firsts = first_per_key(df, "k", ["seq"])
    assert sorted(map(tuple, firsts.collect())) == [("a", 1, "y"), ("b", 3, "z")]
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    stored = spark.createDataFrame([("a", 0)], "k string, other int")
    assert [r.k for r in new_rows(df, stored, "k", ["seq"]).collect()] == ["b"]


def test_store_appends_once_and_keeps_every_dead_letter(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create().create()
    first = store.append_records(records(spark, record("a", subject="1"), record("b"),
                                         record("a", subject="2")), ["subject"])
    assert (first.inserted, first.ignored) == (2, 1)
    again = store.append_records(records(spark, record("a", subject="3"), record("c")), ["subject"])
    assert (again.inserted, again.ignored) == (1, 1)
    assert {r.source_message_id: r.subject for r in store.records().collect()} == {
        "a": "1", "b": "s", "c": "s"}
    letters = spark.createDataFrame([("a", "read", "e"), ("a", "read", "e"), (None, "parse", "e")],
                                    "source_message_id string, stage string, error string")
    assert store.append_dead_letters(letters) == 3 and store.append_dead_letters(letters) == 3
    assert store.dead_letters().count() == 6
    with pytest.raises(Exception, match="error must not be empty"):
        store.append_dead_letters(letters.withColumn("error", F.lit("")))


def test_one_key_with_a_third_of_all_rows(spark):
    """Results stay whole and right when one id dominates, across shuffles."""
    rows = [("hot" if i % 3 == 0 else f"m{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "message_id string, seq int").repartition(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        firsts = {r.message_id: r.seq for r in first_per_key(df, "message_id", ["seq"]).collect()}
        answers = spark.createDataFrame([("hot", "{}"), ("m1", "{}")],
                                        "message_id string, answer string")
        found = lookup_responses(df, answers)
        counts = found.groupBy(F.col("err").isNull().alias("ok")).count().collect()
        calls = df.select("message_id", F.col("seq").alias("step"),
                          F.lit(1).cast("bigint").alias("tokens_prompt"),
                          F.lit(None).cast("bigint").alias("tokens_completion"))
        running = running_usage(calls, block_steps=100).filter("message_id = 'hot'").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert firsts["hot"] == 0 and len(firsts) == 4001
    assert {r.ok: r["count"] for r in counts} == {True: 2001, False: 3999}
    assert all(r.tokens_prompt == r.step // 3 + 1 for r in running) and len(running) == 2000


USAGE = "message_id string, step int, tokens_prompt bigint, tokens_completion bigint"


def test_token_usage(spark):
    df = spark.createDataFrame(
        [("a", 1, 5, 3), ("a", 2, 2, 1), ("b", 1, 5, None), ("b", 2, None, 3),
         ("c", 1, None, None), ("d", 1, 0, None)], USAGE)
    got = {r.message_id: (r.tokens_prompt, r.tokens_completion) for r in token_usage(df).collect()}
    assert got == {"a": (7, 4), "b": (5, 3), "c": (None, None), "d": (0, None)}


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_running_usage_over_blocks(spark, block):
    steps = [(m, s, None if s % 4 == 1 else s, s if s > 6 else None)
             for m in ("a", "b") for s in range(1, 12)] + [("c", 1, None, None)]
    rows = running_usage(spark.createDataFrame(steps, USAGE), block_steps=block).collect()
    got = {(r.message_id, r.step): (r.tokens_prompt, r.tokens_completion) for r in rows}
    for m, s, _, _ in steps:
        seen = [x for x in steps if x[0] == m and x[1] <= s]
        want = tuple(sum(v) if (v := [x[i] for x in seen if x[i] is not None]) else None
                     for i in (2, 3))
        assert got[m, s] == want
    assert len(rows) == len(steps)


def test_run_totals(spark):
    df = spark.createDataFrame([(100, 30), (None, None), (50, 10)],
                               "tokens_prompt bigint, tokens_completion bigint")
    assert tuple(run_totals(df, dead_letters=2, dropped=1).first()) == (3, 2, 1, 150, 40)
    empty = run_totals(df.limit(0))
    assert tuple(empty.first()) == (0, 0, 0, None, None)
    assert totals_line(empty).first()[0] == (
        "run_totals messages_processed=0 messages_dlq=0 messages_dlq_dropped=0 "
        "tokens_prompt_sum=None tokens_completion_sum=None")


def test_completion_lines_feed_the_timing_scan(spark):
    from msgpipe.sources.captures import timings_from_lines

    df = spark.createDataFrame([("a", 1, None, 70)], "source_message_id string, "
                               "tokens_prompt int, tokens_completion int, duration_ms int")
    assert [tuple(r) for r in timings_from_lines(completion_lines(df)).collect()] == [("a", 70)]


def timings(spark, *ms):
    return spark.createDataFrame([(f"m{i}", v) for i, v in enumerate(ms)],
                                 "message_id string, duration_ms bigint")


def test_timings_against_targets(spark):
    assert tuple(timing_summary(timings(spark, 12345, 8000)).first()) == (2, 20345, 12345)
    assert tuple(timing_summary(timings(spark)).first()) == (0, 0, 0)
    assert slo_breaches(timings(spark, 20000, 100000)).filter("target='NFR-P2'").count() == 0
    only = slo_breaches(timings(spark, 25000, 20000)).collect()
    assert [r.target for r in only] == ["NFR-P1"] and "m0 took 25000 ms" in only[0].breach
    six = slo_breaches(timings(spark, *[25000] * 6)).collect()
    assert sorted(r.target for r in six) == ["NFR-P1"] * 6 + ["NFR-P2"]
    assert tuple(slowest_message(timings(spark, 5, 9, 9)).first()) == ("m1", 9)
    assert slowest_message(timings(spark)).count() == 0


@pytest.mark.parametrize("ranges", [1, 2, 7, 500])
def test_global_row_number(spark, ranges):
    rows = [(i * 7919 % 1009 // 300, f"k{i:04d}") for i in range(1000)] + [(None, "z")]
    df = spark.createDataFrame(rows, "g int, k string").repartition(6)
    got = {r.k: r.n for r in global_row_number(df, ["g", "k"], "n", ranges).collect()}
    want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert got == {k: n for n, (_, k) in enumerate(want, 1)}


def test_sample_names_past_a_thousand(spark):
    names = sample_names(spark.range(1001), ["id"]).orderBy("id").collect()
    assert names[0].sample_name == "001_sample.json" and names[-1].sample_name == "1001_sample.json"
    assert sample_names(spark.range(0), ["id"]).count() == 0
