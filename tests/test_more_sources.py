"""Archive with its label index, large response objects, kept and concurrent replies."""

import json
from datetime import UTC, datetime

import pytest
from builders import raw_frame
from pyspark.sql import functions as F
from test_jobs import answer, answers_frame, message

from msgpipe.operators.conversation import conversation_messages, conversation_payloads
from msgpipe.operators.respond import lookup_responses, respond_kept, respond_with
from msgpipe.operators.store import Store
from msgpipe.operators.usage import running_usage
from msgpipe.plans.batch import ingest, run_label_batch
from msgpipe.sources.archive import Archive
from msgpipe.sources.raw import get_messages
from msgpipe.sources.responses import read_large_response_object, read_response_object

NOW = datetime(2026, 1, 1, tzinfo=UTC)


# Fetch by id

def test_one_row_per_request_whatever_repeats(spark):
    raw = raw_frame(spark, [message(1), {**message(1), "snippet": "later"}, message(2), "{broken"])
    raw = raw.withColumn("seq", F.when(F.get_json_object(F.to_json("payload"), "$.snippet") == "later",
                                       2).otherwise(1))
    raw = raw.withColumn("message_id", F.coalesce("message_id", F.lit("bad")))
    ids = spark.createDataFrame([("msg-1",), ("msg-1",), ("bad",), ("none",), (None,), ("",)],
                                "message_id string")
    got = get_messages(raw, ids, order=["seq"]).collect()
    assert sorted((r.message_id, r.seq, r.err and r.err.error) for r in got if r.message_id) == [
        ("bad", 1, "invalid JSON"), ("msg-1", 1, None), ("msg-1", 1, None),
        ("none", None, "unknown message_id: 'none'")]
    assert sum(r.message_id == "" and r.err.error == "no message_id given" for r in got) == 2
    assert len(get_messages(raw, ids).collect()) == 6


def test_label_batch_over_versions(spark, tmp_path):
    raw = raw_frame(spark, [message(1), {**message(1), "snippet": "x"}, message(2)]).withColumn(
        "seq", F.monotonically_increasing_id())
    labels = spark.createDataFrame([("reports", "L1")], "name string, label_id string")
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in (1, 2)})
    result = run_label_batch(raw, labels, "reports", Store(spark, str(tmp_path / "s")), "m",
                             limit=5, order=["seq"], responses=answers)
    assert result.appended.inserted == 2


# Archive

def test_archive_lists_and_fetches(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive")).create().create()
    assert archive.newest("L1", 3).count() == 0 and archive.fetch(archive.newest("L1", 3)).count() == 0
    archive.append(raw_frame(spark, [message(n) for n in (1, 40, 80)]))
    archive.append(raw_frame(spark, [message(n) for n in (2, 81, 1)]
                             + [{**message(5), "internalDate": "x"}, "{bad"]))
    assert [r.message_id for r in archive.newest("L1", 3).orderBy(F.desc("received_at")).collect()] == [
        "msg-81", "msg-80", "msg-40"]
    assert sorted(r.message_id for r in archive.newest("L1").collect()) == [
        "msg-1", "msg-2", "msg-40", "msg-5", "msg-80", "msg-81"]
    got = archive.fetch(archive.newest("L1", 2)).collect()
    assert sorted(r.message_id for r in got) == ["msg-80", "msg-81"]
    assert all(json.loads(r.payload.toJson())["id"] == r.message_id for r in got)
    assert archive.newest("L1", 0).count() == 0 and archive.newest("other", 2).count() == 0
    assert archive.newest("L1", 50).count() == 6


def test_archive_reads_one_label_and_the_latest_months(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive")).create()
    other = {**message(300), "labelIds": ["a b/c"]}
    archive.append(raw_frame(spark, [message(n) for n in range(1, 200, 10)] + [other]))
    newest = archive.newest("L1", 2)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "(label_id" in plan and "= L1)" in plan and "month" in plan
    read = archive.labelled("L1", archive.months("L1")[:1]).select(
        F.input_file_name().alias("f")).distinct().collect()
    assert len(read) >= 1 and all("label_id=L1/month=2024-05" in r.f for r in read)
    assert archive.months("a b/c") == ["2024-09"] and archive.newest("a b/c", 1).count() == 1


def test_label_batch_from_an_archive(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive")).create()
    archive.append(raw_frame(spark, [message(n) for n in range(1, 8)]))
    labels = spark.createDataFrame([("reports", "L1")], "name string, label_id string")
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in range(1, 8)})
    store = Store(spark, str(tmp_path / "store"))
    run_label_batch(archive, labels, "reports", store, "m", limit=3, responses=answers)
    assert {r.source_message_id for r in store.records().collect()} == {"msg-5", "msg-6", "msg-7"}
    with pytest.raises(ValueError, match="at least 1"):
        run_label_batch(archive, labels, "reports", store, "m", limit=0, responses=answers)


# Answers

def test_repeated_answers_are_reduced_and_texts_stay_where_they_are(spark):
    messages = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "message_id string")
    answers = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1), (None, "4", 1)],
                                    "message_id string, answer string, seq int")
    got = {r.message_id: (r.answer, r.err and r.err.stage)
           for r in lookup_responses(messages, answers).collect()}
    assert got == {"a": ("2", None), "b": ("3", None), "c": (None, "summarize"),
                   None: (None, "summarize")}
    from msgpipe.operators.respond import require_responses

    require_responses(messages.where("message_id in ('a', 'b')"), answers)


@pytest.mark.parametrize("pretty", [None, 2])
def test_a_large_object_is_read_in_splits(spark, tmp_path, pretty):
    tricky = ['a, "b": {', '\\"', "\\\\", "}],[{", 'é, "', "", ",,", "\n,\t"]
    data = {f"m{k},{tricky[k % 8]}": {"t": tricky[k % 8] * (k % 5), "l": [tricky[k % 8], {"x": [k, None]}],
                                      "n": k} for k in range(400)}
    path = tmp_path / "r.json"
    path.write_text(json.dumps(data, indent=pretty, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        frame = read_large_response_object(spark, str(path))
        got = {r.message_id: json.loads(r.answer) for r in frame.collect()}
        pieces = spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = {r.message_id: json.loads(r.answer) for r in read_response_object(spark, str(path)).collect()}
    assert pieces > 5 and got == whole == data


@pytest.mark.parametrize("text, error", [
    ("[1, 2]", "invalid JSON"), ("[1]", "top-level JSON object"), ('{"a": 1, "b": ', "invalid JSON"), ("", "invalid JSON"),
    ('{"a": 1} {"b": 2}', "invalid JSON"), ('{"a": 1, 2}', "invalid JSON"), ('{"a": 1,}', "invalid JSON")])
def test_large_objects_are_checked(spark, tmp_path, text, error):
    path = tmp_path / "r.json"
    path.write_text(text or " ")
    with pytest.raises(Exception, match=error):
        read_large_response_object(spark, str(path)).collect()


def test_small_forms_of_large_objects(spark, tmp_path):
    for k, (text, want) in enumerate([("{}", {}), ('{"a": 1}', {"a": "1"}),
                                      (' {"a" : "x,y" }\n', {"a": '"x,y"'})]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert {r.message_id: r.answer for r in
                read_large_response_object(spark, str(path)).collect()} == want


# Concurrent and kept calls

def _messages(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("message_id"), F.lit("s").alias("subject"),
        F.concat(F.lit("prompt "), "id").alias("prompt"))


def _responder(folder, barrier=0, fail_from=10**9):
    """Answers with the prompt; leaves one file per call."""
    def make():
        import json
        import os
        import time
        import uuid
        from types import SimpleNamespace

        def respond(prompt, system):
            running = f"{folder}/running-{uuid.uuid4().hex}"
            open(running, "w").close()
            started = time.monotonic()
            while barrier and time.monotonic() - started < 20:
                if len([f for f in os.listdir(folder) if f.startswith("running")]) >= barrier:
                    open(f"{folder}/met", "w").close()
                if os.path.exists(f"{folder}/met"):
                    break
                time.sleep(0.01)
            os.rename(running, running.replace("running", "done"))
            if int(prompt.split()[1]) >= fail_from:
                raise TimeoutError("too slow")
            return SimpleNamespace(content=json.dumps({"p": prompt}), usage=[(1, 2)],
                                   stop_reason="end")
        return respond

    return make


@pytest.fixture(autouse=True)
def travelling_code():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_32_calls_are_under_way_in_one_task(spark, tmp_path):
    messages = _messages(spark, 100).coalesce(1)
    rows = respond_with(messages, _responder(str(tmp_path), barrier=32), in_flight=32).collect()
    assert (tmp_path / "met").exists()
    assert [r.message_id for r in rows] == [f"m{k}" for k in range(100)]
    assert all(json.loads(r.answer)["p"] == f"prompt {k}" for k, r in enumerate(rows))
    with pytest.raises(ValueError, match="in_flight"):
        respond_with(messages, _responder(str(tmp_path)), in_flight=0)


def test_kept_replies_are_not_asked_again(spark, tmp_path):
    calls, kept = tmp_path / "calls", str(tmp_path / "kept")
    calls.mkdir()

    def run(n, **kw):
        rows = respond_kept(_messages(spark, n), _responder(str(calls), **kw), kept, waves=3).collect()
        done = len(list(calls.iterdir()))
        for f in calls.iterdir():
            f.unlink()
        return {r.message_id: r.err and r.err.error for r in rows}, done

    first, asked = run(10, fail_from=7)
    assert asked == 10 and {k for k, e in first.items() if e} == {"m7", "m8", "m9"}
    assert set(first.values()) == {None, "too slow"}
    second, asked = run(12)
    assert asked == 5 and set(second.values()) == {None} and len(second) == 12
    assert run(12) == (second, 0)


def test_ingest_with_kept_replies(spark, tmp_path):
    def make():
        import json
        from types import SimpleNamespace

        summary = {"tl_dr": "t", "summary": "s", "key_points": [], "action_items": [], "category": "c"}
        return lambda prompt, system: SimpleNamespace(
            content=json.dumps(summary), usage=[(10, 3)], stop_reason="end_turn")

    def never():
        raise AssertionError("asked again")

    raw = raw_frame(spark, [message(1), message(2), {**message(3), "internalDate": "x"}])
    path = str(tmp_path / "kept")
    for number, maker in enumerate((make, make)):
        result = ingest(raw, Store(spark, str(tmp_path / f"s{number}")), "m", now=NOW,
                        make_responder=maker, answers_path=path, in_flight=4)
        assert result.appended.inserted == 2 and result.dead_letter_count == 1
        assert result.totals.first().tokens_prompt_sum == 20
    assert spark.read.parquet(path).where("asked is not null").count() == 2


# Long messages and conversations

def test_equal_steps_of_a_long_message_are_spread(spark):
    n = 20_000
    calls = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("m"), (F.col("id") % 70).cast("string"))).when(
            F.col("id") % 10 == 1, F.lit(None)).otherwise(F.lit("hot")).alias("message_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).alias("step"),
        F.lit(1).cast("bigint").alias("tokens_prompt"),
        F.when(F.col("id") % 2 == 0, 2).cast("bigint").alias("tokens_completion"))
    got = running_usage(calls, block_steps=1000).where("message_id = 'hot'").collect()
    assert len(got) == n * 8 // 10
    assert sorted(r.tokens_prompt for r in got) == list(range(1, len(got) + 1))
    assert max(r.tokens_completion or 0 for r in got) == 2 * sum(
        k % 2 == 0 and k % 10 > 1 for k in range(n))
    # NULL steps come first.
    assert max(r.tokens_prompt for r in got if r.step is None) < min(
        r.tokens_prompt for r in got if r.step == 7)


def test_conversations(spark):
    rows = [(1, 0, "system", "One."), (1, 1, "user", "q"), (1, 2, "system", "Two."), (1, 3, None, "w"),
            (2, 0, "user", None), (2, 1, "assistant", "abc")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(map(tuple, conversation_payloads(df).collect())) == [
        (1, 2, 2, "One.\n\nTwo."), (2, 2, 3, None)]
    assert sorted(map(tuple, conversation_messages(df).select(
        "conv_id", "turn", "role", "text", "system").collect())) == [
        (1, 1, "user", "q", "One.\n\nTwo."), (1, 3, "user", "w", "One.\n\nTwo."),
        (2, 0, "user", "", None), (2, 1, "assistant", "abc", None)]
