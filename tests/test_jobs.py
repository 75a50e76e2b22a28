import json
import logging
from datetime import UTC, datetime

import pytest
from builders import SUMMARY, part, raw_frame, resource
from pyspark.sql import functions as F

from msgpipe.operators.store import Store
from msgpipe.operators.timing import slo_breaches, timing_summary
from msgpipe.plans.batch import ingest, run_label_batch, summarize
from msgpipe.plans.capture import Outcome, run_capture
from msgpipe.plans.replay import replay, replay_folder
from msgpipe.streaming.ingest import stream_messages
from msgpipe.workloads import queries

NOW = datetime(2026, 1, 1, tzinfo=UTC)
DAY = 86_400_000


def message(n, **kw):
    body = kw.pop("body", f"Body {n}, write to desk{n}@example.com")
    return resource(part("text/plain", body), f"msg-{n}", str(1_700_000_000_000 + n * DAY),
                    [("From", f"Person {n} <p{n}@example.com>"), ("To", "team@example.com"),
                     ("Subject", f"Subject {n} from p{n}@example.com")],
                    labelIds=["INBOX", "L1"], **kw)


def answer(n, **kw):
    return {"tl_dr": f"Short {n}", "summary": f"Long {n}", "key_points": [f"p{n}@example.com"],
            "action_items": [], "category": "note", **kw}


def answers_frame(spark, answers):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in answers.items()],
                                 "message_id string, answer string")


def folder(path, messages, answers, poison=True):
    path.mkdir()
    for n, m in enumerate(messages, 1):
        (path / f"{n:03d}_mail.json").write_text(json.dumps(m))
    if poison:
        (path / "poison_date.json").write_text(json.dumps(message(9, )).replace("17", "x"))
    (path / "llm_responses.json").write_text(json.dumps(answers))
    return str(path)


def samples(spark, path):
    rows = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value").collect()
    return {r.file_name: json.loads(r.value) for r in rows}


def test_replay_parses_each_answer_once(spark):
    """The check that nothing failed is a filter on finished rows, not on parsed answers."""
    raw = raw_frame(spark, [message(n) for n in range(1, 4)])
    answers = spark.createDataFrame(
        [(f"msg-{n}", json.dumps(answer(n))) for n in range(1, 4)], "message_id string, answer string")
    records = replay(raw, answers, "m", order=(), keep=["prompt"])
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    checks = [line for line in plan.splitlines() if "Filter" in line and "raise_error" in line]
    assert checks and not any("json" in line.lower() for line in checks)
    assert sorted(r.source_message_id for r in records.collect()) == ["msg-1", "msg-2", "msg-3"]
    with pytest.raises(Exception, match="msg-4: summarize: "):
        replay(raw_frame(spark, [message(4)]), spark.createDataFrame(
            [("msg-4", "{}")], "message_id string, answer string"), "m", order=()).collect()


def test_offline_replay(spark, tmp_path):
    source = folder(tmp_path / "in", [message(n) for n in range(1, 6)],
                    {f"msg-{n}": answer(n) for n in range(1, 6)})
    out = str(tmp_path / "out")
    replay_folder(spark, source, out, "demo-offline")
    first = samples(spark, out)
    assert sorted(first) == [f"{n:03d}_sample.json" for n in range(1, 6)]
    assert first["002_sample.json"] == {
        "source_message_id": "msg-2", "subject": "Subject 2 from [scrubbed]@example.com",
        "summary": answer(2), "model": "demo-offline", "tokens_prompt": None,
        "tokens_completion": None, "created_at": "2026-01-01T00:00:00.000000Z"}
    replay_folder(spark, source, out, "demo-offline")
    assert samples(spark, out) == first

    fewer = folder(tmp_path / "fewer", [message(1)], {"msg-1": answer(1)})
    replay_folder(spark, fewer, out, "demo-offline")
    assert sorted(samples(spark, out)) == ["001_sample.json"]


@pytest.mark.parametrize("messages, answers, text", [
    ([message(1), message(2), message(3)], {"msg-2": answer(2)}, "msg-1, msg-3"),
    ([message(1)], {"msg-1": answer(1, tl_dr="")}, "tl_dr is empty"),
    ([message(1), "{"], {"msg-1": answer(1)}, "not a JSON object"),
    ([], {}, "no messages found")])
def test_failed_replay_leaves_old_samples(spark, tmp_path, messages, answers, text):
    out = str(tmp_path / "out")
    good = folder(tmp_path / "good", [message(1)], {"msg-1": answer(1)})
    replay_folder(spark, good, out, "m")
    with pytest.raises(Exception, match=text):
        replay_folder(spark, folder(tmp_path / "bad", messages, answers), out, "m")
    assert sorted(samples(spark, out)) == ["001_sample.json"]


def test_batch_isolates_failures_and_repeats_add_nothing(spark, tmp_path):
    poison = {**message(2), "internalDate": "not-a-numeric-timestamp"}
    raw = raw_frame(spark, [message(1), poison, message(3), message(4), message(5)])
    answers = answers_frame(spark, {"msg-1": answer(1), "msg-2": answer(2),
                                    "msg-3": answer(3, category=5), "msg-5": answer(5)})
    store = Store(spark, str(tmp_path / "store"))
    result = ingest(raw, store, "m", now=NOW, responses=answers)
    assert (result.appended.inserted, result.dead_letter_count, result.dropped_count) == (2, 3, 0)
    letters = {r.source_message_id: r for r in store.dead_letters().collect()}
    assert {k: v.stage for k, v in letters.items()} == {
        "msg-2": "parse", "msg-3": "summarize", "msg-4": "summarize"}
    assert "not-a-numeric-timestamp" in letters["msg-2"].error
    assert result.outcomes.count() == result.records.count() + result.dead_letters.count()
    assert {r.source_message_id for r in store.records().collect()} == {"msg-1", "msg-5"}
    assert store.records().filter("subject like '%p1@example.com%'").count() == 0

    again = ingest(raw, store, "m", now=NOW, responses=answers, stage_mode="batch")
    assert (again.appended.inserted, again.appended.ignored) == (0, 2)
    assert again.totals.first().messages_processed == 2
    assert store.records().count() == 2 and store.dead_letters().count() == 6
    assert again.dead_letters.select("stage").distinct().collect() == [("summarize",)]


def test_batch_of_failures_only_still_succeeds(spark, tmp_path):
    raw = raw_frame(spark, ["{", {**message(1), "internalDate": "x"}])
    store = Store(spark, str(tmp_path / "store"))
    result = ingest(raw, store, "m", responses=answers_frame(spark, {"a": answer(1)}))
    assert result.appended.inserted == 0 and result.dead_letter_count == 2
    assert {r.stage for r in store.dead_letters().collect()} == {"read", "parse"}
    assert tuple(result.totals.first()) == (0, 2, 0, None, None)


def test_failed_dead_letter_write_is_counted_as_dropped(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(Store, "append_dead_letters",
                        lambda self, letters: (_ for _ in ()).throw(OSError("disk")))
    result = ingest(raw_frame(spark, [message(1), {**message(2), "internalDate": "x"}]), store,
                    "m", responses=answers_frame(spark, {"msg-1": answer(1)}))
    assert (result.dead_letter_count, result.dropped_count) == (0, 1)
    assert store.records().count() == 1
    assert result.totals.first().messages_dlq_dropped == 1


def test_label_batch_takes_the_newest(spark, tmp_path):
    raw = raw_frame(spark, [message(n) for n in range(1, 8)])
    labels = spark.createDataFrame([("reports", "L1")], "name string, label_id string")
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in range(1, 8)})
    store = Store(spark, str(tmp_path / "store"))
    run_label_batch(raw, labels, "reports", store, "m", limit=3, responses=answers)
    assert {r.source_message_id for r in store.records().collect()} == {"msg-5", "msg-6", "msg-7"}
    with pytest.raises(ValueError, match="Available labels: reports"):
        run_label_batch(raw, labels, "nope", store, "m", responses=answers)


def test_responder_is_asked_once_per_message(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder_name, summary = str(calls), SUMMARY

    def make():
        import json
        import uuid
        from types import SimpleNamespace

        def respond(prompt, system):
            open(f"{folder_name}/{uuid.uuid4().hex}", "w").close()
            if "Subject 2" in prompt:
                raise TimeoutError("too slow")
            assert "@example.com" in prompt and "p1@example.com" not in prompt
            return SimpleNamespace(content=json.dumps(summary), usage=[(10, 3), (None, 1)],
                                   stop_reason="end_turn")
        return respond

    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    store = Store(spark, str(tmp_path / "store"))
    result = ingest(raw_frame(spark, [message(1), message(2), message(3)]), store, "m",
                    make_responder=make, parallelism=2)
    assert len(list(calls.iterdir())) == 3
    assert {r.message_id for r in result.timings.collect()} == {"msg-1", "msg-3"}
    assert slo_breaches(result.timings).isEmpty()
    assert timing_summary(result.timings).first().messages == 2
    assert result.totals.first()[:1] == (2,) and result.totals.first().tokens_prompt_sum == 20
    assert result.totals.first().tokens_completion_sum == 8
    letter = store.dead_letters().first()
    assert letter.error == "too slow" and "TimeoutError" in letter.traceback


def test_responder_and_responses_exclude_each_other(spark):
    raw = raw_frame(spark, [message(1)])
    with pytest.raises(ValueError, match="either"):
        summarize(raw, "m")
    with pytest.raises(ValueError, match="model"):
        summarize(raw, "", responses=answers_frame(spark, {"a": answer(1)}))


def test_first_version_of_a_repeated_message_wins(spark, tmp_path):
    raw = raw_frame(spark, [message(1), {**message(2), "id": "msg-1"}]).withColumn(
        "seq", F.monotonically_increasing_id())
    store = Store(spark, str(tmp_path / "store"))
    emitted = str(tmp_path / "emitted")
    result = ingest(raw, store, "m", order=["seq"], emit_path=emitted,
                    responses=answers_frame(spark, {"msg-1": answer(1)}))
    assert (result.appended.inserted, result.appended.ignored) == (1, 1)
    assert result.totals.first().messages_processed == 2
    lines = [json.loads(r[0]) for r in spark.read.text(emitted).collect()]
    assert sorted(r["subject"][:9] for r in lines) == ["Subject 1", "Subject 2"]
    assert store.records().first().subject.startswith("Subject 1")


def test_logs_carry_numbers_only(spark, tmp_path, caplog):
    raw = raw_frame(spark, [message(1, body="SECRET-BODY"), {**message(2), "internalDate": "x"}])
    with caplog.at_level(logging.DEBUG, logger="msgpipe"):
        ingest(raw, Store(spark, str(tmp_path / "store")), "m",
               responses=answers_frame(spark, {"msg-1": answer(1, summary="SECRET-SUMMARY")}))
    text = "\n".join(r.getMessage() for r in caplog.records)
    assert "messages_processed=1 messages_dlq=1" in text
    assert "SECRET" not in text and "Subject" not in text and "Short" not in text


def test_stream_ingests_each_message_once(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in range(1, 4)})
    store = Store(spark, str(tmp_path / "store"))

    def drop(name, *messages):
        (feed / name).write_text("\n".join(
            json.dumps({"message_id": m["id"], "payload": json.dumps(m)}) for m in messages))

    def run():
        from msgpipe.sources.raw import from_table

        stream = spark.readStream.schema("message_id string, payload string").json(str(feed))
        stream_messages(from_table(stream), store, "m", str(tmp_path / "progress"),
                        available_now=True, responses=answers).awaitTermination()

    drop("1.json", message(1), message(2))
    run()
    changed = json.loads(json.dumps(message(1)).replace("Subject 1", "Changed"))
    drop("2.json", changed, message(3), {**message(4), "internalDate": "x"})
    run()
    run()
    assert {r.source_message_id: r.subject[:9] for r in store.records().collect()} == {
        "msg-1": "Subject 1", "msg-2": "Subject 2", "msg-3": "Subject 3"}
    assert [r.source_message_id for r in store.dead_letters().collect()] == ["msg-4"]


def capture_logs(tmp_path, records, durations):
    out, err = tmp_path / "run.log", tmp_path / "run.err.log"
    out.write_text("\n".join(["+ banner +", *(json.dumps(r) for r in records), ""]))
    err.write_text("noise\n" + "".join(
        f"INFO summary_completed message_id=m{i} tokens_prompt=1 tokens_completion=1 "
        f"duration_ms={ms}\n" for i, ms in enumerate(durations)))
    return str(out), str(err)


def captured(n):
    return {"source_message_id": f"m{n}", "subject": f"mail x{n}@example.org",
            "summary": answer(n), "model": "m", "tokens_prompt": 1, "tokens_completion": 2,
            "created_at": "2026-01-01T00:00:00Z"}


def test_capture(spark, tmp_path):
    out, err = capture_logs(tmp_path, [captured(2), captured(1)], [12345, 8000])
    result = run_capture(spark, out, str(tmp_path / "samples"), err)
    assert result.outcome is Outcome.OK
    assert tuple(result.timing.first()) == (2, 20345, 12345)
    documents = samples(spark, str(tmp_path / "samples"))
    assert [documents[n]["source_message_id"] for n in sorted(documents)] == ["m2", "m1"]
    assert documents["001_sample.json"]["subject"] == "mail [scrubbed]@example.com"
    assert documents["001_sample.json"]["summary"]["key_points"] == ["[scrubbed]@example.com"]


def test_capture_outcomes(spark, tmp_path):
    out, err = capture_logs(tmp_path, [captured(1)], [25000])
    assert run_capture(spark, out, str(tmp_path / "a"), err).outcome is Outcome.SLO_BREACH
    assert run_capture(spark, out, str(tmp_path / "a")).outcome is Outcome.OK
    out, err = capture_logs(tmp_path, [captured(1)], [])
    assert run_capture(spark, out, str(tmp_path / "a"), err).timing is None
    out, err = capture_logs(tmp_path, [], [25000])
    assert run_capture(spark, out, str(tmp_path / "b"), err).outcome is Outcome.NO_RECORDS
    assert not (tmp_path / "b").exists()


def test_label_batches_read_a_feed_written_once(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def seen(raw, *more, **options):
        files.append(raw.inputFiles())
        raise Seen

    spark.createDataFrame([(1, "a b", "en", "src7"), (2, None, None, None)],
                          "doc_id bigint, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id bigint, url string, html string") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    files = []
    monkeypatch.setattr(queries, "run_label_batch", seen)
    with pytest.raises(Seen):
        queries.run_label_batch_order(spark, str(tmp_path))
    assert files[0] and all("/feed-" in f for f in files[0])
