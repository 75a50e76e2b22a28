"""The store: batches whole or not at all, failing rows apart, keys found by bucket."""

import json
from datetime import UTC, datetime

import pytest
from builders import raw_frame
from pyspark.sql import functions as F
from test_jobs import answer, answers_frame, message
from test_operators import record, records

from msgpipe.operators.export import emit_records, export_samples
from msgpipe.operators.guarded import write_guarded
from msgpipe.operators.key_index import KeyIndex, placed
from msgpipe.operators.records import flatten_records
from msgpipe.operators.store import KEY, Store
from msgpipe.plans.batch import ingest
from msgpipe.plans.capture import Outcome, run_capture
from msgpipe.streaming.ingest import stream_messages, stream_records

NOW = datetime(2026, 1, 1, tzinfo=UTC)


def ids(frame):
    return sorted(r[KEY] for r in frame.collect())


def many(spark, n, **change):
    return records(spark, *({**record(f"k{k}"), **change} for k in range(n)))


# Rows that make a write fail, and rows that break a constraint

def failing(frame, *bad):
    return frame.withColumn("subject", F.when(
        F.col(KEY).isin(list(bad)), F.raise_error(F.concat(F.lit("cannot write "), KEY)))
        .otherwise(F.col("subject")))


def test_rows_that_fail_the_write_are_isolated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    done = store.append_records(failing(many(spark, 60), "k7", "k30", "k31"), ["model"])
    assert (done.inserted, done.ignored, done.refused) == (57, 0, 3)
    assert ids(store.records()) == sorted({f"k{k}" for k in range(60)} - {"k7", "k30", "k31"})
    letters = {r[KEY]: (r.stage, r.error) for r in store.dead_letters().collect()}
    assert letters == {k: ("persist", f"cannot write {k}") for k in ("k7", "k30", "k31")}
    # Mended rows are new to the store; the others are known.
    again = store.append_records(many(spark, 60), ["model"])
    assert (again.inserted, again.ignored, again.refused) == (3, 57, 0)


def test_invalid_rows_are_refused_one_by_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    rows = records(spark, record("a"), {**record("b"), "tokens_prompt": -5},
                   {**record(None), "tokens_prompt": -5}, record(None), record(""),
                   {**record("c"), "model": ""}, record("a"))
    for _ in range(2):
        done = store.append_records(rows, ["tokens_prompt"])
        assert done.refused == 5 and done.inserted + done.ignored == 2
    assert ids(store.records()) == ["a"]
    letters = [(r[KEY], r.stage, r.error) for r in store.dead_letters().collect()]
    assert sorted(letters, key=str) == sorted(2 * [
        ("b", "persist", "tokens_prompt must not be negative"),
        (None, "persist", "source_message_id must not be empty"),
        (None, "persist", "source_message_id must not be empty"),
        ("", "persist", "source_message_id must not be empty"),
        ("c", "persist", "model must not be empty")], key=str)


def test_invalid_and_failing_rows_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    rows = failing(records(spark, *(record(f"k{k}") for k in range(20)),
                           {**record("x"), "model": ""}), "k3")
    done = store.append_records(rows, ["tokens_prompt"])
    assert (done.inserted, done.refused) == (19, 2)
    assert {(r[KEY], r.error) for r in store.dead_letters().collect()} == {
        ("k3", "cannot write k3"), ("x", "model must not be empty")}


def test_stored_form_and_empty_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    flat = flatten_records(many(spark, 3))
    assert store.append_records(flat, ["model"]).inserted == 3
    assert store.append_records(flat.limit(0), ["model"]).inserted == 0
    assert store.append_records(many(spark, 4), ["model"]).inserted == 1
    assert store.records().columns == flat.columns and store.dead_letters().count() == 0


def test_a_failure_that_is_not_about_rows_is_raised(spark, tmp_path):
    def broken(rows, piece):
        raise OSError("no space")

    with pytest.raises(OSError, match="no space"):
        write_guarded(many(spark, 3), KEY, broken, {"n": F.count(F.lit(1))})


def test_all_rows_failing_are_all_filed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    done = store.append_records(failing(many(spark, 3), "k0", "k1", "k2"), ["model"])
    assert (done.inserted, done.refused) == (0, 3) and store.dead_letters().count() == 3


def test_many_failing_keys_take_one_pass(spark, tmp_path):
    """Few writes however many keys fail, and rows with a key twice or with none stay whole."""
    store = Store(spark, str(tmp_path / "store")).create()
    number = F.regexp_extract(KEY, r"(\d+)$", 1).cast("int")

    def made(rows):
        return rows.withColumn("subject", F.when(number % 4 == 1, F.raise_error(F.concat(
            F.lit("cannot write "), KEY))).otherwise(F.col("subject")))

    writes = []

    def write(rows, piece):
        writes.append(piece)
        rows.write.parquet(str(tmp_path / piece))

    rows = many(spark, 40)
    written = write_guarded(rows, KEY, write, {"n": F.count(F.lit(1))}, made=made)
    bad = {f"k{k}" for k in range(1, 40, 4)}
    assert set(written.failed) == {(k, f"cannot write {k}") for k in bad}
    assert written.counts == {"n": 30} and len(writes) <= 3

    repeated = rows.unionByName(rows).unionByName(records(
        spark, {**record("x0"), "model": ""}, {**record("x2"), KEY: None}))
    done = store.append_records(repeated, ["model"], made=made)
    assert (done.inserted, done.ignored, done.refused) == (30, 40, 12)
    assert set(ids(store.records())) == {f"k{k}" for k in range(40)} - bad
    found = {(r[KEY], r.error) for r in store.dead_letters().collect()}
    assert {k for k, _ in found} == bad | {"x0", None}
    assert ("k5", "cannot write k5") in found


def test_ingest_files_refused_records(spark, tmp_path, monkeypatch):
    """A record that is fit to answer but not to store becomes a persist dead letter."""
    from msgpipe.operators import store as module

    store = Store(spark, str(tmp_path / "store"))
    raw = raw_frame(spark, [message(n) for n in range(1, 5)])
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in range(1, 5)})
    plain = module.constraint_error
    monkeypatch.setattr(module, "constraint_error", lambda kind: F.coalesce(plain(kind), F.when(
        F.col(KEY) == "msg-2", F.raise_error(F.lit("disk refused it")))))
    emitted = str(tmp_path / "emitted")
    result = ingest(raw, store, "m", now=NOW, responses=answers, emit_path=emitted)
    assert (result.appended.inserted, result.appended.refused) == (3, 1)
    assert (result.dead_letter_count, result.dropped_count) == (1, 0)
    assert result.totals.first().messages_processed == 3
    letter = store.dead_letters().first()
    assert (letter[KEY], letter.stage, letter.error) == ("msg-2", "persist", "disk refused it")
    lines = [json.loads(r[0])[KEY] for r in spark.read.text(emitted).collect()]
    assert sorted(lines) == ["msg-1", "msg-3", "msg-4"] == ids(store.records())


# Batches and the ledger

def test_an_open_batch_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    batch = store.begin("b1")
    appended = batch.append_records(many(spark, 3), ["model"])
    letters = spark.createDataFrame([("a", "read", "e")], f"{KEY} string, stage string, error string")
    filed = batch.append_dead_letters(letters)
    assert store.records().count() == 0 and store.dead_letters().count() == 0
    assert store.committed("b1") is None
    done = batch.commit(appended, filed)
    assert store.committed("b1") == done and (done.inserted, done.dead_letters) == (3, 1)
    assert store.records().count() == 3 and store.dead_letters().count() == 1
    with pytest.raises(ValueError, match="committed already"):
        store.begin("b1")


def test_what_a_lost_batch_left_does_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    lost = store.begin("b1")
    appended = lost.append_records(many(spark, 3), ["model"])
    # Its keys reach the index, but its ledger row is never written.
    store.index.add(many(spark, 3).select(F.col(KEY).alias("key")), lost.attempt, 3)
    assert appended.inserted == 3
    assert store.append_records(many(spark, 5), ["model"]).inserted == 5
    assert store.vacuum() == 1 and store.records().count() == 5


def test_stream_replays_a_batch_lost_between_its_two_appends(spark, tmp_path, monkeypatch):
    feed, progress = tmp_path / "feed", str(tmp_path / "progress")
    feed.mkdir()
    rows = [message(1), message(2), {**message(3), "internalDate": "x"}]
    (feed / "1.json").write_text("\n".join(
        json.dumps({"message_id": m["id"], "payload": json.dumps(m)}) for m in rows))
    answers = answers_frame(spark, {f"msg-{n}": answer(n) for n in (1, 2)})
    store = Store(spark, str(tmp_path / "store"))

    def run():
        from msgpipe.sources.raw import from_table

        stream = spark.readStream.schema("message_id string, payload string").json(str(feed))
        stream_messages(from_table(stream), store, "m", progress, available_now=True,
                        responses=answers).awaitTermination()

    commit = Store.commit

    def lost(self, *args, **kw):
        if after_commit:
            commit(self, *args, **kw)
        raise RuntimeError("the driver is gone")

    for after_commit in (False, True):
        monkeypatch.setattr(Store, "commit", lost)
        with pytest.raises(Exception, match="the driver is gone"):
            run()
        assert store.records().count() == store.dead_letters().count() * 2 == 2 * after_commit
    monkeypatch.setattr(Store, "commit", commit)
    run()
    assert ids(store.records()) == ["msg-1", "msg-2"] and store.dead_letters().count() == 1
    assert store.commits().count() == 1


def test_stream_takes_stored_records(spark, tmp_path):
    feed = str(tmp_path / "feed")
    flatten_records(many(spark, 3)).write.parquet(feed)
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(flatten_records(many(spark, 1)).schema).parquet(feed)
    stream_records(stream, store, str(tmp_path / "progress"), order=["subject"],
                   available_now=True).awaitTermination()
    assert ids(store.records()) == ["k0", "k1", "k2"]


# The key index

def test_index_finds_every_key_and_hardly_any_other(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index")).create(buckets=4, bucket_keys=1000)
    held = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    index.add(held, "a1", 3000)
    attempts = spark.createDataFrame([("a1",)], "attempt string")
    assert index.stored(held, attempts).count() == 3000
    other = spark.range(20_000).select(F.concat(F.lit("new"), "id").alias("key"))
    assert index.probe(other).maybe.count() < 200
    assert index.stored(other, attempts).count() == 0
    assert index.stored(held, attempts.limit(0)).count() == 0
    null = spark.createDataFrame([(None,), ("k1",), ("k1",)], "key string")
    assert [r.key for r in index.stored(null, attempts).collect()] == ["k1"]


def _files(frame):
    return {f.rpartition("/")[0].rpartition("/")[2] for f in frame.inputFiles()}


def test_a_batch_reads_only_the_buckets_it_can_hit(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index")).create(buckets=64, bucket_keys=200)
    held = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    index.add(held, "a1", 6000)
    new = index.probe(spark.createDataFrame([("never seen",)], "key string"))
    assert new.buckets == [] and _files(index.keys(new.buckets)) == {"bucket=-1"}
    some = spark.createDataFrame([("k17",), ("k4711",), ("x1",), ("x2",)], "key string")
    want = {r.bucket for r in placed(some.where("key like 'k%'"), index.layout()).collect()}
    probe = index.probe(some)
    assert set(probe.buckets) == want
    assert _files(index.keys(probe.buckets)) == {f"bucket={b}" for b in want}


def test_a_growing_index_deals_its_keys_to_more_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create(buckets=2, bucket_keys=50)
    sizes = []
    for part in range(4):
        batch = records(spark, *(record(f"p{part}-{k}") for k in range(150)))
        assert store.append_records(batch, ["model"]).inserted == 150
        layout = store.index.layout()
        per_bucket = store.index.keys().groupBy("bucket").count()
        sizes.append(per_bucket.agg(F.max("count")).first()[0])
        assert store.index.keys().count() == 150 * (part + 1)
    assert (layout.generation, layout.buckets) == (2, 32)
    assert max(sizes) < 120
    assert not (tmp_path / "store/key_index/generation-0000").exists()
    again = store.append_records(records(spark, record("p0-3"), record("p3-9"), record("n")), ["model"])
    assert (again.inserted, again.ignored) == (1, 2)


# Other outputs

def test_foreign_files_survive(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "notes.txt").write_text("mine")
    for _ in range(2):
        emit_records(many(spark, 2), str(out))
        assert export_samples(many(spark, 2), str(out), [KEY]) == 2
    assert (out / "notes.txt").read_text() == "mine"
    assert sorted(p.name for p in out.iterdir() if p.name[0] != ".") == [
        "001_sample.json", "002_sample.json", "emitted=records", "notes.txt"]
    assert json.loads((out / "002_sample.json").read_text())[KEY] == "k1"
    assert spark.read.text(str(out / "emitted=records")).count() == 2


def test_a_failing_export_leaves_the_old_samples(spark, tmp_path):
    out = str(tmp_path / "out")
    export_samples(many(spark, 3), out, [KEY])
    with pytest.raises(Exception, match="cannot write k1"):
        export_samples(failing(many(spark, 2), "k1"), out, [KEY])
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert len(list((tmp_path / "out").glob("*_sample.json"))) == 3
    export_samples(many(spark, 1), out, [KEY])
    assert [p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".json"] == ["001_sample.json"]


def test_completion_log_of_a_run_feeds_the_capture_job(spark, tmp_path):
    def make():
        import json
        from types import SimpleNamespace

        summary = {"tl_dr": "t", "summary": "s", "key_points": [], "action_items": [],
                   "category": "c"}
        return lambda prompt, system: SimpleNamespace(
            content=json.dumps(summary), usage=[(10, 3)], stop_reason="end_turn")

    emitted, log = str(tmp_path / "emitted"), str(tmp_path / "log")
    raw = raw_frame(spark, [message(1), message(2), {**message(3), "internalDate": "x"}])
    ingest(raw, Store(spark, str(tmp_path / "store")), "m", now=NOW, make_responder=make,
           emit_path=emitted, log_path=log, token="run 1")
    result = run_capture(spark, emitted, str(tmp_path / "samples"), log)
    assert result.outcome is Outcome.OK and result.timing.first().messages == 2
    assert len(list((tmp_path / "samples").glob("*_sample.json"))) == 2
