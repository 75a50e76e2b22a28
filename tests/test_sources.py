import json
from datetime import datetime

import pytest
from builders import SUMMARY, raw_frame, resource
from pyspark.sql import functions as F

from msgpipe.sources.captures import read_captured_records, read_timings
from msgpipe.sources.listing import (
    LabelNotFoundError,
    label_index,
    list_by_label,
    list_indexed,
    list_messages,
    message_index,
    resolve_label,
    write_label_index,
)
from msgpipe.sources.raw import (
    get_messages,
    numbered_lines,
    read_message_files,
    read_message_lines,
    read_message_table,
)
from msgpipe.sources.responses import (
    read_response_lines,
    read_response_object,
    read_response_table,
)


def write(folder, **files):
    for name, content in files.items():
        text = content if isinstance(content, str) else json.dumps(content)
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_message_files_in_name_order_without_poison(spark, tmp_path):
    folder = write(tmp_path, b__json=resource({}, "2"), a__json=resource({}, "1"),
                   poison_x__json="{", llm_responses__json="{}", note__txt="x")
    rows = read_message_files(spark, folder).orderBy("origin", "position").collect()
    assert [r.message_id for r in rows] == ["1", "2"]


@pytest.mark.parametrize("content, reason", [
    ("{", "invalid JSON"), ("[1]", "not a JSON object"), ('{"id": ""}', "missing top-level 'id'"),
    ('{"x": 1}', "missing top-level 'id'"), ('{"id": 5}', "'id' is not text")])
def test_bad_file_fails_with_its_path_or_becomes_a_read_error(spark, tmp_path, content, reason):
    folder = write(tmp_path, bad__json=content, good__json=resource({}, "g"))
    with pytest.raises(Exception, match=r"bad\.json: .*" + reason.split("'")[0]):
        read_message_files(spark, folder).collect()
    rows = read_message_files(spark, folder, strict=False).collect()
    errors = [r.err for r in rows if r.err is not None]
    assert [r.message_id for r in rows if r.err is None] == ["g"]
    assert len(errors) == 1 and errors[0].stage == "read" and reason in errors[0].error


def test_message_lines_and_table(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(json.dumps(resource({}, f"m{i}")) for i in range(5)) + "\n\n")
    raw = read_message_lines(spark, str(path))
    assert [r.message_id for r in raw.orderBy("position").collect()] == [f"m{i}" for i in range(5)]
    stored = str(tmp_path / "table")
    raw.select("message_id", F.to_json("payload").alias("payload")).write.parquet(stored)
    assert read_message_table(spark, stored).filter("err is null").count() == 5


def test_line_positions_follow_the_file_across_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(f"{i} " + "x" * (i % 50) for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = numbered_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        rows = lines.orderBy("position").select(F.split("value", " ")[0].cast("int")).collect()
        distinct = lines.select("position").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == list(range(20_000)) and distinct == 20_000


def test_get_messages_reports_unknown_and_empty_ids(spark):
    raw = raw_frame(spark, [resource({}, "a"), resource({}, "b")])
    ids = spark.createDataFrame([("a",), ("zz",), ("",), (None,), ("a",)], "message_id string")
    rows = sorted(get_messages(raw, ids).collect(), key=lambda r: r.message_id)
    assert [r.message_id for r in rows] == ["", "", "a", "a", "zz"]
    assert [r.err.error if r.err else None for r in rows] == [
        "no message_id given", "no message_id given", None, None, "unknown message_id: 'zz'"]
    assert all(r.err is None or r.err.stage == "read" for r in rows)


def labelled(spark):
    return message_index(raw_frame(spark, [
        resource({}, f"m{i}", date=str(1000 * i), labelIds=["INBOX"] + ["L1"] * (i % 2))
        for i in range(6)]))


def test_list_messages(spark):
    index = labelled(spark)

    def listed(*a):
        return [r[0] for r in list_messages(index, *a).collect()]

    assert sorted(listed("L1")) == ["m1", "m3", "m5"]
    assert listed("L1", 2) == ["m5", "m3"]
    assert listed("INBOX", 99) == ["m5", "m4", "m3", "m2", "m1", "m0"]
    assert listed("L1", 0) == [] and listed("L1", -1) == [] and listed("nope") == []
    plan = list_messages(index, "L1", 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_resolve_label(spark):
    labels = spark.createDataFrame(
        [("b", "L1", 0), ("a", "L2", 1), ("b", "L3", 2)], "name string, label_id string, seq int")
    assert resolve_label(labels, "b") == "L3"
    with pytest.raises(LabelNotFoundError, match=r"'x' not found. Available labels: a, b\."):
        resolve_label(labels, "x")
    with pytest.raises(LabelNotFoundError, match=r"\(none\)"):
        resolve_label(labels.limit(0), "x")


def test_list_by_label_checks_its_cap_first(spark):
    raw = raw_frame(spark, [resource({}, "m1", labelIds=["L1"])])
    labels = spark.createDataFrame([("one", "L1")], "name string, label_id string")
    assert [r[0] for r in list_by_label(raw, labels, "one").collect()] == ["m1"]
    with pytest.raises(ValueError, match="at least 1"):
        list_by_label(raw, labels, "one", 0)


def test_label_index_is_pruned_by_label(spark, tmp_path):
    path = str(tmp_path / "index")
    write_label_index(labelled(spark), path)
    hits = spark.read.parquet(path).filter("label_id = 'L1'")
    assert hits.count() == 3 and label_index(labelled(spark)).count() == 9
    stored = spark.read.parquet(path)
    assert [r[0] for r in list_indexed(stored, "L1", 2).collect()] == ["m5", "m3"]
    assert list_indexed(stored, "L1").count() == 3 and list_indexed(stored, "L1", 0).count() == 0
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label_id" in plan


def test_responses(spark, tmp_path):
    folder = write(tmp_path, llm_responses__json={"a": SUMMARY, "b": 5}, list__json="[1]",
                   broken__json="{")
    rows = {r.message_id: r.answer for r in read_response_object(
        spark, f"{folder}/llm_responses.json").collect()}
    assert json.loads(rows["a"]) == SUMMARY and rows["b"] == "5"
    for name, reason in (("list", "expected a top-level JSON object"), ("broken", "invalid JSON")):
        with pytest.raises(Exception, match=rf"{name}\.json: {reason}"):
            read_response_object(spark, f"{folder}/{name}.json").collect()
    lines = tmp_path / "r.jsonl"
    lines.write_text(json.dumps({"message_id": "a", "answer": SUMMARY}) + "\n")
    answers = read_response_lines(spark, str(lines))
    assert json.loads(answers.first().answer) == SUMMARY
    answers.write.parquet(str(tmp_path / "table"))
    assert read_response_table(spark, str(tmp_path / "table")).count() == 1


RECORD = {"source_message_id": "m1", "subject": "s", "summary": SUMMARY, "model": "m",
          "tokens_prompt": 5, "tokens_completion": None, "created_at": "2026-01-01T10:00:00+02:00"}


def capture(spark, tmp_path, *lines):
    path = tmp_path / "out.log"
    path.write_text("\n".join(lines))
    return read_captured_records(spark, str(path))


def test_captured_records_between_banners(spark, tmp_path):
    rows = capture(spark, tmp_path, "+-- banner --+", "", "  " + json.dumps(RECORD), "done {",
                   json.dumps({**RECORD, "source_message_id": "m2"})).orderBy("position").collect()
    assert [r.source_message_id for r in rows] == ["m1", "m2"]
    assert rows[0].summary.key_points == ["k"] and rows[0].tokens_prompt == 5
    assert rows[0].tokens_completion is None and rows[0].created_at == datetime(2026, 1, 1, 8)


def test_captured_defaults(spark, tmp_path):
    row = capture(spark, tmp_path, json.dumps({
        k: RECORD[k] for k in ("source_message_id", "summary", "model")})).first()
    assert row.subject == "" and row.tokens_prompt is None and row.created_at is not None


@pytest.mark.parametrize("change, reason", [
    ("{broken", "malformed"), ({"extra": 1}, "unknown fields: extra"), ({"model": ""}, "model"),
    ({"source_message_id": 5}, "source_message_id"), ({"summary": None}, "not a JSON object"),
    ({"summary": {**SUMMARY, "tl_dr": ""}}, "tl_dr is empty"), ({"tokens_prompt": -1}, "count"),
    ({"tokens_prompt": 1.5}, "count"), ({"created_at": "2026-01-01T00:00:00"}, "zone"),
    ({"subject": None}, "subject")])
def test_malformed_brace_line_fails_loudly(spark, tmp_path, change, reason):
    line = change if isinstance(change, str) else json.dumps({**RECORD, **change})
    with pytest.raises(Exception, match=reason):
        capture(spark, tmp_path, "banner", line).collect()


def test_timings(spark, tmp_path):
    path = tmp_path / "err.log"
    path.write_text(
        "2026 INFO x summary_completed message_id=a tokens_prompt=1 tokens_completion=None "
        "duration_ms=12345\nnoise\nmessage_failed message_id=b stage=summarize\n"
        "INFO summary_completed message_id=c tokens_prompt=None tokens_completion=2 "
        "duration_ms=8000\n")
    assert sorted(map(tuple, read_timings(spark, str(path)).collect())) == [
        ("a", 12345), ("c", 8000)]
