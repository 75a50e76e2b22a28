"""Texts are read whole, checks survive pruning, and sinks leave the rest alone."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from msgpipe.functions import variants as V
from msgpipe.operators.export import export_samples
from msgpipe.operators.respond import MissingResponseError, lookup_responses, require_responses
from msgpipe.sources.captures import records_from_lines
from msgpipe.sources.raw import read_message_lines

GOOD = ('{"a":1}', ' {"a":[1,{"b":"]"}]} ', "[1,2]", '"x"', "7", "null", "{}")
BAD = ('{"a":1}{"b":2}', '{"a":1} x', '{"a":1},', '{"a":1},{"b":2}', "", " ", '{"a":1}]', '1],["',
       "{", '"x', None)


def test_parse_whole(spark):
    rows = spark.createDataFrame([(t,) for t in (*GOOD, *BAD)], "text string").select(
        "text", F.to_json(V.parse_whole(F.col("text"))).alias("value")).collect()
    for row in rows[:len(GOOD)]:
        assert json.loads(row.value) == json.loads(row.text)
    assert [r.text for r in rows[len(GOOD):] if r.value is not None] == []


def test_long_texts_are_read_as_others(spark, monkeypatch):
    """The reader for long texts accepts and refuses what the one for all others does."""
    odd = ("['a']", "[NaN]", "[Infinity]", "[01]", "[+1]", "[.5]", "[1.]", "[1e400]", "[-0]", "{a:1}",
           '{"a":1,"a":2}', '["a\nb"]', '["\\u0000"]', '["\\q"]', "[1//c\n]", "[" + "9" * 50 + "]",
           "[" * 998 + "]" * 998, "[" * 1001 + "]" * 1001, "[9223372036854775808]", "[1.50]")
    texts = spark.createDataFrame([(t,) for t in (*GOOD, *BAD, *odd)], "text string").coalesce(1)

    def read():
        value = V.parse_whole(F.col("text"))
        return texts.select("text", F.to_json(value), F.schema_of_variant(value)).collect()

    short = read()
    monkeypatch.setattr(V, "_LONGEST", -1)
    assert read() == short


def test_record_with_a_text_of_over_20_million_characters(spark):
    size = 20_000_001
    record = F.concat(F.lit('{"source_message_id":"a","model":"m","summary":'
                            '{"tl_dr":"t","category":"c","summary":"'),
                      F.repeat(F.lit("x"), size), F.lit('"}}'))
    lines = spark.range(1).select(record.alias("value"), F.lit("o").alias("origin"),
                                  F.lit(1).alias("position"))
    got = records_from_lines(lines).select("source_message_id", F.length("summary.summary").alias(
        "n")).collect()
    assert [tuple(r) for r in got] == [("a", size)]


def test_strict_checks_are_not_pruned(spark, tmp_path):
    (tmp_path / "m.txt").write_text('{"id":"a"}\n{"id":"b"} trailing\n')
    strict = read_message_lines(spark, str(tmp_path))
    for read in (strict.count, strict.select("origin").collect):
        with pytest.raises(PySparkException, match="invalid JSON"):
            read()
    lines = spark.createDataFrame([("{} {}", "o", 1)], "value string, origin string, position bigint")
    with pytest.raises(PySparkException, match="malformed JSON"):
        records_from_lines(lines).count()


def test_all_missing_ids_come_with_the_error(spark):
    messages = spark.range(1000).select(F.col("id").cast("string").alias("message_id"))
    answers = spark.createDataFrame([("1", "{}")], "message_id string, answer string")
    with pytest.raises(MissingResponseError, match="no answers for 999 message_ids") as raised:
        require_responses(messages, answers)
    assert raised.value.missing.count() == 999


def test_repeated_answers_give_one_row(spark):
    messages = spark.createDataFrame([("a",), ("b",)], "message_id string")
    answers = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)],
                                    "message_id string, answer string, seq int")
    got = {r.message_id: r.answer for r in lookup_responses(messages, answers).collect()}
    assert got == {"a": "new", "b": None} and lookup_responses(messages, answers).count() == 2


def test_export_leaves_other_files(spark, tmp_path):
    from msgpipe.schemas import SUMMARY_RECORD

    target = tmp_path / "samples"
    target.mkdir()
    (target / "README.md").write_text("kept")
    rows = [(f"m{k}", "s", ("t", "s", ["k"], [], "c"), "model", None, None, None) for k in range(3)]
    records = spark.createDataFrame(rows, SUMMARY_RECORD).withColumn(
        "created_at", F.lit("2026-01-01").cast("timestamp"))
    export_samples(records, str(target), ["source_message_id"])
    export_samples(records.where("source_message_id <> 'm2'"), str(target), ["source_message_id"])
    assert (target / "README.md").read_text() == "kept"
    names = sorted(p.name for p in target.iterdir() if p.name.endswith("_sample.json"))
    assert names == ["001_sample.json", "002_sample.json"]
