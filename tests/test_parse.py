from datetime import UTC, datetime

import pytest
from builders import HEADERS, encode, part, raw_frame, resource
from pyspark.sql import functions as F

from msgpipe.operators.parse import parse_messages


def parse(spark, *resources, **kw):
    rows = parse_messages(raw_frame(spark, resources), **kw).collect()
    return rows[0] if len(resources) == 1 else rows


def test_plain_message(spark):
    row = parse(spark, resource(part("text/plain", "Hello, world!"), headers=HEADERS,
                                threadId="t1", labelIds=["INBOX", "L1"], snippet="Hello"))
    assert row.err is None
    assert row.message_id == "m1" and row.thread_id == "t1" and row.snippet == "Hello"
    assert row.subject == "Hello" and row.sender == "Alice <alice@example.com>"
    assert row.recipients == ["bob@example.com", "carol@example.com"]
    assert row.labels == ["INBOX", "L1"]
    assert row.received_at == datetime.fromtimestamp(1700000000, UTC).replace(tzinfo=None)
    assert row.body_text == "Hello, world!" and row.attachment_filenames == []


def test_plain_wins_over_html(spark):
    row = parse(spark, resource(part("multipart/alternative", parts=[
        part("text/plain", "plain"), part("text/html", "<p>html</p>")])))
    assert row.body_text == "plain"


def test_html_only(spark):
    row = parse(spark, resource(part(
        "text/html", "<p>Hello <b>bold</b></p><p>Second &amp; last</p>")))
    assert row.body_text == "Hello bold\nSecond & last"


def test_attachment_is_listed_not_read(spark):
    row = parse(spark, resource(part("multipart/mixed", parts=[
        part("text/plain", "see file"),
        part("text/plain", "not the body", filename="notes.txt"),
        part("application/pdf", filename="report.pdf")])))
    assert row.body_text == "see file"
    assert row.attachment_filenames == ["notes.txt", "report.pdf"]


def test_nested_parts_in_preorder(spark):
    row = parse(spark, resource(part("multipart/mixed", filename="root.eml", parts=[
        part("multipart/related", parts=[
            part("multipart/alternative", parts=[
                part("text/plain", "one"), part("text/html", "<p>no</p>")]),
            part("image/png", filename="pic.png")]),
        part("text/plain", "two")])))
    assert row.body_text == "one\ntwo"
    assert row.attachment_filenames == ["root.eml", "pic.png"]


def test_any_depth_is_read_whole(spark):
    depths = [1, 3, 4, 5, 40, 300]
    trees = []
    for depth in depths:
        tree = part("text/plain", f"level {depth}")
        for level in range(depth, 0, -1):
            tree = part("text/plain", f"level {level - 1}", parts=[tree])
        trees.append(resource(tree, f"d{depth}"))
    for depth, row in zip(depths, parse(spark, *trees)):
        assert row.err is None
        assert row.body_text.split("\n") == [f"level {i}" for i in range(depth + 1)]


def test_absent_headers_thread_and_snippet(spark):
    row = parse(spark, resource(part("text/plain", "x")))
    assert (row.subject, row.sender, row.recipients) == ("", "", [])
    assert row.thread_id is None and row.snippet is None and row.labels == []


def test_header_names_in_any_case_last_wins(spark):
    row = parse(spark, resource(part("text/plain", "x"), headers=[
        ("SUBJECT", "first"), ("from", "a@x.org"), ("tO", "b@x.org"), ("subject", "last")]))
    assert (row.subject, row.sender, row.recipients) == ("last", "a@x.org", ["b@x.org"])


def test_header_entries_without_name_or_value_are_skipped(spark):
    message = resource(part("text/plain", "x"))
    message["payload"]["headers"] = [{"name": "Subject", "value": "ok"}, {"name": "Subject"},
                                     {"value": "stray"}]
    assert parse(spark, message).subject == "ok"


def test_null_payload_parts_and_body_are_fine(spark):
    rows = parse(
        spark, {"id": "a", "internalDate": "0", "payload": None}, {"id": "b", "internalDate": "0"},
        resource({"mimeType": "text/plain", "body": None, "parts": None}, "c"))
    assert all(r.err is None and r.body_text == "" for r in rows)


def test_padding_and_invalid_utf8(spark):
    row = parse(spark, resource(part("text/plain", data=encode("no pad", pad=False))))
    assert row.body_text == "no pad"
    row = parse(spark, resource(part("text/plain", data="Yf9i")))
    assert row.body_text == "a�b"


BAD_MESSAGES = [
    ({"id": "m1", "payload": {}}, "internalDate is missing"),
    (resource({}, date="not-a-numeric-timestamp"), "not-a-numeric-timestamp"),
    (resource({}, date="1.5"), "not an integer"),
    (resource({}, date=None), "not an integer"),
    (resource({}, date="99999999999999999"), "out of range"),
    ({"internalDate": "0", "payload": {}}, "id is missing"),
    (resource({}, message_id=""), "id is not"),
    (resource({}, message_id=5), "id is not"),
    (resource({"headers": None}), "headers is not a list"),
    (resource({"headers": [{"name": "Subject", "value": 5}]}), "header value"),
    (resource({"headers": ["x"]}), "malformed entry"),
    (resource({}, labelIds=None), "labelIds is null"),
    (resource({}, labelIds=[1]), "labelIds is not a list"),
    (resource({}, threadId=5), "threadId"),
    (resource({}, snippet=5), "snippet"),
    (resource({"parts": [None]}), "part is not an object"),
    (resource({"parts": {"a": 1}}), "parts is not a list"),
    (resource({"filename": 7}), "filename"),
    (resource({"mimeType": "text/plain", "body": {"data": 7}}), "body data is not text"),
    (resource({"mimeType": "text/plain", "body": "x"}), "body is not an object"),
    (resource(part("text/plain", data="SGkxS")), "base64 padding"),
    (resource(part("text/plain", data="é")), "non-ASCII"),
    ("[1]", "not a JSON object"),
]


def test_bad_messages_carry_a_parse_error(spark):
    rows = parse(spark, *(message for message, _ in BAD_MESSAGES))
    for row, (message, text) in zip(rows, BAD_MESSAGES):
        assert row.err is not None, message
        assert row.err.stage == "parse" and text in row.err.error, (message, row.err)
        assert row.body_text is None


def test_unreadable_json_is_a_read_error(spark):
    row = parse(spark, "{broken")
    assert row.err.stage == "read"


def test_date_as_json_number(spark):
    rows = parse_messages(raw_frame(spark, [resource({}, date=1700000000000)])).select(
        F.unix_millis("received_at")).collect()
    assert rows[0][0] == 1700000000000


def test_broken_html_part_does_not_matter_next_to_plain_text(spark):
    row = parse(spark, resource(part("multipart/alternative", parts=[
        part("text/plain", "fine"), part("text/html", data="SGkxS")])))
    assert row.err is None and row.body_text == "fine"


def test_bad_rows_do_not_disturb_good_ones(spark):
    rows = parse(spark, resource(part("text/plain", "a"), "a"), resource({}, "b", date="x"),
                 resource(part("text/html", "<p>c"), "c"))
    assert [(r.message_id, r.err is None) for r in rows] == [("a", True), ("b", False), ("c", True)]
