"""Small raw messages for the tests."""

import base64
import json


def encode(text, pad=True):
    data = base64.urlsafe_b64encode(text.encode()).decode()
    return data if pad else data.rstrip("=")


def part(mime, text=None, *, filename=None, parts=None, data=None):
    out = {"mimeType": mime}
    if filename is not None:
        out["filename"] = filename
    if text is not None or data is not None:
        out["body"] = {"data": data if data is not None else encode(text)}
    if parts is not None:
        out["parts"] = parts
    return out


def resource(payload, message_id="m1", date="1700000000000", headers=None, **extra):
    payload = dict(payload)
    if headers is not None:
        payload["headers"] = [{"name": n, "value": v} for n, v in headers]
    return {"id": message_id, "internalDate": date, "payload": payload, **extra}


HEADERS = [("From", "Alice <alice@example.com>"), ("To", "bob@example.com, carol@example.com"),
           ("Subject", "Hello")]


def raw_frame(spark, resources):
    from msgpipe.sources.raw import from_table

    rows = [(r.get("id") if isinstance(r, dict) else None,
             r if isinstance(r, str) else json.dumps(r)) for r in resources]
    return from_table(spark.createDataFrame(rows, "message_id string, payload string"))


SUMMARY = {"tl_dr": "t", "summary": "s", "key_points": ["k"], "action_items": [],
           "category": "c"}
