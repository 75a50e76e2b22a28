"""One query per operator; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions.addresses import addresses
from msgpipe.functions.base64text import decode_base64url
from msgpipe.functions.content import assemble_messages
from msgpipe.functions.dates import epoch_millis, millis_error, millis_to_timestamp
from msgpipe.functions.headers import header_or_empty
from msgpipe.functions.html import html_to_text
from msgpipe.functions.mime import attachment_names, flatten_parts, inline_text
from msgpipe.functions.prompt import render_prompt
from msgpipe.functions.redaction import (
    DEFAULT_RULES,
    EMAIL_RULE,
    RedactionRule,
    redact,
    redact_message,
    redact_record,
)
from msgpipe.functions.text import iso_utc, truncate
from msgpipe.functions.variants import parse
from msgpipe.operators.conversation import (
    conversation_messages,
    conversation_payloads,
    conversation_turns,
)
from msgpipe.operators.export import emit_records, export_samples
from msgpipe.operators.numbering import sample_names
from msgpipe.operators.parse import parse_messages
from msgpipe.operators.records import (
    assemble_records,
    dead_letters_of,
    flatten_records,
    list_columns_as_json,
    record_json,
    records_of,
)
from msgpipe.operators.respond import (
    lookup_responses,
    missing_responses,
    respond_with,
    validate_answers,
)
from msgpipe.operators.firsts import first_per_key
from msgpipe.operators.store import KEY, Store
from msgpipe.operators.timing import slo_breaches, slowest_message, timing_summary
from msgpipe.operators.usage import (
    completion_lines,
    outcome_counts,
    run_totals,
    running_usage,
    token_usage,
    totals_line,
)
from msgpipe.plans.batch import ingest, prepare_messages, run_label_batch
from msgpipe.plans.capture import run_capture
from msgpipe.plans.replay import replay
from msgpipe.schemas import clock
from msgpipe.session import configure, new_staging_path, stage
from msgpipe.sources.archive import Archive
from msgpipe.sources.captures import records_from_lines, timings_from_lines
from msgpipe.sources.listing import label_index, list_messages, message_index, resolve_label
from msgpipe.sources.raw import from_table, get_messages, read_message_lines
from msgpipe.sources.responses import read_large_response_object, read_response_lines
from msgpipe.streaming.ingest import stream_messages, stream_records
from msgpipe.workloads import inputs

RUN_TIME = datetime(2026, 1, 1, tzinfo=UTC)
LINE = "\n"


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def redact_documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", redact(F.col("text")).alias("text"))


#: Stand-ins for rules of a user: numbers of three digits and more, and what came before.
EXTRA_RULES = (RedactionRule(r"[0-9]{3,}", "[number]"), RedactionRule(r"\[number\]-\[number\]", "[range]"))


def redact_rules(spark, sf_dir):
    """The shipped rule and two more, in order, over whole texts."""
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", redact(F.col("text"), (*DEFAULT_RULES, *EXTRA_RULES)).alias("text"))


def redact_hits_by_lang(spark, sf_dir):
    hits = F.regexp_count("text", F.lit(EMAIL_RULE.pattern))
    return inputs.table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(hits.cast("bigint")).alias("addresses"))


def redact_message_fields(spark, sf_dir):
    return redact_message(inputs.messages(spark, sf_dir)).select(
        "message_id", "thread_id", "subject", "sender", _joined("recipients"),
        _joined("labels"), "body_text", "snippet", _joined("attachment_filenames"))


def html_pages(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", html_to_text(F.col("html")).alias("text"))


def html_unfinished(spark, sf_dir):
    """Every page with an end that a reader waiting for more holds back."""
    ends = F.array(*map(F.lit, ("<p>held &am", "<script>var a = '<p>", "<!-- open", "<a b='>",
                                "<style>p{}</styl")))
    page = F.concat("html", F.get(ends, (F.col("page_id") % 5).cast("int")))
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", html_to_text(page).alias("text"))


def header_lookup(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def entry(name, value):
        return F.struct(F.lit(name).cast("string").alias("name"),
                        value.cast("string").alias("value"))

    headers = F.array(
        entry("SUBJECT", F.concat(F.lit("old "), "o_orderpriority")),
        entry("From", F.when(key % 4 != 3, F.concat(F.lit("clerk"), cust, F.lit("@example.com")))),
        entry("subject", F.when(key % 3 != 0, F.col("o_orderpriority"))),
        entry(None, F.lit("stray")), entry("X-Other", cust))
    return inputs.table(spark, sf_dir, "orders").withColumn("headers", headers).select(
        "o_orderkey", *(header_or_empty(F.col("headers"), n).alias(c) for n, c in (
            ("Subject", "subject"), ("from", "sender"), ("To", "recipient"))))


def address_list_plain(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    header = F.concat(
        F.lit('"'), "c_name", F.lit(', Dept" <c'), key, F.lit("@example.com>, desk+"), key,
        F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.org,Room "), key, F.lit(" <r"), key,
        F.lit("@example.net>"))
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(addresses(header), "|").alias("addresses"))


def address_list_odd(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    header = F.concat(
        F.lit("Staff: a"), key, F.lit("@example.com, b"), key,
        F.lit("@example.com;, Cy (night shift) <c"), key, F.lit("@example.com>"))
    plain = F.concat(F.lit("d"), key, F.lit("@example.com"))
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(addresses(F.when(
            F.col("c_custkey") % 2 == 0, header).otherwise(plain)), "|").alias("addresses"))


def epoch_millis_dates(spark, sf_dir):
    event = F.col("event_id")
    text = F.when(event % 10 == 3, F.concat(F.lit("at "), event.cast("string"))).otherwise(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    millis = epoch_millis(F.col("date_text"))
    return inputs.table(spark, sf_dir, "events").withColumn("date_text", text).select(
        "event_id", millis.alias("millis"),
        iso_utc(millis_to_timestamp(millis)).alias("received_at"),
        millis_error(F.col("date_text"), millis).alias("error"))


def base64_body(spark, sf_dir):
    data = inputs.base64url(F.col("text"))
    spoiled = F.concat(data, F.repeat(F.lit("A"), F.pmod(1 - F.length(data), F.lit(4))))
    doc = F.col("doc_id")
    decoded = inputs.table(spark, sf_dir, "documents").withColumn(
        "decoded", decode_base64url(F.when(doc % 9 == 4, spoiled).otherwise(data)))
    return decoded.select("doc_id", "decoded.text", "decoded.error")


def mime_flatten(spark, sf_dir):
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=False))
    parts = raw.select("message_id", flatten_parts(
        F.try_variant_get("payload", "$.payload", "variant")).alias("parts"))
    types = F.transform("parts", lambda p: p["mime_type"])
    return parts.select(
        "message_id", F.size("parts").alias("n_parts"), F.array_join(types, "|").alias("types"),
        F.array_join(attachment_names(F.col("parts")), "|").alias("attachments"),
        *(inline_text(F.col("parts"), f"text/{kind}")["text"].alias(kind)
          for kind in ("plain", "html")))


def parse_raw_messages(spark, sf_dir):
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=True))
    return parse_messages(raw).select(
        "message_id", "thread_id", "subject", "sender", _joined("recipients"), _joined("labels"),
        iso_utc(F.col("received_at")).alias("received_at"), "body_text", "snippet",
        _joined("attachment_filenames"), F.col("err.stage").alias("stage"),
        F.col("err.error").alias("error"))


def label_resolve_list(spark, sf_dir):
    """The five newest messages under a label looked up by name."""
    names = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Source/"), "source").alias("name"), F.col("source").alias("label_id"))
    return list_messages(inputs.messages(spark, sf_dir), resolve_label(names, "Source/src7"), 5)


def label_listing(spark, sf_dir):
    """Every (label, message) pair, as stored for label-partitioned listings."""
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=False))
    return label_index(message_index(raw)).select(
        "label_id", "message_id", F.unix_millis("received_at").alias("millis"))


def fetch_by_ids(spark, sf_dir):
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=False))
    key = F.col("o_orderkey")
    ids = inputs.table(spark, sf_dir, "orders").select(F.when(
        key % 10 != 9, F.concat(F.lit("doc-"), (key * 2).cast("string"))).alias("message_id"))
    return get_messages(raw, ids).select(
        "message_id", F.try_variant_get("payload", "$.threadId", "string").alias("thread_id"),
        F.col("err.stage").alias("stage"), F.col("err.error").alias("error"))


def conversation_payload(spark, sf_dir):
    return conversation_payloads(inputs.table(spark, sf_dir, "conversations")).select(
        "conv_id", "system", "n_turns", "turn_chars")


def conversation_turn_rows(spark, sf_dir):
    return conversation_turns(inputs.table(spark, sf_dir, "conversations"))


def message_list_payload(spark, sf_dir):
    """Message lists held in one value, rebuilt per document."""
    doc, text = F.col("doc_id"), F.col("text")
    lists = F.to_json(F.array(
        F.struct(F.lit("system").alias("role"), F.concat(F.lit("Lang "), "lang").alias("content")),
        F.struct(F.lit(None).cast("string").alias("role"), text.alias("content")),
        F.struct(F.lit("system").alias("role"),
                 F.concat(F.lit("Src "), "source").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"))))
    blocks = F.to_json(F.array(F.struct(
        F.lit("user").alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text")),
                F.struct(F.lit("image").alias("type"), F.lit("ignored").alias("text")),
                F.struct(F.lit("text").alias("type"), F.col("source").alias("text")))
        .alias("content"))))
    bare = F.to_json(F.array("text"))
    value = F.when(doc % 3 == 0, parse(lists)).when(
        doc % 3 == 1, parse(blocks)).otherwise(
        F.try_variant_get(parse(bare), "$[0]", "variant"))
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", assemble_messages(value).alias("m")).select(
        "doc_id", "m.system",
        F.array_join(F.transform("m.turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])),
                     LINE).alias("turns"))


def prompt_render(spark, sf_dir):
    messages = redact_message(inputs.messages(spark, sf_dir))
    prompt = render_prompt(F.col("subject"), F.col("sender"), F.col("body_text"))
    return messages.select("message_id", prompt.alias("prompt"))


def _with_no_error(df: DataFrame) -> DataFrame:
    return df.withColumn("err", F.lit(None).cast(
        "struct<stage:string,error:string,traceback:string>"))


def respond_lookup(spark, sf_dir):
    asked = inputs.table(spark, sf_dir, "documents").select(inputs.message_id())
    answered = validate_answers(lookup_responses(asked, inputs.labelled_answers(spark, sf_dir)))
    return answered.select(
        "message_id", F.col("summary.tl_dr").alias("tl_dr"),
        F.col("summary.category").alias("category"),
        F.size("summary.key_points").alias("n_key_points"),
        F.col("err.stage").alias("stage"))


def respond_callable(spark, sf_dir):
    """Answers computed by a callable, failures and empty replies included."""
    messages = redact_message(inputs.messages(spark, sf_dir)).withColumn(
        "prompt", render_prompt(F.col("subject"), F.col("sender"), F.col("body_text")))
    answered = validate_answers(respond_with(messages, make_stub_responder()))
    return answered.select(
        "message_id", F.col("summary.summary").alias("summary"), "tokens_prompt",
        "tokens_completion", F.col("err.error").alias("error"))


def missing_answers(spark, sf_dir):
    asked = inputs.table(spark, sf_dir, "documents").select(inputs.message_id())
    return missing_responses(asked, inputs.labelled_answers(spark, sf_dir))


def _validated(spark, sf_dir):
    return validate_answers(_with_no_error(inputs.defective_answers(spark, sf_dir)))


def validate_summary(spark, sf_dir):
    checked = _validated(spark, sf_dir)
    reason = F.regexp_extract("err.error", r"(?s)^no valid summary: (.*?); raw_output=", 1)
    quoted = F.length(F.regexp_extract("err.error", r"(?s)raw_output='(.*)'\z", 1))
    return checked.select(
        "message_id", F.col("summary.tl_dr").alias("tl_dr"),
        F.array_join("summary.key_points", "|").alias("key_points"),
        F.size("summary.action_items").alias("n_action_items"),
        F.col("err.stage").alias("stage"), reason.alias("reason"),
        (quoted <= 203).alias("quote_is_short"))


def truncate_text(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", truncate(F.col("text"), 200).alias("quoted"))


def _records(spark, sf_dir):
    return assemble_records(_validated(spark, sf_dir), inputs.MODEL, clock(RUN_TIME))


def record_assemble(spark, sf_dir):
    return list_columns_as_json(flatten_records(records_of(_records(spark, sf_dir))))


def dead_letter_rows(spark, sf_dir):
    letters = dead_letters_of(_records(spark, sf_dir), clock(RUN_TIME))
    return letters.select(
        "source_message_id", "stage",
        F.regexp_extract("error", "(?s)^(.*?); raw_output=", 1).alias("error"), "traceback",
        iso_utc(F.col("failed_at")).alias("failed_at"))


def dead_letter_split(spark, sf_dir):
    """Outcome counts of the full chain on messages with broken dates and answers."""
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=True))
    parsed = parse_messages(raw).select("message_id", "subject", "err")
    answers = inputs.defective_answers(spark, sf_dir).select("message_id", "answer")
    answered = validate_answers(lookup_responses(parsed, answers))
    return outcome_counts(assemble_records(answered, inputs.MODEL, clock(RUN_TIME)))


_ORDER_COLUMNS = (KEY, "subject", "tl_dr", "summary", "category", "tokens_prompt")


def insert_or_ignore(spark, sf_dir):
    """Delivery 1 into a store, then delivery 2: the rows of the store afterwards."""
    store = Store(spark, new_staging_path(spark, "store")).create()
    records = inputs.order_records(spark, sf_dir)
    for number in (1, 2):
        store.append_records(records.filter(F.col("delivery") == number), ["delivery"])
    return store.records().select(*_ORDER_COLUMNS)


def indexed_append(spark, sf_dir):
    """Orders in both deliveries, in a store whose key index has to grow on the way."""
    store = Store(spark, new_staging_path(spark, "store")).create(buckets=1, bucket_keys=8000)
    records = inputs.order_records(spark, sf_dir)
    for number in (1, 2):
        store.append_records(flatten_records(records.filter(F.col("delivery") == number)), [KEY])
    held = store.index.keys().select(F.col("key").alias(KEY))
    return store.records().join(held, KEY).select(*_ORDER_COLUMNS)


def _store_rows(store):
    records = store.records().select(
        F.lit("record").alias("kind"), F.col(KEY).alias("message_id"),
        F.lit(None).cast("string").alias("stage"), F.col("summary").alias("content"))
    letters = store.dead_letters().select(F.lit("dead letter"), KEY, "stage", "error")
    return records.union(letters)


def _document_records(spark, sf_dir):
    doc = F.col("doc_id")
    return inputs.table(spark, sf_dir, "documents").select(
        doc, inputs.message_id().alias(KEY), F.lit("s").alias("subject"),
        F.struct(F.lit("t").alias("tl_dr"), F.concat(F.lit("text: "), "text").alias("summary"),
                 F.array("lang").alias("key_points"), F.array("source").alias("action_items"),
                 F.lit("c").alias("category")).alias("summary"),
        F.lit(inputs.MODEL).alias("model"), doc.alias("tokens_prompt"),
        doc.alias("tokens_completion"), clock(RUN_TIME).alias("created_at"))


def persist_isolated(spark, sf_dir):
    """Records of which some make the write fail: those become dead letters, all others rows."""
    records = _document_records(spark, sf_dir)

    def spoiled(rows):
        return rows.withColumn("subject", F.when(
            F.col("doc_id") % 331 == 7, F.raise_error(F.concat(F.lit("cannot write "), KEY)))
            .otherwise(F.col("subject")))

    store = Store(spark, new_staging_path(spark, "store")).create()
    store.append_records(records, ["doc_id"], clock(RUN_TIME), spoiled)
    return _store_rows(store)


def append_invalid(spark, sf_dir):
    """Records of which some break a constraint, appended twice."""
    doc = F.col("doc_id")
    records = _document_records(spark, sf_dir).withColumns({
        KEY: F.when(doc % 17 != 3, F.col(KEY)),
        "tokens_prompt": F.when(doc % 19 == 4, -doc).otherwise(doc),
        "model": F.when(doc % 23 == 5, F.lit("")).otherwise(F.col("model"))})
    store = Store(spark, new_staging_path(spark, "store")).create()
    for _ in range(2):
        store.append_records(records, ["doc_id"], clock(RUN_TIME))
    return _store_rows(store)


class _LostOnce(Store):
    """A store whose driver is lost once, when a batch is written but not in the ledger."""

    def commit(self, *args, **options):
        if not _LostOnce.lost:
            _LostOnce.lost = True
            raise RuntimeError("the driver is lost")
        return super().commit(*args, **options)


def stream_replay(spark, sf_dir):
    """A stream of raw messages whose first batch is lost after its records and dead letters
    were written, started again: each is in the store once."""
    feed, progress = new_staging_path(spark, "feed"), new_staging_path(spark, "progress")
    raw = inputs.raw_json(spark, sf_dir, broken=True)
    raw.write.parquet(feed)
    answers = inputs.prepared_answers(spark, sf_dir)
    path = new_staging_path(spark, "store")
    _LostOnce.lost = False
    for _ in range(2):
        stream = from_table(spark.readStream.schema(raw.schema).parquet(feed))
        query = stream_messages(stream, _LostOnce(spark, path), inputs.MODEL, progress,
                                available_now=True, now=RUN_TIME, responses=answers)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    return _store_rows(Store(spark, path))


def fetch_by_ids_versions(spark, sf_dir):
    """Requests against two versions of every message, some of them unreadable."""
    raw = inputs.raw_json(spark, sf_dir, broken=False)
    later = raw.select("message_id", F.lit('{"id": "later"}').alias("payload"))
    number = F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint")
    first = raw.withColumn("payload", F.when(number % 6 == 1, F.lit("{broken")).otherwise(
        F.col("payload")))
    parsed = from_table(first).withColumn("seq", F.lit(1)).unionByName(
        from_table(later).withColumn("seq", F.lit(2)))
    ids = inputs.table(spark, sf_dir, "pages").select(inputs.page_message_id()).unionByName(
        inputs.table(spark, sf_dir, "labels").select(inputs.message_id())).unionByName(
        inputs.table(spark, sf_dir, "labels").select(inputs.message_id()))
    body = decode_base64url(F.coalesce(
        F.try_variant_get("payload", "$.payload.body.data", "string"),
        F.try_variant_get("payload", "$.payload.parts[0].body.data", "string"), F.lit("")))
    return get_messages(parsed, ids, order=["seq"]).select(
        "message_id", "seq", F.col("err.error").alias("error"),
        F.when(F.col("err").isNull(), F.sha2(body["text"], 256)).alias("body_sha256"))


def run_label_batch_order(spark, sf_dir):
    """The newest messages of a label, from a table with two versions and from an archive."""
    # Archive, listing and fetch read it five times in all, so it is written once.
    feed = stage(inputs.raw_json(spark, sf_dir, broken=False), "feed")
    raw = from_table(feed).withColumn("seq", F.lit(1))
    both = raw.unionByName(raw.withColumn("seq", F.lit(2)))
    labels = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Source/"), "source").alias("name"), F.col("source").alias("label_id"))
    answers = inputs.prepared_answers(spark, sf_dir)
    archive = Archive(spark, new_staging_path(spark, "archive")).create()
    archive.append(raw)
    found = None
    for kind, held, options in (("table", both, {"order": ["seq"]}), ("archive", archive, {})):
        store = Store(spark, new_staging_path(spark, "store"))
        run_label_batch(held, labels, "Source/src7", store, inputs.MODEL, limit=7, now=RUN_TIME,
                        responses=answers, **options)
        rows = store.records().select(F.lit(kind).alias("kind"), KEY, "summary")
        found = rows if found is None else found.unionByName(rows)
    return found


def export_and_emit_readback(spark, sf_dir):
    """Order records emitted as JSON lines, customer records as numbered samples, read back."""
    emitted, samples = new_staging_path(spark, "emitted"), new_staging_path(spark, "samples")
    records = inputs.order_records(spark, sf_dir).filter("delivery = 1")
    emit_records(records, emitted)
    few = _nation_records(spark, sf_dir)
    for _ in range(2):
        export_samples(few, samples, [KEY])
    lines = spark.read.text(emitted).select(
        F.lit("line").alias("kind"), F.lit(None).cast("string").alias("name"), "value")
    files = spark.read.text(samples, wholetext=True).select(
        F.lit("sample"), F.col("_metadata.file_name"), "value")
    value = parse(F.col("value"))
    return lines.union(files).select(
        "kind", "name", F.try_variant_get(value, f"$.{KEY}", "string").alias(KEY),
        F.try_variant_get(value, "$.subject", "string").alias("subject"),
        F.try_variant_get(value, "$.summary.summary", "string").alias("summary"))


def _nation_records(spark, sf_dir):
    return inputs.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.lpad("n_nationkey", 2, "0")).alias(KEY),
        F.col("n_name").alias("subject"),
        F.struct(F.col("n_name").alias("tl_dr"), F.col("n_name").alias("summary"),
                 F.array("n_name").alias("key_points"), F.array().cast("array<string>")
                 .alias("action_items"), F.lit("nation").alias("category")).alias("summary"),
        F.lit(inputs.MODEL).alias("model"), F.lit(1).cast("bigint").alias("tokens_prompt"),
        F.lit(None).cast("bigint").alias("tokens_completion"),
        clock(RUN_TIME).alias("created_at"))


def raw_lines_scan(spark, sf_dir):
    """Raw resources written as lines, some of them cut short, and read leniently."""
    path = new_staging_path(spark, "lines")
    number = F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint")
    inputs.raw_json(spark, sf_dir, broken=False).select(F.when(
        number % 6 == 1, F.concat(F.lit("{"), "message_id")).otherwise(F.col("payload"))
        .alias("value")).write.text(path)
    body = decode_base64url(F.try_variant_get("payload", "$.payload.body.data", "string"))
    return read_message_lines(spark, path, strict=False).select(
        "message_id", F.try_variant_get("payload", "$.threadId", "string").alias("thread_id"),
        F.sha2(body["text"], 256).alias("body_sha256"), F.col("err.stage").alias("stage"),
        F.regexp_extract("err.error", ": ([^:]*)$", 1).alias("error"))


def response_lines_scan(spark, sf_dir):
    """Prepared answers written as lines and read back."""
    path = new_staging_path(spark, "answers")
    answers = inputs.prepared_answers(spark, sf_dir)
    answers.select(F.concat(
        F.lit('{"message_id": "'), "message_id", F.lit('", "answer": '), "answer", F.lit("}"))
        .alias("value")).write.text(path)
    return read_response_lines(spark, path).select("message_id", *(
        F.get_json_object("answer", f"$.{n}").alias(n) for n in ("tl_dr", "summary", "category")))


def capture_job(spark, sf_dir):
    """Captured output of a run and its log: outcome, samples, timings and breaches."""
    stdout, stderr = new_staging_path(spark, "stdout"), new_staging_path(spark, "stderr")
    samples = new_staging_path(spark, "samples")
    lines = record_json(_nation_records(spark, sf_dir)).unionByName(
        spark.range(1).select(F.lit("+-- done --+").alias("value")))
    lines.write.text(stdout)
    inputs.log_lines(spark, sf_dir).write.text(stderr)
    result = run_capture(spark, stdout, samples, stderr)
    return result.timing.select(
        F.lit(result.outcome.name).alias("outcome"),
        F.lit(result.records.count()).cast("bigint").alias("records"),
        F.lit(spark.read.text(samples, wholetext=True).count()).cast("bigint").alias("samples"),
        F.lit(result.breaches.count()).cast("bigint").alias("breaches"),
        "messages", "total_ms", "slowest_ms")


def conversation_message_rows(spark, sf_dir):
    """Every turn a model is sent, with the conversation's system text."""
    return conversation_messages(inputs.table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "text", "system")


def large_response_object(spark, sf_dir):
    """The labelled documents' answers as one JSON object in one file, read in splits."""
    path = new_staging_path(spark, "answers")
    key = F.to_json(F.array("message_id"))
    member = F.concat(F.lit(","), F.substr(key, F.lit(2), F.length(key) - 2), F.lit(": "), "answer")

    def line(text: str) -> DataFrame:
        return spark.range(1).select(F.lit(text).alias("value"))

    (line('{"first": {"tl_dr": "t"}').unionByName(
        inputs.labelled_answers(spark, sf_dir).select(member.alias("value")))
     .unionByName(line("}")).coalesce(1).write.text(path))
    return read_large_response_object(spark, path).select(
        "message_id", *(F.get_json_object("answer", f"$.{n}").alias(n)
                        for n in ("tl_dr", "summary", "category")))


def first_version(spark, sf_dir):
    """Both deliveries as one batch: the first version of every order."""
    return first_per_key(inputs.order_records(spark, sf_dir), KEY, ["delivery"]).select(
        KEY, "subject", "delivery")


def stream_ingest(spark, sf_dir):
    """Delivery 1 into a feed and through the stream, then delivery 2 after a restart."""
    feed, progress = new_staging_path(spark, "feed"), new_staging_path(spark, "progress")
    records = inputs.order_records(spark, sf_dir)
    store = Store(spark, new_staging_path(spark, "store"))
    for number in (1, 2):
        records.filter(F.col("delivery") == number).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(records.schema).parquet(feed)
        stream_records(stream, store, progress, order=["delivery"],
                       available_now=True).awaitTermination()
    return store.records().select(KEY, "subject", "tl_dr", "summary", "category", "tokens_prompt")


def batch_store(spark, sf_dir):
    """The batch job run twice over one feed: what the store holds afterwards."""
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=True))
    answers = inputs.prepared_answers(spark, sf_dir)
    store = Store(spark, new_staging_path(spark, "store"))
    for _ in range(2):
        result = ingest(raw, store, inputs.MODEL, now=RUN_TIME, responses=answers,
                        keep=["prompt"])
    records = store.records().select(
        F.lit("record").alias("kind"), F.col(KEY).alias("message_id"), "subject",
        F.col("summary").alias("content"))
    letters = store.dead_letters().select(
        F.lit("dead letter"), KEY, F.lit(None), "error")
    prompts = result.outcomes.where("err is null").select(
        F.lit("prompt"), KEY, F.lit(None), F.sha2("prompt", 256))
    return records.union(letters).union(prompts)


def token_usage_totals(spark, sf_dir):
    return token_usage(inputs.calls(spark, sf_dir))


def token_running(spark, sf_dir):
    tie = ["l_partkey", "l_suppkey", "l_extendedprice"]
    return running_usage(inputs.calls(spark, sf_dir), tie_break=tie).select(
        "message_id", "step", "l_partkey", "l_suppkey", "tokens_prompt", "tokens_completion")


def run_totals_row(spark, sf_dir):
    usage = token_usage(inputs.calls(spark, sf_dir))
    return run_totals(usage, dead_letters=3, dropped=1)


def run_totals_line(spark, sf_dir):
    return totals_line(run_totals_row(spark, sf_dir))


def completion_log(spark, sf_dir):
    usage = token_usage(inputs.calls(spark, sf_dir)).select(
        F.col("message_id").alias("source_message_id"), "tokens_prompt", "tokens_completion",
        F.length("message_id").alias("duration_ms"))
    return completion_lines(usage)


def timing_log(spark, sf_dir):
    return timings_from_lines(inputs.log_lines(spark, sf_dir))


def timing_totals(spark, sf_dir):
    return timing_summary(timing_log(spark, sf_dir))


def slowest(spark, sf_dir):
    return slowest_message(timing_log(spark, sf_dir))


def slo_breach_rows(spark, sf_dir):
    return slo_breaches(timing_log(spark, sf_dir))


def stdout_records(spark, sf_dir):
    return list_columns_as_json(flatten_records(
        records_from_lines(inputs.capture_lines(spark, sf_dir))))


def redact_record_fields(spark, sf_dir):
    records = records_from_lines(inputs.capture_lines(spark, sf_dir))
    flat = list_columns_as_json(flatten_records(redact_record(records)))
    return flat.drop("model", "created_at")


def sample_file_names(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sample_names(docs, ["lang", "n_chars", "doc_id"]).select("doc_id", "sample_name")


def offline_replay(spark, sf_dir):
    """The whole chain on clean messages with prepared answers."""
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=False))
    records = replay(raw, inputs.prepared_answers(spark, sf_dir), inputs.MODEL, order=(),
                     keep=["prompt"])
    return list_columns_as_json(flatten_records(records, ["prompt"])).withColumn(
        "prompt", F.sha2("prompt", 256))


def flagship(spark, sf_dir):
    """Raw messages to records and dead letters in one table."""
    raw = from_table(inputs.raw_json(spark, sf_dir, broken=True))
    ready = prepare_messages(raw).select("message_id", "subject", "prompt", "err")
    answered = validate_answers(lookup_responses(ready, inputs.prepared_answers(spark, sf_dir)))
    out = assemble_records(answered, inputs.MODEL, clock(RUN_TIME), keep=["prompt"])
    return out.select(
        "source_message_id", "subject", F.length("prompt").cast("bigint").alias("prompt_chars"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.col("summary.tl_dr").alias("tl_dr"), F.col("summary.category").alias("category"),
        F.col("err.stage").alias("stage"), F.col("err.error").alias("error"))


def make_stub_responder():
    """A factory whose code travels with the plan, so workers need not have this package."""
    from dataclasses import make_dataclass

    reply_type = make_dataclass("StubReply", ["content", "usage", "stop_reason"])

    def make():
        import json

        def respond(prompt, system):
            subject = prompt.split("\nFrom: ")[0].rsplit("Subject: ", 1)[1]
            number = subject.split(" ")[1]
            if number.endswith("7"):
                raise TimeoutError(f"no answer in time for {number}")
            if number.endswith("8"):
                return reply_type([{"type": "tool_use"}], [(10, None)], "max_tokens")
            answer = {"tl_dr": subject, "summary": f"{len(prompt)} characters",
                      "category": "stub"}
            return reply_type([{"type": "text", "text": json.dumps(answer)}],
                              [(int(number), None), (1, 2)], "end_turn")

        return respond

    return make


QUERIES = {
    "redact_documents": redact_documents,
    "redact_rules": redact_rules,
    "raw_lines_scan": raw_lines_scan,
    "response_lines_scan": response_lines_scan,
    "capture_job": capture_job,
    "redact_hits_by_lang": redact_hits_by_lang,
    "redact_message": redact_message_fields,
    "html_to_text": html_pages,
    "html_to_text_exact": html_unfinished,
    "header_lookup": header_lookup,
    "address_list": address_list_plain,
    "address_list_exact": address_list_odd,
    "epoch_millis": epoch_millis_dates,
    "base64_body": base64_body,
    "mime_flatten": mime_flatten,
    "parse_messages": parse_raw_messages,
    "label_resolve_list": label_resolve_list,
    "label_index": label_listing,
    "fetch_by_ids": fetch_by_ids,
    "conversation_payload": conversation_payload,
    "conversation_turns": conversation_turn_rows,
    "message_list_payload": message_list_payload,
    "prompt_render": prompt_render,
    "respond_lookup": respond_lookup,
    "respond_callable": respond_callable,
    "missing_responses": missing_answers,
    "validate_summary": validate_summary,
    "truncate_text": truncate_text,
    "record_assemble": record_assemble,
    "dead_letter_rows": dead_letter_rows,
    "dead_letter_split": dead_letter_split,
    "insert_or_ignore": insert_or_ignore,
    "indexed_append": indexed_append,
    "persist_isolated": persist_isolated,
    "append_invalid": append_invalid,
    "stream_replay": stream_replay,
    "fetch_by_ids_versions": fetch_by_ids_versions,
    "run_label_batch_order": run_label_batch_order,
    "export_and_emit_readback": export_and_emit_readback,
    "conversation_messages": conversation_message_rows,
    "large_response_object": large_response_object,
    "first_version": first_version,
    "stream_ingest": stream_ingest,
    "batch_store": batch_store,
    "token_usage": token_usage_totals,
    "token_running": token_running,
    "run_totals": run_totals_row,
    "run_totals_line": run_totals_line,
    "completion_log": completion_log,
    "timing_log": timing_log,
    "timing_summary": timing_totals,
    "slowest_message": slowest,
    "slo_breaches": slo_breach_rows,
    "stdout_records": stdout_records,
    "redact_record": redact_record_fields,
    "sample_names": sample_file_names,
    "offline_replay": offline_replay,
    "records_and_dead_letters": flagship,
}


def configured(query):
    """The query with the session settings all jobs assume."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run
