"""Message-shaped inputs derived from the tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions.dates import millis_to_timestamp
from msgpipe.functions.text import iso_utc

BASE_MILLIS = 1_700_000_000_000
MODEL = "demo-offline"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(column: str, n: int, rest: int) -> Column:
    return (F.col(column) % n) == rest


def _text(*pieces: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


def message_id() -> Column:
    return _text("doc-", F.col("doc_id")).alias("message_id")


def _subject() -> Column:
    return _text("Report ", F.col("doc_id"), " for ", F.col("lang"), " via ",
                 F.col("source"), "@lists.example.org")


def _sender() -> Column:
    return _text("Desk ", F.col("source"), " <", F.col("source"), "@mail.example.net>")


def _snippet() -> Column:
    return F.when(~_every("doc_id", 5, 0), _text("from ", F.col("source"), "@mail.example.net"))


def _millis() -> Column:
    return F.lit(BASE_MILLIS) + F.col("doc_id") * 60_000


def _thread() -> Column:
    return F.when(~_every("doc_id", 4, 3), _text("thread-", F.expr("doc_id div 4")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed messages."""
    return table(spark, sf_dir, "documents").select(
        message_id(), _thread().alias("thread_id"), _subject().alias("subject"),
        _sender().alias("sender"),
        F.array(_text("team-", F.col("lang"), "@example.com"),
                _text("ops+", F.col("source"), "@example.com")).alias("recipients"),
        F.array(F.lit("INBOX"), F.col("source")).alias("labels"),
        millis_to_timestamp(_millis()).alias("received_at"),
        F.col("text").alias("body_text"), _snippet().alias("snippet"),
        F.array(_text("invoice-", F.col("source"), "@example.com.pdf"))
        .alias("attachment_filenames"),
    )


def base64url(text: Column) -> Column:
    """Base64url on one line, without padding."""
    data = F.base64(text.cast("binary"))
    for old, new in (("\r\n", ""), ("+", "-"), ("/", "_"), ("=", "")):
        data = F.replace(data, F.lit(old), F.lit(new))
    return data


def _leaf(mime: str, text: Column | None, filename: Column | str | None = None) -> Column:
    name = F.lit(None).cast("string") if filename is None else (
        F.lit(filename) if isinstance(filename, str) else filename)
    data = F.lit(None).cast("string") if text is None else base64url(text)
    return F.struct(F.lit(mime).alias("mimeType"), name.alias("filename"),
                    F.struct(data.alias("data")).alias("body"))


def _multi(mime: str, *parts: Column) -> Column:
    return F.struct(F.lit(mime).alias("mimeType"), F.array(*parts).alias("parts"))


def markup(text: Column) -> Column:
    """A page whose text is ``text``."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return _text("<html><body><div>", text, "</div></body></html>")


def _dated(number: Column, millis: Column, broken: bool) -> Column:
    """Time as text; with ``broken`` some are missing and some unreadable."""
    date = millis.cast("string")
    if not broken:
        return date
    return F.when((number % 13) != 7, F.when(
        (number % 11) == 5, _text("not-a-date-", number)).otherwise(date))


def _headers(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(n.replace("_", "-")).alias("name"), v.alias("value"))
                     for n, v in values.items()))


def raw_json(spark: SparkSession, sf_dir: str, *, broken: bool) -> DataFrame:
    """Documents and pages as raw resources in JSON text, up to three levels deep.

    Every document has its whole text in its body, every page is a message of its own.
    Shapes of documents rotate: flat plain; plain and HTML; the same below a mixed part with
    an attachment; HTML only with an inline image. With ``broken`` some dates are
    unreadable or missing.
    """
    docs = table(spark, sf_dir, "documents")
    headers = _headers(From=_sender(), SUBJECT=F.lit("superseded"), Subject=_subject(), To=_text(
        "Team <team-", F.col("lang"), "@example.com>, ops+", F.col("source"), "@example.com"))
    date = _dated(F.col("doc_id"), _millis(), broken)

    def resource(body: dict[str, Column]) -> Column:
        payload = F.struct(headers.alias("headers"), *(c.alias(n) for n, c in body.items()))
        return F.to_json(F.struct(
            _text("doc-", F.col("doc_id")).alias("id"), _thread().alias("threadId"),
            F.array(F.lit("INBOX"), F.col("source")).alias("labelIds"),
            date.alias("internalDate"), _snippet().alias("snippet"), payload.alias("payload")))

    plain, html = _leaf("text/plain", F.col("text")), _leaf("text/html", markup(F.col("text")))
    pdf = _leaf("application/pdf", None, _text("report-", F.col("doc_id"), ".pdf"))
    several, single = ("mimeType", "parts"), ("mimeType", "filename", "body")
    flat = {"mimeType": F.lit("text/plain"),
            "body": F.struct(base64url(F.col("text")).alias("data"))}
    both = {"mimeType": F.lit("multipart/alternative"), "parts": F.array(plain, html)}
    deep = {"mimeType": F.lit("multipart/mixed"), "parts": F.array(
        _with_parts(_multi("multipart/alternative", plain, html), several),
        _with_parts(pdf, single))}
    page_only = {"mimeType": F.lit("multipart/mixed"), "parts": F.array(
        _with_parts(_multi("multipart/related", html, _leaf("image/png", None, "pic.png")), several))}
    shape = F.col("doc_id") % 4
    documents = docs.select(message_id(), F.when(shape == 0, resource(flat))
                            .when(shape == 1, resource(both)).when(shape == 2, resource(deep))
                            .otherwise(resource(page_only)).alias("payload"))
    return documents.unionByName(_page_json(spark, sf_dir, broken))


def _page_json(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """Pages as flat HTML messages."""
    number = F.col("page_id")
    headers = _headers(From=F.lit("Crawler <crawler@web.example.net>"),
                       Subject=_text("Page ", number), To=F.lit("archive@example.com"))
    date = _dated(number, F.lit(BASE_MILLIS) + number * 60_000 + 30_000, broken)
    payload = F.struct(
        headers.alias("headers"), F.lit("text/html").alias("mimeType"),
        F.struct(base64url(F.col("html")).alias("data")).alias("body"))
    return table(spark, sf_dir, "pages").select(
        page_message_id(), F.to_json(F.struct(
            _text("page-", number).alias("id"), F.array(F.lit("INBOX"), F.lit("web"))
            .alias("labelIds"), date.alias("internalDate"), payload.alias("payload")))
        .alias("payload"))


def page_message_id() -> Column:
    return _text("page-", F.col("page_id")).alias("message_id")


def _with_parts(part: Column, members: tuple[str, ...]) -> Column:
    """A part that has ``members``, with all possible ones, so parts of one list share a type."""
    kinds = {"mimeType": "string", "filename": "string", "body": "struct<data:string>"}
    leaf = ",".join(f"{n}:{kind}" for n, kind in kinds.items())
    kinds["parts"] = f"array<struct<{leaf}>>"
    return F.struct(*((part[n] if n in members else F.lit(None)).cast(kind).alias(n)
                      for n, kind in kinds.items()))


def prepared_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid answer for every document and page."""
    pages = table(spark, sf_dir, "pages").select(page_message_id(), F.to_json(F.struct(
        _text("Page ", F.col("page_id")).alias("tl_dr"), F.col("url").alias("summary"),
        F.lit("page").alias("category"))).alias("answer"))
    return _document_answers(spark, sf_dir).unionByName(pages)


def _document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(message_id(), F.to_json(F.struct(
        _text("Document ", F.col("doc_id"), " by ", F.col("source"), "@example.org")
        .alias("tl_dr"),
        F.col("text").alias("summary"), F.array("lang", "source").alias("key_points"),
        F.array().cast("array<string>").alias("action_items"), F.col("lang").alias("category"),
    )).alias("answer"))


def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for the labelled documents only."""
    return table(spark, sf_dir, "labels").select(message_id(), F.to_json(F.struct(
        _text("quality ", F.col("quality")).alias("tl_dr"),
        _text("toxic ", F.col("toxic")).alias("summary"), F.lit("label").alias("category"),
    )).alias("answer"))


def defective_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per document; six of seven have one defect each, the rest are valid."""
    docs = table(spark, sf_dir, "documents")
    tl_dr = _text("Document ", F.col("doc_id"))
    good = F.struct(tl_dr.alias("tl_dr"), F.col("text").alias("summary"),
                    F.array("lang").alias("key_points"), F.col("lang").alias("category"))
    kind = F.col("doc_id") % 7
    answer = (
        F.when(kind == 0, F.to_json(good))
        .when(kind == 1, F.lit('{"tl_dr": "unfinished'))
        .when(kind == 2, F.to_json(good.dropFields("category")))
        .when(kind == 3, F.to_json(good.withField("tl_dr", F.lit(""))))
        .when(kind == 4, F.to_json(good.withField("extra", F.lit(1))))
        .when(kind == 5, F.to_json(good.withField("category", F.col("doc_id"))))
        .otherwise(F.to_json(good.withField("key_points", F.array("doc_id"))))
    )
    return docs.select(message_id(), _subject().alias("subject"), answer.alias("answer"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model calls: an order is a message, a line a call.

    Calls with tax 0 report no prompt tokens, those with discount 0 no completion.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("message_id"),
        F.col("l_linenumber").alias("step"), "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("bigint")).alias("tokens_prompt"),
        F.when(F.col("l_discount") > 0, F.col("l_partkey")).alias("tokens_completion"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stderr lines; errors are unrelated lines."""
    stamp = iso_utc(F.col("ts"))
    event = F.col("event_id").cast("string")
    done = F.concat(stamp, F.lit(" INFO job summary_completed message_id=evt-"), event,
                    F.lit(" tokens_prompt="), F.col("user_id").cast("string"),
                    F.lit(" tokens_completion=None duration_ms="),
                    F.round(F.col("value") * 100).cast("bigint").cast("string"))
    other = F.concat(stamp, F.lit(" WARNING job message_failed message_id=evt-"), event)
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", other).otherwise(done).alias("value"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a finished record in delivery 1, 2 or both.

    Every third order comes twice, the second time with a changed subject.
    """
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    deliveries = (
        F.when(key % 3 == 0, F.array(F.lit(1), F.lit(2)))
        .when(key % 5 == 4, F.array(F.lit(2))).otherwise(F.array(F.lit(1))))
    orders = table(spark, sf_dir, "orders").withColumn("delivery", F.explode(deliveries))
    return orders.select(
        _text("order-", key).alias("source_message_id"),
        _text("version ", F.col("delivery"), " ", F.col("o_orderpriority")).alias("subject"),
        F.struct(
            _text("status ", status).alias("tl_dr"),
            _text("customer ", F.col("o_custkey")).alias("summary"),
            F.array("o_orderpriority").alias("key_points"),
            F.array().cast("array<string>").alias("action_items"),
            status.alias("category")).alias("summary"),
        F.lit(MODEL).alias("model"), F.col("o_custkey").alias("tokens_prompt"),
        F.lit(None).cast("bigint").alias("tokens_completion"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("created_at"), "delivery")


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured stdout: a banner or blank line, then a record line."""
    docs = table(spark, sf_dir, "documents")
    record = F.to_json(F.struct(
        _text("doc-", F.col("doc_id")).alias("source_message_id"), _subject().alias("subject"),
        F.struct(
            _text("Ask ", F.col("source"), "@example.org").alias("tl_dr"),
            F.col("text").alias("summary"),
            F.array("lang", _text(F.col("source"), "@example.net")).alias("key_points"),
            F.array(_text("mail ", F.col("lang"), "@example.com")).alias("action_items"),
            F.col("lang").alias("category")).alias("summary"),
        F.lit(MODEL).alias("model"), F.col("n_chars").alias("tokens_prompt"),
        F.when(~_every("doc_id", 6, 0), F.col("doc_id")).alias("tokens_completion"),
        F.lit("2026-01-01T00:00:00Z").alias("created_at")), {"ignoreNullFields": "false"})
    banner = F.when(_every("doc_id", 2, 0), F.lit("+-- step done --+")).otherwise(F.lit(""))
    lines = F.posexplode(F.array(banner, F.concat(F.lit("  "), record)))
    return docs.select("doc_id", lines.alias("line", "value")).select(
        "value", F.lit("documents").alias("origin"),
        (F.col("doc_id") * 2 + F.col("line")).alias("position"))
