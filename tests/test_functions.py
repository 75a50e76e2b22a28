"""Column functions against the Python standard library, which they must equal."""

import base64
import re
from email.utils import getaddresses
from html.parser import HTMLParser

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgpipe.functions.addresses import addresses, is_plain_address_header, plain_addresses
from msgpipe.functions.base64text import decode_base64url
from msgpipe.functions.html import BLOCK_TAGS, html_error, html_to_text
from msgpipe.functions.redaction import (
    DEFAULT_RULES,
    RedactionRule,
    redact,
    redact_message,
    redact_record,
)
from msgpipe.functions.text import SPACE_CHARS, strip, truncate

# One Spark job checks many generated values, so hypothesis draws few big lists.
few = settings(max_examples=4, deadline=None, derandomize=True, database=None,
               phases=[Phase.generate],
               suppress_health_check=[HealthCheck.function_scoped_fixture,
                                      HealthCheck.too_slow, HealthCheck.data_too_large])


def values(alphabet, longest):
    piece = st.sampled_from(alphabet)
    return st.lists(st.lists(piece, max_size=longest).map("".join), min_size=50, max_size=300)


def apply(spark, texts, function):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(function(F.col("t"))).collect()]


def test_strip_removes_what_python_strips(spark):
    every = [chr(c) for c in range(0x3100)]
    assert sorted(c for c in every if not c.strip()) == sorted(SPACE_CHARS)
    texts = [f"{c}a {c} b{c}{c}" for c in SPACE_CHARS] + ["", SPACE_CHARS, "a", None]
    assert apply(spark, texts, strip) == [None if t is None else t.strip() for t in texts]


def test_truncate(spark):
    texts = [None, "", "abcde", "abcdefghijk", "ééééééé"]
    assert apply(spark, texts, lambda t: truncate(t, 5)) == [
        None, "", "abcde", "abcde...", "ééééé..."]


def python_decode(data):
    try:
        raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    except ValueError:
        return None
    return raw.decode("utf-8", errors="replace")


@few
@given(texts=values(list("Ab9-_+/=") + ["\n", "\r\n", " ", "!", "é", "4oKs", "8J-Y"], 12))
def test_base64_equals_python(spark, texts):
    got = apply(spark, texts, decode_base64url)
    assert [g.text for g in got] == [python_decode(t) for t in texts]
    assert all((g.error is None) == (g.text is not None) for g in got)


def test_base64_null_and_long(spark):
    long = "日本語 ü\n" * 50_000
    data = base64.urlsafe_b64encode(long.encode()).decode()
    wrapped = base64.encodebytes(long.encode()).decode()
    got = apply(spark, [None, "", data, data.rstrip("="), wrapped], decode_base64url)
    assert got[0] is None
    assert [g.text for g in got[1:]] == ["", long, long, python_decode(wrapped)]


ADDRESS_PIECES = ["a@b.c", "x.y+z@w.org", "Ann", "Bob Lee ", '"Q, R" ', "<k@l.m>", "<", ">", ",",
                  ", ", " ", "(c)", "Team: ", ";", ":", '"', "\\", "@", ".", "ü", "Ann <a@b>"]


def python_addresses(header):
    return [a for _, a in getaddresses([header]) if a] if header else []


_atoms = st.sampled_from(["a", "bob", "x+y", "é", "o'n", "a\\b", "n.m"])
_space = st.sampled_from(["", "", " ", "  ", "\t", "(c)", "(c (d) e)", "(a\\)b)", " (x) "])
_words = st.sampled_from(["Ann", "Bob", "Jr.", '"Lee, C"', '"q\\"d"', '"a\\\\b"', "ö"])
_locals = st.one_of(_atoms, st.sampled_from(['"q r"', '"q\\.r".s', "a . b", "a b"]))
_domains = st.one_of(_atoms, st.sampled_from(["ex.com", "[1.2.3.4]", "a . b", "a(c).b", "a b", ""]))
_specs = st.tuples(_locals, _space, st.just("@"), _space, _domains).map("".join)
_angles = st.tuples(
    st.lists(_words, max_size=3).map(" ".join), _space, st.just("<"), _space,
    st.sampled_from(["", "@r.org:", ":"]), _specs, _space, st.just(">")).map("".join)
_mailboxes = st.one_of(_specs, _angles, _words, st.sampled_from(["Ann Lee", "<>", "<x y>", "<solo>"]))
_groups = st.tuples(
    st.one_of(_words, st.just("")), _space, st.just(":"), _space,
    st.lists(_mailboxes, max_size=3).map(", ".join), _space, st.just(";")).map("".join)
_headers = st.lists(st.tuples(_space, st.one_of(_mailboxes, _mailboxes, _groups), _space).map(
    "".join), min_size=1, max_size=4).map(",\r\n ".join)


@few
@given(texts=st.lists(_headers, min_size=50, max_size=300))
def test_address_lists_equal_python(spark, texts):
    assert apply(spark, texts, addresses) == [python_addresses(t) for t in texts]


@few
@given(texts=values(ADDRESS_PIECES, 7))
def test_what_is_no_address_list_gives_nothing_forged(spark, texts):
    """Random pieces: the same addresses as Python's, or none."""
    got = apply(spark, texts, addresses)
    want = [python_addresses(t) for t in texts]
    differ = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert all(g == [] for _, g, _ in differ), differ
    assert len(differ) <= 0.12 * len(texts)


def test_odd_headers(spark):
    deep = "(" * 40 + "x" + ")" * 40
    headers = [f"{deep} a@b.c", f"a@b.c {deep}, d@e.f", "G: A: a@b.c;;, d@e.f", "a@b.c d@e.f",
               "a@b.c <d@e.f>", ", a@b.c", "a@b.c,", "a@b.c, ", ",, a@b.c", '"open', "(open a@b.c",
               "undisclosed-recipients:;", ", ".join(["Ann (x) <a@b.c>"] * 3000), "Ann(x)Lee"]
    assert apply(spark, headers, addresses) == [python_addresses(h) for h in headers]


def test_plain_headers_need_no_python(spark):
    headers = ["a@b.c", "Ann <a@b.c>, \"Lee, Bob\" <b@c.d>,e@f.g", ", ".join(["a@b.c"] * 20_000)]
    assert apply(spark, headers, is_plain_address_header) == [True, True, True]
    assert apply(spark, headers, plain_addresses) == [python_addresses(h) for h in headers]


def python_html(page):
    """What a plain parser that waits for more input has read so far; None if it refuses."""
    class Text(HTMLParser):
        out = ""

        def handle_starttag(self, tag, attrs):
            self.out += "\n" * (tag in BLOCK_TAGS)

        def handle_data(self, data):
            self.out += data

    parser = Text()
    try:
        parser.feed(page)
    except AssertionError:
        return None
    return "\n".join(x.strip() for x in parser.out.splitlines() if x.strip())


HTML_PIECES = [
    "<p>", "</p>", "<br/>", "<b>", "text", "B c", "&amp;", "&copy", "&notit;", "&#65;", "&#x41;",
    "&#128;", "&#0;", "&zzz;", "&", "<!-- x -->", "<!-- ", "--  >", "<H2 id='a>b'>", "<script>",
    "</script>", "</ SCRIPT >", "</script x>", "<script/>", "<style a=b>", "</style>",
    "<script src=x/>", " ", "\n", "é", "</", "<", "</>", "</ x>", "<a", "<a b='",
    "<a b=\"q\"c d=e/>", "<p b==x", "'", '"', ">", "=", "/", "<![CDATA[ x ]]>", "<![if gte]>",
    "<![endif]", "<![foo]>", "<![", "<!doctype html>", "<!x", "<?pi", "?>", "\x00", "<a\x00b>",
    "&am", "&#x", "&#12", ";", "\xa0", "\u2028", "x" * 33, "&CounterClockwiseContourIntegral;",
    "<li>", "5 > 4", "<p\x0b>", "\x1c", "<div/ >", "<td //>"]


def native_html(spark, texts):
    got = apply(spark, texts, lambda t: F.struct(html_to_text(t).alias("x"), html_error(t).alias("e")))
    return [None if r.e else r.x for r in got]


@few
@given(texts=values(HTML_PIECES, 10))
def test_html_equals_a_plain_parser(spark, texts):
    assert native_html(spark, texts) == [python_html(t) for t in texts]


def test_pages_and_their_beginnings_equal_a_plain_parser(spark):
    """Whole pages, and each cut off where a reader would wait for more."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    texts = [p[:k] for n, p in enumerate(pages) for k in (len(p), len(p) * (n % 10) // 10)]
    assert native_html(spark, texts) == [python_html(t) for t in texts]


def test_html_of_awkward_pages(spark):
    long_tag = "<a " + "x='1' " * 50_000 + ">in</a>"
    texts = ["", "<", "&", "<p", "a<!--", "<script>x", long_tag, "y" * 300_000 + "&am"]
    assert native_html(spark, texts) == [python_html(t) for t in texts]
    assert apply(spark, [None], html_to_text) == [None]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


@few
@given(texts=values(["a", "b1", ".", "-", "_", "%", "+", "@", "@x.org", "x.io", " ", "é", "<", ">",
                     "[scrubbed]@example.com", "\n", ".c"], 10))
def test_redact_equals_python(spark, texts):
    once = [EMAIL.sub("[scrubbed]@example.com", t) for t in texts]
    assert apply(spark, texts, redact) == once
    assert apply(spark, once, redact) == [EMAIL.sub("[scrubbed]@example.com", t) for t in once]


def test_redact_cases(spark):
    texts = ["<alice@example.com>", "@handle", "3 @ 5", None, "a@b.com_x@y.com", "x" * 300_000]
    assert apply(spark, texts, redact) == [
        "<[scrubbed]@example.com>", "@handle", "3 @ 5", None,
        "[scrubbed]@example.com[scrubbed]@example.com", "x" * 300_000]


def test_rules_apply_in_order(spark):
    rules = (*DEFAULT_RULES, RedactionRule(r"\d{3}-\d{4}", "[phone]"),
             RedactionRule(r"\[phone\]", "[tel]"))
    assert apply(spark, ["call 555-1234 or a@b.org"], lambda t: redact(t, rules)) == [
        "call [tel] or [scrubbed]@example.com"]


def test_redact_message_leaves_ids_and_files(spark):
    df = spark.createDataFrame(
        [("m-a@b.org", "s a@b.org", "f a@b.org", ["a@b.org"], "b a@b.org", None,
          ["a@b.org.pdf"], ["l@x.org"])],
        "message_id string, subject string, sender string, recipients array<string>, "
        "body_text string, snippet string, attachment_filenames array<string>, "
        "labels array<string>")
    row = redact_message(df).first()
    mark = "[scrubbed]@example.com"
    assert (row.subject, row.sender, row.body_text) == (f"s {mark}", f"f {mark}", f"b {mark}")
    assert row.recipients == [mark] and row.snippet is None
    assert row.message_id == "m-a@b.org" and row.attachment_filenames == ["a@b.org.pdf"]
    assert row.labels == ["l@x.org"]


def test_redact_record_masks_every_summary_field(spark):
    df = spark.createDataFrame(
        [("id@x.org", "s a@b.org", ("t a@b.org", "u a@b.org", ["k a@b.org"], ["i a@b.org"],
                                    "c a@b.org"), "model@x.org")],
        "source_message_id string, subject string, summary struct<tl_dr:string,summary:string,"
        "key_points:array<string>,action_items:array<string>,category:string>, model string")
    row = redact_record(df).first()
    mark = "[scrubbed]@example.com"
    assert row.summary.asDict() == {
        "tl_dr": f"t {mark}", "summary": f"u {mark}", "key_points": [f"k {mark}"],
        "action_items": [f"i {mark}"], "category": f"c {mark}"}
    assert (row.source_message_id, row.model) == ("id@x.org", "model@x.org")
