"""Address headers to bare addresses, without leaving the JVM.

Plain headers, nearly all of them, take one expression. For the others comments are taken
out, with those inside them, the list is cut at its commas, and each item is read by itself:
groups, routes, quoted pairs, domain literals, items with nothing in them. A header that is
not a list of addresses gives none at all rather than some that may be forged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions.text import let

# A plain header is a comma list of `a@x`, `Name <a@x>` and `"Last, First" <a@x>`
# with '@' in addresses only. Possessive loops keep the match iterative, however
# long the list.
_PLAIN_ATOM = r'[^\s<>()\[\]:;@\\,"\p{Cntrl}]'
_ADDRESS = rf"{_PLAIN_ATOM}++@{_PLAIN_ATOM}++"
_PLAIN_QUOTED = r'"[^"\\()<>:;@\[\]\p{Cntrl}]*+"'
_WORDS = r'[^<>()\[\]:;@\\,"\p{Cntrl}]*+'
_ITEM = rf" *+(?:{_ADDRESS}|(?:{_PLAIN_QUOTED} *+|{_WORDS})<{_ADDRESS}>) *+"
_PLAIN = rf"^{_ITEM}(?:,{_ITEM})*+\z"

# Parts of any other header. A comment becomes a NUL: white space that is not kept.
_COMMENTED = "\0"
_SPACES = " \t\r\n" + _COMMENTED
_W = r"[ \t\r\n\x00]*+"
_SPECIAL = r' \t\r\n\x00()<>@,:;"\[\]'
_ATOM = rf"[^.{_SPECIAL}]++"
_QUOTED = r'"(?:\\.|[^"\\])*+(?:"|\\?\z)'
_PHRASE = rf"(?:(?:[^{_SPECIAL}]++|{_QUOTED}){_W})"
_LITERAL = r"\[(?:\\.|[^\]\\])*+(?:\]|\\?\z)"
_DOMAIN = rf"(?:{_ATOM}|\.|{_LITERAL}|[ \t\x00])*+"
_LOCAL = rf"(?:(?:{_ATOM}|\.|{_QUOTED}){_W})*+"
# Comments this deep are taken out in one pass.
_DEPTH = 8


def _comment(depth: int) -> str:
    inner = rf"|{_comment(depth - 1)}" if depth else ""
    return rf"\((?:\\.|[^()\\]{inner})*+(?:\)|\\?\z)"


_LEXEME = rf'(?s){_QUOTED}|{_comment(_DEPTH)}|[^"(]++|.'
_PIECE = rf'(?s)(?:{_QUOTED}|[^",])++|,'
_PAIR = r'(?s)\G((?:\\.|[^"\\])*+)"(?:\\.|[^"\\])*+"'
_GROUP_START = rf"(?s)^{_W}{_PHRASE}*+:"
_GROUP_END = rf"(?s);{_W}\z"
_QUOTES_END = r'(?s)^(?:"(?:\\.|[^"\\])*+"|[^"]++)*+\z'
_ANGLE = rf'(?s)^{_PHRASE}*+<((?:[^">]++|{_QUOTED})*+)>{_W}\z'
_ROUTE = rf"(?s)^(?:[ \t\r\n\x00:]|@{_W}{_DOMAIN})*+"
_SPEC = rf"(?s)^({_LOCAL})(@?)({_W})({_DOMAIN}){_W}\z"
_BROKEN = rf"(?s)@{_W}[^ \t\r\n\x00>].*[\r\n]{_W}\z"
_FIRST_WORD = rf"(?s)^([^{_SPECIAL}]++|{_QUOTED}){_W}{_PHRASE}*+\z"


def is_plain_address_header(header: Column) -> Column:
    return header.rlike(_PLAIN)


def plain_addresses(header: Column) -> Column:
    """Addresses of a plain header."""
    return F.regexp_extract_all(header, F.lit(_ADDRESS), 0)


def _repeat(value: Column, times: Column, step: Callable[[Column], Column]) -> Column:
    return F.when(times < 1, value).otherwise(
        F.reduce(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), value, lambda v, _: step(v)))


def _without_comments(header: Column) -> Column:
    """Comments replaced; each pass takes out _DEPTH levels, and most headers have one level."""
    def one_pass(text: Column) -> Column:
        kept = F.transform(F.regexp_extract_all(text, F.lit(_LEXEME), 0), lambda t: F.when(
            F.startswith(t, F.lit("(")) & (F.length(t) > 1), F.lit(_COMMENTED)).otherwise(t))
        return F.when(F.contains(text, F.lit("(")), F.array_join(kept, "")).otherwise(text)

    passes = F.ceil(F.regexp_count(header, F.lit(r"\(")) / _DEPTH).cast("int")
    return let(header, lambda h: _repeat(h, passes, one_pass))


def _unquoted(quoted: Column) -> Column:
    """Content of a quoted string, its closing quote present or not."""
    inner = F.regexp_replace(F.substr(quoted, F.lit(2)), r'(?s)^((?:\\.|[^"\\])*+)(?:"|\\?)\z', "$1")
    return F.regexp_replace(inner, r"(?s)\\(.)", "$1")


def _local(text: Column) -> Column:
    """White space between words stays, but not beside a dot or at the end."""
    close = F.regexp_replace(text, rf"(?s)({_QUOTED})|{_W}(\.){_W}", "$1$2")
    words = F.transform(F.regexp_extract_all(close, F.lit(rf"(?s){_QUOTED}|[^\"]++"), 0), lambda t: (
        F.when(F.startswith(t, F.lit('"')), F.concat(F.lit('"'), F.regexp_replace(
            _unquoted(t), r'([\\"])', r"\\$1"), F.lit('"')))
        .otherwise(F.regexp_replace(t, r"[\r\n\x00]", ""))))
    return F.rtrim(F.array_join(words, ""), F.lit(" \t"))


def _spec(text: Column) -> Column:
    """`local@domain`, or a lone local part; '' without a domain, NULL if it is neither."""
    def read(spec: Column) -> Column:
        def part(n: int) -> Column:
            return F.regexp_extract(spec, _SPEC, n)

        domain = F.regexp_replace(part(4), r"(?s)(\[.*\])|[ \t\x00]", "$1")
        return (
            F.when(~spec.rlike(_SPEC), F.lit(None))
            .when((part(2) == "") & (part(4) != ""), F.lit(None))
            .when(part(2) == "", _local(part(1)))
            .when(domain == "", F.lit(""))
            .otherwise(F.concat(_local(part(1)), F.lit("@"), domain)))

    return let(F.ltrim(text, F.lit(_SPACES)), read)


def _address(core: Column) -> Column:
    """Address of an item without its group's marks: '' if it has none, NULL if it is malformed."""
    first = F.regexp_extract(core, _FIRST_WORD, 1)
    found = (
        F.when(core == "", F.lit(""))
        .when(core.rlike(_FIRST_WORD), F.when(
            F.startswith(first, F.lit('"')), _unquoted(first)).otherwise(first))
        .when(core.rlike(_ANGLE), let(
            F.regexp_replace(F.regexp_extract(core, _ANGLE, 1), _ROUTE, ""),
            # Only blanks and comments may stand between a domain and its bracket.
            lambda inside: F.when(~inside.rlike(_BROKEN), _spec(inside))))
        .otherwise(F.when(F.contains(core, F.lit("@")), _spec(core)))
    )
    # Domain literals are not accepted.
    return let(found, lambda f: F.when(F.contains(f, F.lit("[")), F.lit("")).otherwise(f))


def _item(text: Column) -> Column:
    """(address, empty, opens, closes): the item, and the groups that begin and end with it."""
    def pull(mark: str):
        def step(state: Column) -> Column:
            return F.when(state["text"].rlike(mark), F.struct(
                F.regexp_replace(state["text"], mark, "").alias("text"),
                (state["n"] + 1).alias("n"))).otherwise(state)
        return step

    def counted(value: Column, char: str, mark: str) -> Column:
        start = F.struct(value.alias("text"), F.lit(0).alias("n"))
        return _repeat(start, F.regexp_count(value, F.lit(char)), pull(mark))

    def ended(started: Column) -> Column:
        # A quote that does not end has everything behind it.
        whole = started["text"].rlike(_QUOTES_END)
        return let(F.when(whole, counted(started["text"], ";", _GROUP_END)).otherwise(
            F.struct(started["text"].alias("text"), F.lit(0).alias("n"))), lambda e: let(
            F.when(whole, F.trim(e["text"], F.lit(_SPACES))).otherwise(
                F.ltrim(e["text"], F.lit(_SPACES))),
            lambda core: F.struct(
                _address(core).alias("address"), (core == "").alias("empty"),
                started["n"].alias("opens"), e["n"].alias("closes"))))

    return let(counted(text, ":", _GROUP_START), ended)


def _items(text: Column) -> Column:
    """The list cut at its commas; items between two commas may be empty."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
    return let(pieces, lambda p: F.filter(F.transform(
        F.concat(F.array(F.lit(",")), p), lambda t, i: F.when(
            t != ",", t).when(F.coalesce(F.get(p, i), F.lit(",")) == ",", F.lit(""))),
        lambda t: t.isNotNull()))


def _in_order(items: Column) -> Column:
    """Whether groups are balanced and nothing is missing where something must be.

    No group ends that has not begun, and no two items in a row are empty. In a group an item
    is empty only if the group is, or if the header ends there.
    """
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("depth"), F.lit(False).alias("empty"),
                     F.lit(True).alias("closed"))

    def step(state: Column, item: Column) -> Column:
        depth = state["depth"] + item["opens"] - item["closes"]
        bare = item["empty"]
        alone = bare & (item["opens"] == 0) & (item["closes"] == 0)
        ok = (state["ok"] & state["closed"] & item["address"].isNotNull() & (depth >= 0)
              & ~(alone & state["empty"]) & ~(bare & (state["depth"] > 0)))
        return F.struct(ok.alias("ok"), depth.alias("depth"), alone.alias("empty"),
                        (~bare | (item["opens"] == item["closes"])).alias("closed"))

    return F.reduce(items, start, step, lambda s: s["ok"])


def _balanced(text: Column) -> Column:
    """Whether parentheses outside of quoted names are balanced."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), "[^()]", ""), "")
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("open"))

    def step(state: Column, mark: Column) -> Column:
        now = state["open"] + F.when(mark == "(", 1).when(mark == ")", -1).otherwise(0)
        return F.struct((state["ok"] & (now >= 0)).alias("ok"), now.alias("open"))

    return ~text.rlike("[()]") | F.reduce(
        marks, start, step, lambda s: s["ok"] & (s["open"] == 0))


def _listed(header: Column) -> Column:
    """Addresses of any header that is not plain."""
    def read(outside: Column) -> Column:
        # What a reader that knows of quoted names only takes for separators.
        commas = F.regexp_count(outside, F.lit(","))
        items = F.when(_balanced(outside), F.transform(
            _items(_without_comments(header)), _item))
        return let(items, lambda i: F.when(
            (F.size(i) == commas + 1) & ~F.endswith(header, F.lit(",")) & _in_order(i),
            F.filter(F.transform(i, lambda item: item["address"]), lambda a: a != "")))

    nothing = F.array().cast("array<string>")
    return F.coalesce(let(F.regexp_replace(header, _PAIR, "$1"), read), nothing)


def addresses(header: Column) -> Column:
    """Bare addresses of a header, empties dropped; NULL or '' gives ``[]``.

    A lone word counts as an address. A header that is no list of addresses, say because
    an address follows another without a comma, gives ``[]``, even if it has a comma too
    many elsewhere.
    """
    absent = F.coalesce(header, F.lit("")) == ""
    return (F.when(absent, F.array().cast("array<string>"))
            .when(is_plain_address_header(header), plain_addresses(header))
            .otherwise(let(header, _listed)))
