"""HTML to text as one pass over tokens, without leaving the JVM.

A line starts at every block tag, entities are decoded, comments and tags dropped, script
and style text is kept as it is, lines are stripped and blank ones left out. A page is
read as by a reader that waits for more: a tag, comment or script that never ends, and a
last word that may be the start of an entity, give no text.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpipe.functions.text import LINE_BREAK_CLASS, let, strip

# The tags that start a new line.
BLOCK_TAGS = ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
# Keywords of marked sections, by how the section ends.
_LONG_SECTIONS = "temp|cdata|ignore|include|rcdata"
_SHORT_SECTIONS = "if|else|endif"

# White space (Unicode's, and the ASCII separators), for use inside brackets.
_S = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What ends the name of a tag.
_STOP = r"\t\n\r\f />\x00"
# Loops over attributes are possessive: they run as loops, however long the tag.
_GAP = rf"(?:[{_S}]|/(?!>))*+"
_VALUE = rf"""(?:'[^']*+'|"[^"]*+"|(?!['"])[^>{_S}]*+)"""
_ATTRIBUTE = rf"""(?<=['"/{_S}])[^/>{_S}][^/=>{_S}]*+(?:[{_S}]*=+[{_S}]*{_VALUE})?{_GAP}"""
_REST = rf"{_GAP}(?:{_ATTRIBUTE})*+"
_SECTION_NAME = r"(?![-_.a-zA-Z0-9])"


def _raw_element(name: str) -> str:
    return rf"<{name}(?=[{_STOP}])(?!\x00){_REST}>.*?</[{_S}]*{name}[{_S}]*>"


# In this order; together they take in every character.
_TOKEN = "(?is)" + "|".join((
    r"[^<]++",
    rf"<!--.*?--[{_S}]*>",
    rf"<!\[(?:{_LONG_SECTIONS}){_SECTION_NAME}.*?\][{_S}]*\][{_S}]*>",
    rf"<!\[(?:{_SHORT_SECTIONS}){_SECTION_NAME}.*?\][{_S}]*>",
    _raw_element("script"), _raw_element("style"),
    # A raw-text element that never ends: the rest of the page.
    rf"<(?:script|style)(?=[{_STOP}])(?!\x00){_REST}>.*",
    rf"<[a-z][^{_STOP}]*+{_REST}/?>",
    r"</[^>]*+>",
    r"<(?:\?|!(?!--|\[))[^>]*+>",
    # A name that breaks off at a NUL is text.
    rf"""<[a-z][^{_STOP}]*+(?<!['"{_S}])(?=\x00)""",
    # Markup that never ends, or that cannot be read: the rest of the page.
    r"<[a-z/!?].*",
    r"<",
))
_BLOCK = rf"(?i)^<(?:{'|'.join(BLOCK_TAGS)})(?=[{_STOP}])(?!\x00)"
_RAW_TEXT = rf"(?is)^<(?:script|style)(?=[{_STOP}])(?!\x00){_REST}>(.*)</[^<]*\z"
_CLOSED_RAW = rf"(?is)^(?:{_raw_element('script')}|{_raw_element('style')})\z"
_RAW_START = rf"(?i)^<(?:script|style)(?=[{_STOP}])(?!\x00){_REST}>"
# A lone bracket, or a tag's name that breaks off: text, unless the page ends there.
_AS_TEXT = rf"(?i)^<(?:[a-z][^{_STOP}]*+)?\z"
# A marked section that is none: an unknown keyword, or no keyword at all.
_UNKNOWN_SECTION = (
    rf"(?is)^<!\[(?!\z|[a-z][-_.a-z0-9]*+[{_S}]*+\z"
    rf"|(?:{_LONG_SECTIONS}|{_SHORT_SECTIONS}){_SECTION_NAME}).*")
_ENTITY = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)|[^&]++|&"
# Names that count without a semicolon, longest first.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# References to the C1 range mean windows-1252; its five unused bytes stay as they are.
_C1_CHARS = "".join(
    bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)
)
# A last piece of text that may still be an unfinished entity is not emitted.
_OPEN_ENTITY = rf"&[^&;{_S}]{{0,33}}\z"


def _named(token: Column) -> Column:
    """Text of a named entity; longest known name first, unknown ones unchanged."""
    table = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items()})),
                        "map<string,string>")
    bare = F.regexp_extract(token, f"^&({_BARE_NAMES})", 0)
    return F.coalesce(
        F.try_element_at(table, token),
        F.when(bare != "", F.concat(F.try_element_at(table, bare),
                                    F.substr(token, F.length(bare) + 1))),
        token,
    )


def _numeric(token: Column) -> Column:
    """Text of a numeric entity: windows-1252 for the C1 range, U+FFFD if not a character."""
    digits = F.regexp_extract(token, "^&#[xX]?([0-9a-fA-F]+)", 1)
    short = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(short) > 9, F.lit(0x110000)).otherwise(
        F.when(token.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), short), 16, 10))
        .otherwise(F.concat(F.lit("0"), short)).cast("bigint"))
    return let(code, lambda n: (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("�"))
        .when(n.between(0x80, 0x9F), F.substr(F.lit(_C1_CHARS), (n - 0x7F).cast("int"), F.lit(1)))
        .when(n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0x7F) | (n == 0xB)
              | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    ))


def unescape(text: Column) -> Column:
    """Entities of one piece of text to characters."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_ENTITY), 0),
        lambda t: F.when(t.rlike("^&#[0-9xX]"), _numeric(t))
        .when(t.rlike("^&[A-Za-z]"), _named(t)).otherwise(t),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def clean_lines(text: Column) -> Column:
    """Strip every line and drop the blank ones."""
    lines = F.transform(F.split(text, LINE_BREAK_CLASS), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _token_text(token: Column) -> Column:
    """Text of one token. Tags are complete if they end with a bracket that is theirs."""
    return (
        F.when(~F.startswith(token, F.lit("<")), unescape(token))
        .when(token.rlike(_RAW_START), F.when(
            token.rlike(_CLOSED_RAW), F.regexp_extract(token, _RAW_TEXT, 1)).otherwise(F.lit("")))
        .when(token.rlike(_BLOCK), F.lit("\n"))
        .when(token.rlike(_AS_TEXT), token)
        .otherwise(F.lit(""))
    )


def _tokens(html: Column) -> Column:
    """Tokens of a page, without a last one that may be the start of an entity or a tag."""
    def finished(tokens: Column) -> Column:
        last = F.try_element_at(tokens, F.lit(-1))
        held = F.coalesce(last.rlike(_AS_TEXT) | (
            ~F.startswith(last, F.lit("<")) & last.rlike(_OPEN_ENTITY)), F.lit(False))
        return F.when(held, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)

    return let(F.regexp_extract_all(html, F.lit(_TOKEN), 0), finished)


def html_error(html: Column) -> Column:
    """Why a page cannot be read, NULL if it can: a marked section of an unknown kind."""
    bad = F.exists(F.regexp_extract_all(html, F.lit(_TOKEN), 0),
                   lambda token: token.rlike(_UNKNOWN_SECTION))
    return F.when(F.contains(html, F.lit("<![")) & bad,
                  F.lit("HTML has a marked section of an unknown kind"))


def html_to_text(html: Column) -> Column:
    """Text of a page; NULL stays NULL."""
    return clean_lines(F.array_join(F.transform(_tokens(html), _token_text), ""))
