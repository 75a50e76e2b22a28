"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the
seeds, each whole span one instance: the words beside it become lexical patterns, and a
graph of patterns and identifier-like tokens is scored in rounds. A pattern is trusted for a
kind by the known entities of that kind it stands beside against those of other kinds, and against
a tenth of the tokens of which nothing is known: what it is to find must not speak against it.
Tokens that trusted patterns agree on are new entities, and seeds of the next round; the
rounds end when one finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.functions.text import let
from msgpipe.llm.common import sha256_hex, stage, table

# Kinds in order, and what they look like. A match may start only where no
# earlier start would have taken it in (or right after a match), and repeats give nothing
# back, so each pattern finds what the plain form finds, in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_DIGITS = r"[+(]?+[0-9][0-9().+/-]*+"
#: Identifier-like tokens: digit groups with single spaces between, white-space words that
#: hold a digit, and those with a sign inside.
TOKEN = (rf"(?<!\S)(?:{_DIGITS}(?:\x20{_DIGITS})*+\S*+|[^\s0-9]*+[0-9]\S*+"
         r"|[^\s@._:/(]++[@._:/(]++[^\s@._:/(]\S*+)")

#: A pattern needs so many different known entities of its kind, and this share of them.
SUPPORT, CONFIDENCE = 10, 0.9
#: What a token beside a pattern counts of which nothing is known.
UNKNOWN = 0.1
#: Characters beside a span that its words are taken from; a longer word is cut.
CONTEXT = 64
#: A token is a new entity from this score on, and with so many trusted patterns.
ENTITY, PATTERNS = 0.99, 2
_CHUNK = 256


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, hit, left, right) of all matches; start in code points, from 0.

    The texts between matches give the starts as a running sum, taken in chunks so that
    arrays do not grow one by one over a long text.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    n = F.size(hits)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), hits.alias("hit"),
                     F.slice(gaps, 2, n).alias("next")),
        lambda x: F.struct(
            F.length(x["gap"]).cast("bigint").alias("skip"), x["hit"].alias("hit"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("left"),
            F.left(x["next"], F.lit(CONTEXT)).alias("right")))
    row = "struct<start:bigint,hit:string,left:string,right:string>"
    chunk = f"struct<at:bigint,rows:array<{row}>>"

    def step(acc, x):
        start = acc["at"] + x["skip"]
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["rows"], F.array(
            F.struct(start.alias("start"), x["hit"].alias("hit"), x["left"].alias("left"),
                     x["right"].alias("right")))).alias("rows"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast(f"array<{row}>").alias("rows")).cast(chunk)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / _CHUNK).cast("int")),
        lambda k: F.aggregate(F.slice(rows, k * _CHUNK + 1, F.lit(_CHUNK)), empty, step))

    def shifted(acc, c):
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["rows"], F.transform(
            c["rows"], lambda x: x.withField("start", x["start"] + acc["at"]))).alias("rows"))

    whole = F.aggregate(chunks, empty, shifted)["rows"]
    return F.when(n > 0, whole).otherwise(F.array().cast(f"array<{row}>"))


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast(
            "int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (
            (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.right(p, F.lit(3)) <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_TOKENS = ("array<struct<start:bigint,end:bigint,token:string,before:string,after:string,"
           "kind:int>>")


def base_tokens(text: Column) -> Column:
    """Array of (start, end, token, before, after, kind) of the base entities of a text."""
    found = []
    for number, (pattern, hint) in enumerate(((EMAIL, "@"), (IP, None), (CARD, None), (PHONE, "+"))):
        hits = F.transform(F.filter(matches(text, pattern), _keeper(KINDS[number])),
                           _instance(number))
        may = text.contains(hint) if hint else text.rlike("[0-9]")
        found.append(F.when(may, hits).otherwise(F.array().cast(_TOKENS)))
    return F.concat(*found)


def _keeper(kind: str):
    return lambda x: _valid(kind, x["hit"])


def _instance(kind: int | None):
    """A match with the words beside the whole of it, without the punctuation between."""
    def word(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[0-9]", "#")

    def instance(x: Column) -> Column:
        left = F.regexp_replace(x["left"], r"[^\p{L}\p{N}]++$", "")
        right = F.regexp_replace(x["right"], r"^[^\p{L}\p{N}]++", "")
        return F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"),
            x["hit"].alias("token"), word(F.regexp_extract(left, r"(\S*+)$", 1)).alias("before"),
            word(F.regexp_extract(right, r"^(\S*+)", 1)).alias("after"),
            F.lit(kind).cast("int").alias("kind"))

    return instance


def spans_of(base: Column) -> Column:
    """Sorted array of (start, kind, end) of base instances."""
    return F.array_sort(F.transform(base, lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"))))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind, end) of the base entities of a text."""
    return spans_of(base_tokens(text))


def tokens(text: Column) -> Column:
    """Array like that of ``base_tokens`` of identifier-like tokens, whose kind is NULL."""
    may = text.rlike(r"[0-9]|[^\s@._:/(][@._:/(]++[^\s@._:/(]")
    return F.when(may, F.transform(matches(text, TOKEN), _instance(None))).otherwise(
        F.array().cast(_TOKENS))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, tokens) of each document; ``row`` tells texts of one doc_id apart.

    ``tokens`` are the base entities and the identifier-like tokens that overlap none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), F.struct(
        base_tokens(text).alias("known"), tokens(text).alias("others")).alias("found"))
    return rows.select("doc_id", "row", let(F.col("found"), lambda x: let(
        spans_of(x["known"]), lambda base: F.struct(
            base.alias("base"), F.concat(x["known"], F.filter(x["others"], lambda t: ~F.exists(
                base, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))))
            .alias("tokens")))).alias("x")).select("doc_id", "row", "x.base", "x.tokens")


def new_entities(found: DataFrame) -> DataFrame:
    """(token, kind) of entities that trusted patterns discover, from ``extract``.

    Pattern and token meet in one edge however often, so copies do not add support.
    Scores combine before each shuffle; a pattern of very many tokens is one group of a
    plain aggregate.
    """
    seen = found.select(F.explode("tokens").alias("t")).select(
        "t.token", "t.before", "t.after", "t.kind")
    edges = stage(seen.select("token", "kind", F.explode(F.array(
        F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"))).alias("pattern"))
        .where(F.length("pattern") > 2).groupBy("token", "pattern").agg(
            F.min("kind").alias("kind")), "pattern-edges")
    known = edges.where("kind is not null").groupBy("token").agg(F.min("kind").alias("kind"))
    seeds = stage(known, "seed-entities")
    news = None
    # Every round but the last makes some token known, so the rounds end.
    while True:
        marked = edges.select("token", "pattern").join(known, "token", "left")
        totals = marked.groupBy("pattern").agg(F.sum(
            F.when(F.col("kind").isNull(), UNKNOWN).otherwise(1.0)).alias("all"))
        # A kind counts by its own tokens; most often one kind leads, if any.
        trusted = (
            marked.where("kind is not null").groupBy("pattern", "kind").agg(
                F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
            .join(totals, "pattern").withColumn("confidence", F.col("n") / F.col("all"))
            .where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"))
        scored = (
            edges.select("token", "pattern").join(known, "token", "left_anti")
            .join(trusted, "pattern").groupBy("token", "kind").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
                 ).alias("score"), F.count(F.lit(1)).alias("patterns"))
            .where((F.col("score") >= ENTITY) & (F.col("patterns") >= PATTERNS))
            .groupBy("token").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
        fresh = stage(scored, "new-entities")
        if fresh.isEmpty():
            break
        news = fresh if news is None else news.unionByName(fresh)
        known = seeds.unionByName(news)
    return news if news is not None else seeds.limit(0)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, spans): base entities, and those with the discovered ones.

    Spans are arrays of (start, kind number, end) sorted by start and kind. NULL and
    empty texts have none. Every row keeps its own row; repeated rows get equal spans.
    Discovered spans never overlap base ones. Other columns are ignored.
    """
    found = stage(extract(docs), "personal-data")
    news = new_entities(found)
    # A token of a third of all rows meets one entity row here; AQE splits its side.
    added = (
        found.select("doc_id", "row", "base", F.explode("tokens").alias("t"))
        .withColumn("token", F.col("t.token")).join(news, "token")
        .where(~F.exists("base", lambda s: (s["start"] < F.col("t.end")) & (
            s["end"] > F.col("t.start"))))
        .select("doc_id", "row", F.struct(
            F.col("t.start").alias("start"), "kind", F.col("t.end").alias("end")).alias("span"))
        .distinct().groupBy("doc_id", "row").agg(F.collect_list("span").alias("added")))
    left = found.select("doc_id", "row", "base")
    joined = left.join(added, left["doc_id"].eqNullSafe(added["doc_id"]) & (
        left["row"] == added["row"]), "left")
    return joined.select(left["doc_id"], left["row"], "base", F.array_sort(F.concat(
        "base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, KINDS),
                        sha256_hex(_written(F.col("base"))).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))
