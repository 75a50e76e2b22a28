"""URL filtering by mined association rules, under a list of curated host and path rules.

FP-growth finds combinations of URL tokens that go with bad labels. A rule is kept if
its confidence and support hold and no more general kept rule implies it. Rules are
matched by an inverted index: a rule stands under its rarest token only, so a URL meets
few of them and each is checked in full.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import stage, table

# Verdict and rule (host/path), of the list that goes before any mined rule.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
BAD = "label:bad"
MIN_CONFIDENCE = 0.9
#: A rule must stand on so many labelled pages, however many there are.
MIN_PAGES = 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for NULL or a URL without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def curated(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest fitting rule, NULL if none fits."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return found if chain is None else chain.otherwise(found)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a URL: host and its parents, path words, query names, scheme."""
    labels = F.split(host, r"\.")
    # Parents of two labels at least, whole names included.
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: (
        F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    single = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    words = F.transform(F.filter(F.split(path, r"[/._-]+"), lambda w: w != ""),
                        lambda w: F.concat(F.lit("path:"), w))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]*)="), 1),
                        lambda n: F.concat(F.lit("query:"), n))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    every = F.concat(parents, single, words, names, scheme)
    return F.array_distinct(F.array_compact(F.when(F.locate("://", url) > 0, every).otherwise(
        F.array().cast("array<string>"))))


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, bad, items) over the least token of each class, and the classes (token, item).

    Tokens that stand on the same rows are one class: no rule can tell them apart, and sets of
    them would only repeat each other. Tokens on fewer than MIN_PAGES rows can be in no rule.
    """
    single = rows.select("row", "bad", F.explode("tokens").alias("token"))
    # The rows of a token by their number and two sums over hashes that cannot overflow.
    tokens = single.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"),
        F.sum(F.shiftrightunsigned(F.xxhash64("row", F.lit(1)), 30)).alias("y")).where(
        F.col("n") >= MIN_PAGES)
    least = tokens.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    classes = tokens.join(least, ["n", "x", "y"]).select("token", "item")
    items = single.join(classes.where("token = item").select("token"), "token").groupBy(
        "row", "bad").agg(F.collect_list("token").alias("items"))
    return items, classes


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rules (tokens, confidence, support), and the classes (token, item) whose items they
    are over, from rows (tokens, bad boolean). Any token of a class stands for its item.

    A rule survives if a page with its tokens is bad with MIN_CONFIDENCE at least, on
    MIN_PAGES pages, and no kept rule over some of its tokens does as well. Rules have
    any number of tokens. FP-growth runs over the bad pages, where a rule must have its hits;
    the other pages that its tokens stand on are counted by the rule's rarest token.
    """
    rows = stage(labelled.where("bad is not null").withColumn(
        "row", F.monotonically_increasing_id()), "labelled-urls")
    items, classes = _told_apart(rows)
    items = stage(items, "url-items")
    bad = items.where("bad").select("items")
    n_bad = bad.count()
    empty = rows.sparkSession.createDataFrame(
        [], "tokens array<string>, confidence double, support bigint")
    if not n_bad:
        return empty, classes
    least = MIN_CONFIDENCE * MIN_PAGES
    grown = FPGrowth(minSupport=min(1.0, (least - 0.5) / n_bad), minConfidence=1.0).fit(bad)
    sets = stage(grown.freqItemsets.where(F.col("freq") >= least).select(
        F.array_sort("items").alias("tokens"), F.col("freq").alias("hit")), "url-sets")
    good = items.where(~F.col("bad"))
    commonness = good.select(F.explode("items").alias("token")).groupBy("token").count()
    first = sets.select("tokens", F.explode("tokens").alias("token")).join(
        commonness, "token", "left").groupBy("tokens").agg(F.min(F.struct(
            F.coalesce("count", F.lit(0)).alias("count"), "token")).alias("rarest")).select(
        F.col("tokens").alias("needed"), F.col("rarest.token").alias("token"))
    misses = (
        good.select("row", "items", F.explode("items").alias("token")).join(first, "token")
        .where(F.size(F.array_except("needed", "items")) == 0)
        .groupBy(F.col("needed").alias("tokens")).agg(F.count(F.lit(1)).alias("miss")))
    pages = F.col("hit") + F.coalesce("miss", F.lit(0))
    kept = stage(sets.join(misses, "tokens", "left").select(
        "tokens", (F.col("hit") / pages).alias("confidence"), pages.alias("support")).where(
        (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_PAGES)), "url-rules")
    rules = kept.join(_best_parts(kept), "tokens", "left").where(
        F.col("part_confidence").isNull() | (F.col("part_confidence") < F.col("confidence")))
    return rules.select("tokens", "confidence", "support"), classes


def _best_parts(kept: DataFrame) -> DataFrame:
    """(tokens, part_confidence): the highest confidence among the kept proper parts of each set.

    A part is met by its first token and confirmed by a subset test, so that parts are not listed.
    """
    listed = kept.select("tokens", F.explode("tokens").alias("token"))
    parts = kept.select(F.col("tokens").alias("part"), F.col("confidence").alias("other"),
                        F.get("tokens", F.lit(0)).alias("token"))
    return (
        listed.join(parts, "token")
        .where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
        .groupBy("tokens").agg(F.max("other").alias("part_confidence")))


def matched(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Ids (page_key) of pages (page_key, tokens) that some rule blocks, by an inverted index."""
    listed = rules.select("tokens", F.explode("tokens").alias("item"))
    # The rarest item is the one that fewest rules share; ties by name.
    common = listed.groupBy("item").count()
    index = listed.join(common, "item").groupBy("tokens").agg(
        F.min(F.struct("count", "item")).alias("least")).select(
        F.col("tokens").alias("needed"), F.col("least.item").alias("item"))
    used = classes.join(common.select("item"), "item", "left_semi")
    items = pages.select("page_key", F.explode("tokens").alias("token")).join(
        used, "token").groupBy("page_key").agg(F.collect_set("item").alias("items"))
    return (
        items.select("page_key", "items", F.explode("items").alias("item"))
        .join(index, "item").where(F.size(F.array_except("needed", "items")) == 0)
        .select("page_key").distinct()
    )


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    A curated rule decides where one fits; otherwise a page is blocked if a mined rule
    matches it, else allowed. ``labels`` (doc_id, quality, toxic) label the pages of
    equal id: bad is quality 0 or toxic 1. A NULL URL or one without ``://`` has an
    empty host and path, no tokens, and is allowed. Repeated rows are judged alike, on
    their own rows; without labels, no rule is mined. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", curated(F.col("host"), F.col("path")))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(
        "toxic").alias("toxic")).select(F.col("doc_id").alias("page_id"), bad)
    rules, classes = mine(judged.select("page_id", tokens).join(known, "page_id"))
    # The tokens of a URL hang on the URL alone: different ones are matched once each.
    open_ = judged.where("fit is null and url is not null").select(
        F.col("url").alias("page_key"), tokens).distinct()
    hits = matched(open_, rules, classes).select(F.col("page_key").alias("url"), F.lit(True).alias("hit"))
    return judged.join(hits, "url", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"),
                      table(spark, sf_dir, "labels"))
