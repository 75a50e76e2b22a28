"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most ``BITS`` apart agree in
some segment up to ``BITS // SEGMENTS`` bits, so looking up the small Hamming ball
around each segment value in a table of segment values finds every pair; the whole
distance is checked in the join itself, and only links leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import (
    components,
    crowded,
    in_arrow,
    near,
    nearest_pairs,
    stage,
    table,
    texts_of,
    with_component,
)
WORDS = 4
BITS = 4
SEED = 42
#: (first bit, width) of the segments. Widths near log2 of the number of different
#: fingerprints keep about one random candidate per lookup: three up to some ten
#: million, two of 32 bits (with balls of radius two) beyond.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ROWS = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    size = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in
                       zip(starts, ends[size - 1:], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        octets = hashes[at:at + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per document; ``fp`` is the fingerprint as a signed BIGINT."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def convert(batch):
            found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        return convert

    return in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, fp bigint")


def _segment(value, first: int, width: int):
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def _ball(value, width: int, radius: int):
    """Array of all values at most ``radius`` (0, 1 or 2) bits from ``value``."""
    masks = [0]
    if radius > 0:
        masks += [1 << i for i in range(width)]
    if radius > 1:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: m.cast("bigint").bitwiseXOR(value))


def _keys(seg: int, values):
    return F.transform(values, lambda v: F.struct(F.lit(seg).alias("seg"), v.alias("value")))


def links(different: DataFrame, bits: int = BITS, segments=SEGMENTS) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` at most ``bits`` apart.

    ``different`` holds different fingerprints. First, each is linked to its nearest
    of equal segment value. Multi-index lookups then run only between fingerprints
    not connected so far: a dense group of thousands gives few links instead of all
    its pairs, and the connected components are those of all pairs.
    """
    fp = F.col("fp")
    radius = bits // len(segments)
    if radius > 2:
        raise ValueError("more segments are needed for this distance")
    exact = different.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("seg"), _segment(fp, *s).alias("value"))
        for k, s in enumerate(segments)))).alias("s")).select("fp", "s.seg", "s.value")
    close = stage(
        nearest_pairs(crowded(exact, ["seg", "value"], "fp"), ["fp"])
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        .where(near(F.col("a"), F.col("b"), bits)), "simhash-close")
    known = with_component(different, "fp", components(close))
    known = stage(known, "simhash-known")
    entries = known.select(fp.alias("b"), F.col("component").alias("cb"), F.explode(F.array(*(
        F.struct(F.lit(k).alias("seg"), _segment(fp, *s).alias("value"))
        for k, s in enumerate(segments)))).alias("s")).select("b", "cb", "s.seg", "s.value")
    lookups = known.select(fp.alias("a"), F.col("component").alias("ca"), F.explode(F.concat(*(
        _keys(k, _ball(_segment(fp, *s), s[1], radius)) for k, s in enumerate(segments)
    ))).alias("s")).select("a", "ca", "s.seg", "s.value")
    # Spark sizes both sides by the file before the explode, a small part of what they are, and
    # would broadcast one of them.
    far = entries.hint("merge").join(lookups, ["seg", "value"]).where(
        (F.col("ca") < F.col("cb")) & near(F.col("a"), F.col("b"), bits)).select("a", "b")
    return close.unionByName(far.distinct())


def simhash_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): class of near-duplicates of each document.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in
    ``BITS`` bits or fewer. NULL and empty texts have fingerprint zero and link like
    any other. Every row keeps its own row, repeated rows too; a NULL doc_id is never
    the smallest. Other columns are ignored.
    """
    marked = stage(fingerprints(docs), "fingerprints")
    different = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = with_component(different, "fp", components(links(different.select("fp"))))
    found = stage(found, "simhash-classes")
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each class the smallest doc_id stays.

    All rows of that doc_id stay, as do rows without a doc_id; columns are unchanged.
    """
    gone = simhash_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    classes = simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
