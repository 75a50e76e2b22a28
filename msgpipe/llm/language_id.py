"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds the vectors of its letters,
each rotated by its place, into their product; a text bundles its n-grams into their sum;
a language bundles its texts. A text has the language whose profile lies at the
smallest angle. Sums are whole numbers, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.llm.common import in_arrow, table, texts_of

DIMENSIONS = 2048
#: Letters of an n-gram; the edge of a word counts as a letter at either end.
GRAM = 3
SEED = 20
#: Rows with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Characters, about, and texts that are bundled at once, and n-grams bound at once.
BLOCK_CHARS, BLOCK_TEXTS, BLOCK_GRAMS = 1 << 18, 128, 4096
#: A text counts by its direction alone: its unit vector in steps of 1 / SCALE.
SCALE = 1 << 16
#: Languages whose sums a task holds before it hands them on.
HELD_LANGUAGES = 64


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter of every code point, 0 for whatever is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


@functools.lru_cache(maxsize=8192)
def letter_vector(code: int, size: int) -> np.ndarray:
    """Random signs of a letter (0: the edge of a word), the same in every task."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).bytes(-(-size // 8))
    signs = np.unpackbits(np.frombuffer(bits, np.uint8))[:size].astype(np.int8)
    return 2 * signs - 1


def bind(grams: np.ndarray, size: int) -> np.ndarray:
    """One vector per row of letters: the product of its letters, rotated by place."""
    codes, places = np.unique(grams, return_inverse=True)
    vectors = np.stack([letter_vector(int(c), size) for c in codes])
    places = places.reshape(grams.shape)
    last = grams.shape[1] - 1
    bound = np.ones((len(grams), size), np.int8)
    for k in range(last + 1):
        bound *= np.roll(vectors, last - k, axis=1)[places[:, k]]
    return bound


def _ranked(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order and the rank of each; by table where ``top`` bounds them."""
    if top > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(top, bool)
    there[values] = True
    ranks = np.cumsum(there, dtype=np.int32) - 1
    return np.flatnonzero(there), ranks[values]


def bundle(texts: list[str], size: int = DIMENSIONS) -> np.ndarray:
    """Sum of the n-gram vectors of each text; a text without a letter is all zero."""
    out = np.zeros((len(texts), size), np.int64)
    first, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars > BLOCK_CHARS or k + 1 - first >= BLOCK_TEXTS or k + 1 == len(texts):
            out[first:k + 1] = _bundle_block(texts[first:k + 1], size)
            first, chars = k + 1, 0
    return out


def _bundle_block(texts: list[str], size: int) -> np.ndarray:
    # A zero before, between and after the texts: no n-gram reaches from one to the next.
    joined = "\0" + "\0".join(texts) + "\0"
    letters = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    width = GRAM - 1
    inner = np.ones(max(len(letters) - width, 0), bool)
    for k in range(1, width):
        inner &= letters[k:len(letters) - width + k] != 0
    at = np.flatnonzero(inner)
    out = np.zeros((len(texts), size), np.int64)
    if not len(at):
        return out
    known, ranks = _ranked(letters, 0x110000)
    key = np.zeros(len(at), np.int64)
    for k in range(GRAM):
        key = key * len(known) + ranks[at + k]
    keys, which = _ranked(key, len(known) ** GRAM)
    grams = np.empty((len(keys), GRAM), np.uint32)
    rest = keys
    for k in reversed(range(GRAM)):
        grams[:, k] = known[rest % len(known)]
        rest = rest // len(known)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, at, side="right")
    # Single precision is exact while no sum reaches 2**24.
    exact = np.float32 if max(map(len, texts)) < 1 << 24 else np.float64
    for low in range(0, len(keys), BLOCK_GRAMS):
        high = min(low + BLOCK_GRAMS, len(keys))
        here = (which >= low) & (which < high)
        counts = np.bincount(text[here] * (high - low) + which[here] - low,
                             minlength=len(texts) * (high - low)).reshape(len(texts), -1)
        bound = bind(grams[low:high], size).astype(exact)
        out += (counts.astype(exact) @ bound).astype(np.int64)
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return np.sqrt((wide * wide).sum(1))


@dataclass
class Profiles:
    """Languages in order, and the bundle of each."""

    languages: list[str]
    vectors: np.ndarray

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (0 at least) of each text; the first of equal ones wins."""
        score = np.zeros(len(texts))
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), score
        vectors = bundle(texts, self.vectors.shape[1])
        length = _lengths(vectors)
        units = self.vectors / _lengths(self.vectors)[:, None]
        cosines = vectors @ units.T / np.where(length > 0, length, 1)[:, None]
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, length)], score


def fold(doc_id: Column) -> Column:
    """Remainder that tells held-out rows; a NULL doc_id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


def fit(docs: DataFrame) -> Profiles:
    """Profiles from ``text`` and ``lang`` of all rows outside the held-out fold.

    Rows whose language is NULL or whose text has no letter teach nothing. A task sums
    its rows per language, the sums of tasks are added by place; the driver gets
    languages x DIMENSIONS numbers, whatever the number of rows.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & (fold(F.col("doc_id")) != HELD_OUT)).select("text", "lang")

    def sums(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed():
            for lang, total in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                     pa.array(total)], ["lang", "place", "s"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            vectors = bundle(texts_of(batch))
            length = _lengths(vectors)
            some = np.flatnonzero(length)
            steps = np.rint(vectors[some] * (SCALE / length[some])[:, None]).astype(np.int64)
            for lang in sorted({langs[k] for k in some}):
                rows = steps[[langs[k] == lang for k in some]].sum(0)
                held[lang] = held.get(lang, 0) + rows
                if len(held) >= HELD_LANGUAGES:
                    yield from handed()
        yield from handed()

    parts = taught.mapInArrow(sums, "lang string, place int, s bigint")
    totals: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "place").agg(F.sum("s").alias("s")).collect():
        totals.setdefault(row.lang, np.zeros(DIMENSIONS, np.int64))[row.place] = row.s
    languages = sorted(k for k, v in totals.items() if v.any())
    return Profiles(languages, np.array([totals[k] for k in languages]).reshape(-1, DIMENSIONS))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row, repeated ones too.

    A NULL text and one without a letter are ``und`` with score 0, and so is every text
    where nothing was learned. Texts of any length are read whole. Other columns
    are ignored, whatever their names.
    """
    def make():
        def convert(batch):
            langs, score = profiles.judge(texts_of(batch))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"])
        return convert

    kind = dict(docs.dtypes)["doc_id"]
    return in_arrow(docs.select("doc_id", "text"), make,
                    f"doc_id {kind}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
