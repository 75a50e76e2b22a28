"""Language profiles, importance resampling and vector codes against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgpipe.llm import language_id, resampling, vector_codes

SF = "/root/testdata/sf0.001"
LONG = "the long and winding road of many words " * 5000
DOCS = "doc_id bigint, text string, lang string, score string, rank string, name string, n int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "n", 1) for r in rows], DOCS)


# Language identification

def _plain_bundle(text, size):
    """One n-gram after the other, letter by letter."""
    total = np.zeros(size, np.int64)
    for word in re.findall(r"[^\W\d_]+", text):
        letters = [0, *(ord(c.lower()[0]) for c in word), 0]
        for k in range(len(letters) - 2):
            vector = np.ones(size, np.int64)
            for place, code in enumerate(letters[k:k + 3]):
                vector *= np.roll(language_id.letter_vector(code, size).astype(np.int64), 2 - place)
            total += vector
    return total


def test_bundle_is_the_sum_of_bound_letters():
    texts = ["", "a", "Ab ab", "12 ! 34", "wörter, Ünd überall", "漢字 かな", "x" * 300, "a1b_c",
             "ends with space ", "\0nul\0inside"]
    got = language_id.bundle(texts, 256)
    for row, text in zip(got, texts, strict=True):
        assert (row == _plain_bundle(text, 256)).all(), text


def test_bundle_does_not_depend_on_blocks(monkeypatch):
    texts = [f"some text number {k} " * (k % 7) for k in range(40)]
    whole = language_id.bundle(texts, 128)
    monkeypatch.setattr(language_id, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(language_id, "BLOCK_GRAMS", 5)
    assert (language_id.bundle(texts, 128) == whole).all()


def test_letter_vectors_are_nearly_orthogonal():
    vectors = np.stack([language_id.letter_vector(c, 2048).astype(int) for c in range(97, 123)])
    products = vectors @ vectors.T / 2048
    assert np.abs(products - np.eye(26)).max() < 0.12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).join(
        docs.select("doc_id", "lang"), "doc_id").where(
        language_id.fold(F.col("doc_id")) == language_id.HELD_OUT).collect()
    assert len(found) > 300
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_rows_teach_nothing(spark):
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 3 == 1)
    taught = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 3 != 1)
    docs = _docs(spark, [(held, "secret words", "xx"), (taught, "plain words", "en"),
                         (taught + 0, "no language here", None), (None, "sans nom", "fr")])
    assert language_id.fit(docs).languages == ["en", "fr"]


def test_language_of_awkward_rows(spark):
    taught = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(taught[0], "the cat and the dog", "en"), (taught[1], "der Hund und die Katze", "de"),
            (taught[2], None, "en"), (taught[3], "", "de"), (taught[4], "12 34 !?", "de"),
            (taught[5], LONG, "en"), (None, "der und die", None), (taught[0], "the cat and the dog", "en")]
    docs = _docs(spark, rows)
    profiles = language_id.fit(docs)
    assert profiles.languages == ["de", "en"]
    got = language_id.identify(docs, profiles)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    assert Counter((r.doc_id, r.lang_pred) for r in got.collect()) == Counter([
        (taught[0], "en"), (taught[0], "en"), (taught[1], "de"), (taught[2], "und"),
        (taught[3], "und"), (taught[4], "und"), (taught[5], "en"), (None, "de")])
    nothing = language_id.fit(docs.limit(0))
    assert nothing.languages == []
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), profiles).count() == 0


def test_equal_profiles_take_the_first_language(spark):
    taught = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    docs = _docs(spark, [(taught[0], "same words", "zz"), (taught[1], "same words", "aa")])
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    assert {r.lang_pred for r in found} == {"aa"}
    assert all(r.score == pytest.approx(1.0) for r in found)


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text, low, high, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[k:k + n]) for n in range(low, high + 1)
            for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def _plain_resample(docs, target, *, low=1, high=1, buckets=10_000, least=20, percent=10):
    found = [(d, *_features(t, low, high, buckets)) for d, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in _features(x, low, high, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets)
                                          / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((n, d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long_enough = sorted((r for r in rows if r[0] >= least),
                         key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = percent * len(long_enough) // 100
    out = Counter((*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(long_enough))
    return out + Counter((*r[1:], None) for r in rows if r[0] < least)


def _got(frame):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in frame.collect())


def test_resampling_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [r.text for r in target.collect()]
    assert _got(resampling.resample(docs, target)) == _plain_resample(rows, items)
    pairs = resampling.Features(buckets=977, low=1, high=3)
    assert _got(resampling.resample(docs, target, features=pairs, percent=35, least_words=50)) == (
        _plain_resample(rows, items, low=1, high=3, buckets=977, least=50, percent=35))


def test_resampling_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "é 漢字 A_b " * 10), (5, LONG), (6, "same " * 30),
            (6, "same " * 30), (None, "nobody " * 25), (None, "nobody " * 25), (7, "Ä\u0085x " * 20)]
    docs = _docs(spark, [(*r, None) for r in rows])
    target = spark.createDataFrame([(1, "same road"), (2, None), (3, "")], "item_id int, text string")
    none = target.limit(0)
    for items, frame in ((["same road"], target), ([], none)):
        got = resampling.resample(docs, frame, percent=50)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert _got(got) == _plain_resample(rows, items, percent=50)
    assert resampling.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("run_rows, segment_rows", [(7, 5), (64, 100), (1000, 10), (3, 1000)])
def test_regular_sampling_gives_exact_ranks(spark, run_rows, segment_rows):
    """Many small runs and segments, a third of the rows equal, many ties."""
    rng = np.random.default_rng(run_rows)
    rows = [(None if k % 50 == 0 else int(rng.integers(40)) if k % 3 else 7, 1, 1,
             int(rng.integers(-5, 5)) if k % 3 else 2) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint")
    got = resampling.ranked(table.repartition(5), 40, run_rows, segment_rows).collect()
    order = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    want = Counter((*r, k + 1 if k < 240 else None) for k, r in enumerate(order))
    assert Counter(tuple(r) for r in got) == want


def test_segments_stay_near_their_share(spark):
    table = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("n_features"),
        F.lit(1).cast("bigint").alias("weight"), (F.xxhash64("id") % 1000).alias("score"))
    runs = resampling.sorted_runs(table.repartition(4), 1000)
    keys = resampling.splitters(runs, 20_000, 1000)
    sizes = [r.n for r in resampling.segments_of(runs, keys).groupBy("segment").agg(
        F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20
    assert max(sizes) < 3000


# Vector codes

def _plain_codes(rows, parts, entries, rounds):
    """Whole scans in Python integers' own arithmetic."""
    x = np.array([v for _, v in rows], np.int64)
    pieces = [x[:, p] for p in np.array_split(np.arange(x.shape[1]), parts)]
    books = [p[:entries].copy() for p in pieces]

    def scan(piece, book):
        d = ((piece[:, None, :] - book[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for piece, book in zip(pieces, books, strict=True):
            code, _d = scan(piece, book)
            for e in range(len(book)):
                if (code == e).any():
                    book[e] = piece[code == e].sum(0) // (code == e).sum()
    found = [scan(p, b) for p, b in zip(pieces, books, strict=True)]
    codes = ["".join(f"{c[k]:02x}" for c, _ in found) for k in range(len(x))]
    digest = hashlib.sha256(",".join(
        str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(i, c, int(sum(d[k] for _, d in found)), digest)
            for k, ((i, _), c) in enumerate(zip(rows, codes, strict=True))]


def _vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, lab, "c", 1) for i, v, lab in rows],
        "vec_id bigint, embedding array<double>, label int, code string, error int")


@pytest.mark.parametrize("size, parts, entries, rounds", [
    (16, 4, 16, 4), (10, 4, 8, 5), (3, 4, 4, 2), (8, 1, 32, 6), (8, 2, 256, 3)])
def test_codes_against_whole_scans(spark, size, parts, entries, rounds):
    rng = np.random.default_rng(size + entries)
    centres = rng.normal(size=(12, size))
    values = centres[rng.integers(12, size=400)] + rng.normal(scale=0.2, size=(400, size))
    values[200:260] = values[0]  # many equal vectors
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(values)]
    got = vector_codes.encode_vectors(_vectors(spark, rows).repartition(3), parts=parts,
                                      entries=entries, rounds=rounds)
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in rows]
    assert sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got.collect()) == (
        _plain_codes(whole, parts, entries, rounds))


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, size=(64, 8))
    x = centres[rng.integers(64, size=3000)] + rng.integers(-60, 60, size=(3000, 8))
    state = vector_codes.State.unknown(len(x), vector_codes.GROUPS)
    history, scans = [x[:64].copy()], []
    for _ in range(6):
        squared, measured = vector_codes.assign(x, state, history)
        d = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (state.code == d.argmin(1)).all() and (squared == d.min(1)).all()
        scans.append(measured)
        new = history[-1].copy()
        for e in range(64):
            if (state.code == e).any():
                new[e] = x[state.code == e].sum(0) // (state.code == e).sum()
        history.append(new)
    assert scans[0] == 3000 * vector_codes.GROUPS
    assert scans[-1] < scans[0] / 4


def test_net_displacement_is_used():
    """An entry that goes away and comes back has not moved: its old bound holds whole."""
    x = np.array([[0, 0]])
    near, far, away = [1, 0], [100, 0], [1000, 0]
    state = vector_codes.State.unknown(1, 2)
    books = [np.array([near, far]), np.array([near, away]), np.array([near, far])]
    assert vector_codes.assign(x, state, books[:1])[1] == 2
    assert vector_codes.assign(x, state, books)[1] == 0


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], None), (1, None, 1),
            (2, [nan, 1.0, 1.0, 1.0], 1), (3, [inf, 1.0, 1.0, 1.0], 1), (4, [None, 1.0, 1.0, 1.0], 1),
            (6, [0.0, 0.0, 0.0, 0.0], 1), (None, [9.0, 9.0, 9.0, 9.0], 1), (7, [-0.0001, 0.0, 0.0, 0.0], 2),
            (8, [], 2), (9, [0.5] * 6, 2)]
    got = vector_codes.with_label_error(vector_codes.encode_vectors(_vectors(spark, rows), entries=2))
    by_length = {4: [(5, rows[0][1]), (5, rows[0][1]), (6, rows[6][1]), (7, rows[8][1]),
                     (None, rows[7][1])], 6: [(9, [0.5] * 6)], 0: [(8, [])]}
    want = []
    for items in by_length.values():
        whole = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in items]
        want += _plain_codes(whole, 4, 2, 4)
    key = lambda r: tuple(map(str, r))
    rows_got = got.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in rows_got), key=key) == (
        sorted(want, key=key))
    sums = Counter()
    for r in rows_got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in rows_got)
    assert vector_codes.encode_vectors(_vectors(spark, rows[2:3])).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode_vectors(_vectors(spark, [(1, [1e12], 1)])).count()
