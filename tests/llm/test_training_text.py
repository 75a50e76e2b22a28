"""Each operator against a plain version on small, awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgpipe.llm import (
    decontaminate,
    embeddings,
    line_dedup,
    paragraphs,
    personal_data,
    piece_bpe,
    simhash,
    token_files,
    toxicity,
    url_rules,
)
from msgpipe.llm.common import components

LONG = "word salad of many parts " * 4000
TEXTS = [None, "", " ", LONG, "a b c", "A  b\nC", "same text here again", "same text here again",
         "é 漢字 😀", "x" * 3000, " " * 500 + "end"]
SCHEMA = "doc_id bigint, text string, ids string, score string, gone string, h bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "i", "s", "g", k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {k: c for k, c in enumerate(_classes(60, edges)) if any(
        a != b and k in (a, b) for a, b in edges)}


def test_simhash(spark, docs, nothing):
    random.seed(2)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(random.choice(words) for _ in range(60)) for _ in range(8)]
    for k in range(30):
        parts = texts[k % 8].split()
        parts[random.randrange(60)] = "new"
        texts.append(" ".join(parts))
    rows = spark.createDataFrame(list(enumerate(TEXTS + texts)), "doc_id bigint, text string")
    prints = [simhash.fingerprint(t or "") for t in TEXTS + texts]
    links = [(a, b) for a in range(len(prints)) for b in range(a)
             if (prints[a] ^ prints[b]).bit_count() <= 4]
    got = {r.doc_id: r.component_id for r in simhash.simhash_classes(rows).collect()}
    assert got == dict(enumerate(_classes(len(prints), links)))
    assert got[0] == got[1] == got[2] == 0
    assert simhash.simhash_classes(docs).count() == len(TEXTS) + 1
    assert simhash.simhash_classes(nothing).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 0


def test_simhash_lookups_are_not_broadcast(spark):
    """Spark takes the exploded sides for as small as the table they come from."""
    rows = spark.createDataFrame([(k * 7919,) for k in range(50)], "fp bigint")
    plan = simhash.links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("block_words", [2_000_000, 1])
def test_decontamination(spark, nothing, block_words):
    random.seed(3)
    texts = ["".join(random.choice("ab ,.") for _ in range(90)) for _ in range(40)] + TEXTS
    items = [(f"i{k}", " ".join(random.choice("ab") for _ in range(n)))
             for k, n in enumerate((12, 11, 10, 4, 5, 30))] + [("none", None), ("empty", "")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame([*items, items[0]], "item_id string, text string")
    got = {r.doc_id: r for r in
           decontaminate.matches(rows, bench, block_words=block_words).collect()}
    for k, text in enumerate(texts):
        words, hit, found = _words(text), set(), set()
        for name, item in items:
            own = _words(item)
            size = min(10, len(own))
            windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else ()
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(name)
        assert (got[k].n_words, got[k].n_hit, got[k].items) == (
            len(words), len(hit), sorted(found))
        assert sum(s.n_words for s in got[k].spans) == len(hit)
        if hit:
            best = got[k].longest
            own = _words(dict(items)[best.item_id])
            assert words[best.start:best.start + best.n_words] == own[
                best.item_start:best.item_start + best.n_words]
    kept = {r.doc_id for r in decontaminate.drop_contaminated(rows, bench).collect()}
    assert kept == {k for k in got if not got[k].n_hit}
    assert decontaminate.matches(nothing, bench).count() == 0


def test_every_longest_match(spark):
    """Every suffix of every item against every place of every document, word by word."""
    random.seed(11)
    texts = [" ".join(random.choice("abcx") for _ in range(random.randint(0, 60))) for _ in range(25)]
    items = [(k, " ".join(random.choice("abc") for _ in range(n))) for k, n in enumerate((14, 12, 25))]
    texts[3] += " " + items[2][1]
    rows = spark.createDataFrame([*enumerate(texts), (None, "a b c")], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    least = 10

    def common(x, y):
        return next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    want = {}
    for item, text in items:
        own = text.split()
        for at in range(len(own)):
            found = [(-common(own[at:], t.split()[start:]), doc, start)
                     for doc, t in enumerate(texts) for start in range(len(t.split()))]
            n, doc, start = min(found)
            if -n >= least:
                want[item, at] = (-n, doc, start)
    got = {(r.item_id, r.item_start): (r.n_words, r.doc_id, r.start)
           for r in decontaminate.longest_matches(rows.repartition(3), bench, least).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) >= 16
    for (item, at), (n, doc, start) in got.items():
        assert texts[doc].split()[start:start + n] == items[item][1].split()[at:at + n]


def test_pieces(spark, docs, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = piece_bpe.default_model()
    known = sentencepiece.SentencePieceProcessor(model_file=model)
    random.seed(4)
    texts = [t or "" for t in TEXTS] + ["".join(
        random.choice("ab  theing▁\n=-é漢😀/0 ") for _ in range(50)) for _ in range(300)] + [
        "".join(random.choice("=-/ *▁ae") * random.randint(1, 9) for _ in range(60))
        for _ in range(200)] + ["<s></s><0x41>"]
    own = piece_bpe.PieceBPE(model)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == known.encode(text) + [2]
        assert own.decode(ids.tolist()) == known.decode(ids.tolist())
    for _ in range(500):
        ids = random.choices([0, 1, 2, 5, 13, 191, 233, 165, 259, 400], k=6)
        assert own.decode(ids) == known.decode(ids)
    assert piece_bpe.encode_pieces(docs, model).where("doc_id = 0").first().ids == [2]
    assert piece_bpe.piece_digests(nothing, model).count() == 0


def test_token_files(spark, docs, nothing, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    name = token_files.default_tokenizer()
    whole = tokenizers.Tokenizer.from_file(name)
    odd = ["it's <|endoftext|> x", "\x1c a\x1db \x85c", "İstanbul ΑΣ ẞ", "e\u0301 \u0301x"]
    own = token_files.WordBPE(name)
    for text, raw in zip(odd, own.encode(odd), strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == whole.encode(
            text, add_special_tokens=False).ids + [1]
    stored = token_files.TokenFiles.write(docs, name, str(tmp_path / "ids"))
    keys = docs.select("doc_id").distinct().withColumn("occurrence", F.lit(0)).unionByName(
        spark.createDataFrame([(4, 1), (4, 2), (99, 0)], "doc_id bigint, occurrence int"))
    got = {(r.doc_id, r.occurrence): r for r in stored.read(stored.locate(keys)).collect()}
    assert set(got) == {(k, 0) for k in range(len(TEXTS))} | {(4, 1)}
    sums = {(r.doc_id, r.occurrence): r.ids_crc32
            for r in stored.checksums(stored.locate(keys)).collect()}
    for (k, time), row in got.items():
        ids = whole.encode(TEXTS[k] or "", add_special_tokens=False).ids + [1]
        assert row.ids == ids
        assert sums[k, time] == zlib.crc32(np.array(ids, "<u4").tobytes())
    empty = token_files.TokenFiles.write(nothing, name, str(tmp_path / "none"))
    assert empty.locate(keys).count() == 0 if (tmp_path / "none" / "index-000000.mph").exists() \
        else empty.shards.count() == 0


def test_known_words_are_cut_without_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    name = token_files.default_tokenizer()
    whole = tokenizers.Tokenizer.from_file(name)
    rng = random.Random(5)
    letters = [*map(chr, [*range(1, 0x180), 0x301, 0x130, 0x3A3, 0x2003])] + [
        *"'sdtrvml <" * 8, "<|endoftext|>", "<|ENDOFTEXT|>", "'RE", "'ll"]
    odd = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    common = ["We'LL go, wE'll; GO! 2024 x'd", "Été l'ÉTÉ: ß ÿ.\n\nFin? \"fin\""]
    own = token_files.WordBPE(name)

    def expected(texts):
        return [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]

    def ids(texts):
        return [np.frombuffer(raw, own.dtype).tolist() for raw in own.encode(texts)]

    assert ids(odd) == expected(odd)
    own.tokenizer = None
    assert ids(common) == expected(common)


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    function, _ = token_files.PerfectHash.load(token_files.PerfectHash.build(keys).dump())
    assert sorted(function.lookup(keys).tolist()) == list(range(len(keys)))
    same = token_files.PerfectHash.build(np.array([7, 7, 8], np.uint64))
    assert sorted(same.lookup(np.array([7, 8], np.uint64)).tolist())[0] >= 0


def test_embeddings(spark):
    random.seed(5)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(base[k % 12] + rng.normal(size=8) * 0.25).tolist() for k in range(120)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 8, [1.0] * 3,
             [float("nan")] * 8, [None] + [1.0] * 7]
    table = [(k, r, "x") for k, r in enumerate(rows)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, n string")

    def unit(r):
        good = r and all(x is not None and np.isfinite(x) for x in r) and any(r)
        return np.array(r) / np.linalg.norm(r) if good else None

    units = [unit(r) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None
             and units[b] is not None and len(units[a]) == len(units[b])
             and units[a] @ units[b] >= 0.9]
    counts = [sum(k in x for x in links) for k in range(len(rows))]
    size, embeddings.TILE = embeddings.TILE, 30
    try:
        got = {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}
    finally:
        embeddings.TILE = size
    assert [got[k].n_links for k in range(len(rows))] == counts
    assert [got[k].component_id for k in range(len(rows))] == _classes(len(rows), links)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _spans(text):
    return sorted((m.start(), n, m.end()) for n, kind in enumerate(_PLAIN)
                  for m in re.finditer(_PLAIN[kind], text or "") if _holds(kind, m[0]))


def test_personal_data(spark, docs, nothing):
    random.seed(6)
    parts = ["1", "22", "255", "256", "007", ".", ".", "@", "a", "b-c", "_", "+", " ", "-", "(",
             ")", "é", "😀", "\n", "4111 1111 1111 1111", "+1 (415) 555-2671", "jo@x.co", "1.2.3.4"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(400)]
    texts += ["1" * 3000, "a" * 3000 + "@", "a." * 3000 + "@x" + ".y" * 3000, "+1" + "(" * 3000,
              "1." * 3000, "jo@x.co " * 1500, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in personal_data.personal_data(rows).collect():
        base = [tuple(s) for s in r.base]
        assert base == _spans(texts[r.doc_id])
        assert set(base) <= {tuple(s) for s in r.spans}
    assert personal_data.personal_data(docs).count() == len(TEXTS) + 1
    assert personal_data.personal_data(nothing).count() == 0


def test_personal_data_learns_contexts(spark):
    """Identifiers of no base form are found beside words that stood beside known ones."""
    texts = [f"mail to person{k}@host.org please now" for k in range(60)]
    texts += [f"mail to person{k}(at)host please now" for k in range(2)] + ["room 12b is open"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(rows).collect()}
    assert [len(got[k]) for k in (0, 60, 61, 62)] == [1, 1, 1, 0]
    assert tuple(got[60][0]) == (8, 0, 8 + len("person0(at)host"))


@pytest.mark.parametrize("unseen", [10, 30, 50])
def test_personal_data_finds_many_unseen(spark, unseen):
    """Shares of identifiers of no base form beside the words of known ones; none where the
    same words stand beside other things as well."""
    texts = []
    for k in range(200):
        hidden = k % 100 < unseen
        texts.append(f"mail to person{k}{'(at)host' if hidden else '@host.org'} please now")
        texts.append(f"seat {k}b in row {k % 9}")
        texts.append(f"item no. {k}/7 costs much" if k % 10 else f"item no. x{k}@shop.org costs much")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal_data.personal_data(rows).collect()}
    for k in range(200):
        token = texts[3 * k].split()[2]
        assert got[3 * k] == [(8, 0, 8 + len(token))]
        assert got[3 * k + 1] == []
        assert len(got[3 * k + 2]) == (k % 10 == 0)


def test_personal_data_goes_on_until_nothing_is_new(spark):
    """Five contexts, each of which knows enough only when the one before it has been learnt."""
    left, right = ["".join(c * 3) for c in "abcdef"], ["".join(c * 3) for c in "uvwxyz"]
    texts = [f"{left[0]} id{k}@host.org {right[0]}" for k in range(30)]
    for step in range(5):
        for at in (step, step + 1):
            texts += [f"{left[at]} id{step}x{k}(at)h {right[at]}" for k in range(15)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = personal_data.personal_data(rows).collect()
    assert all(len(r.spans) == 1 for r in got), [texts[r.doc_id] for r in got if len(r.spans) != 1][:5]


def test_line_dedup(spark, docs, nothing):
    one = "The quick brown fox jumps over the lazy dog near river banks every single morning"
    rows = [(1, f"{one}\nshort one\nline of its own that nobody else has written", 10),
            (2, f"{one.upper()}!\nanother line which is only here and nowhere else", 10),
            (3, one, 10), (4, None, None), (5, "", 0), (None, one, 5)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert got[1] == rows[0][1] and got[None] == one and got[4] is None and got[5] == ""
    assert got[2] == "another line which is only here and nowhere else" and got[3] == ""
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) + 1
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_groups_are_verified(spark):
    """Linked lines are close by edit distance, and equal ones always meet."""
    random.seed(7)
    words = [f"word{k}" for k in range(300)]
    lines = [" ".join(random.choice(words) for _ in range(40)) for _ in range(20)]
    for k in range(60):
        parts = lines[k % 20].split()
        parts[random.randrange(40)] = "changed"
        lines.append(" ".join(parts))
    frame = spark.createDataFrame(list(enumerate(lines + lines[:5])), "doc_id int, text string")
    gone = {r.doc_id for r in line_dedup.removals(frame).collect()}
    assert set(range(80, 85)) <= gone and not gone & set(range(20))
    assert len(gone) > 20


def test_paragraphs(spark, docs, nothing):
    random.seed(8)
    words = [f"w{k}" for k in range(5000)]

    def text(n):
        return " ".join(random.choice(words) for _ in range(n))

    passage = text(60)
    changed = passage.split()
    changed[30] = "other"
    texts = [text(80) + "\n" + passage, passage + "\n" + text(50), text(300),
             text(90) + "\n" + " ".join(changed), text(70) + " " + passage + " " + text(200),
             None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = paragraphs.repeated_passages(frame).collect()
    assert {r.doc_id for r in found} >= {0, 1, 3} and 2 not in {r.doc_id for r in found}
    assert {r.doc_id for r in found if not r.removed} == {0}
    assert all(r.kept_doc_id == 0 for r in found)
    assert paragraphs.repeated_passages(nothing).count() == 0
    assert paragraphs.repeated_passages(docs).where("doc_id is null").count() == 0


def test_cuts_do_not_depend_on_the_surroundings():
    random.seed(9)
    words = [f"w{k}" for k in range(900)]
    inner = " ".join(random.choice(words) for _ in range(200))
    left = " ".join(random.choice(words) for _ in range(77))
    keys = [set(paragraphs.paragraphs_of([t])[3].tolist()) for t in (inner, f"{left} {inner}")]
    assert len(keys[0] & keys[1]) >= len(keys[0]) - 2


def test_toxicity(spark, docs, nothing):
    random.seed(10)
    clean = [f"term{k}" for k in range(200)]
    bad = ["idiot", "moron", "zorgle", "snarf"]
    rows, labels = [], []
    for k in range(600):
        words = [random.choice(clean) for _ in range(30)]
        toxic = k % 5 == 0
        if toxic:
            for place in random.sample(range(30), 3):
                words[place] = random.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (3, None)], "doc_id bigint, toxic int")
    fitted = toxicity.fit(frame, marks)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, fitted).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == labels[k][1] for k in held]) >= 0.97
    assert toxicity.toxicity_scores(docs, fitted).where("score < 0 or score > 1").count() == 0
    assert toxicity.drop_toxic(docs, fitted).columns == docs.columns
    unfitted = toxicity.fit(nothing, marks.limit(0))
    assert 0 <= unfitted.scores([""])[0] < 0.5


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(11)
    truth = rng.random(40_000) < 0.2
    rates = [(0.8, 0.05), (0.6, 0.02), (0.7, 0.1), (0.5, 0.01)]
    votes = np.column_stack([rng.random(len(truth)) < np.where(truth, a, b) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 0]]).astype(float)
    model = toxicity.LabelModel.fit(len(votes), votes.T @ votes, 0.2)
    assert np.abs(model.on_toxic[1:4] - [a for a, _ in rates[1:]]).max() < 0.15
    assert model.weight[0] < 0.7 and model.weight[4] < 0.7 < model.weight[1]
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.93


def test_url_rules(spark):
    rows = [(1, "http://A.B.net/?x=1"), (2, None), (3, "nope"), (4, "https://example.net/en/x#y"),
            (5, "https://sub.Example.COM/de/q?z"), (6, "ftp://org/fr/"), (7, "http://xnet/"),
            (8, "a://b://c/d"), (9, "http://example.net/en"), (10, "://"), (9, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    none = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict)
           for r in url_rules.judge_urls(pages, none).collect()}
    assert got == {
        (1, "a.b.net", "/", "net/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "example.net", "/en/x", "example.net/en/", "allow"),
        (5, "sub.example.com", "/de/q", "example.com/de/", "block"),
        (6, "org", "/fr/", "org/fr/", "allow"), (7, "xnet", "/", None, "allow"),
        (8, "b:", "//c/d", None, "allow"), (9, "example.net", "/en", "net/", "block"),
        (10, "", "", None, "allow"), (9, "net", "/", "net/", "block")}


def test_url_rules_are_mined(spark):
    rows = [(k, f"http://{'win.casino' if k % 6 == 0 else f'site{k % 7}.good'}.org/en/{k}")
            for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(200)],
                                   "doc_id int, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels).collect()}
    assert got == {k: "block" if k % 6 == 0 else "allow" for k in range(300)}


def test_url_rules_of_any_size_are_mined(spark):
    """Pages that only four tokens together mark as bad, and what a plain count says."""
    import itertools

    chance = random.Random(3)
    words = ("alpha", "beta", "gamma", "delta", "42")

    def page(k):
        have = [w for w in words if chance.random() < 0.7]
        return k, f"https://h{k % 3}.example.xyz/{'/'.join(have)}?q={k}", set(have)

    rows = [page(k) for k in range(900)]
    bad = {k for k, _, have in rows if {"alpha", "beta", "gamma", "42"} <= have}
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id int, url string")
    labels = spark.createDataFrame([(k, int(k not in bad), 0) for k in range(600)],
                                   "doc_id int, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels).collect()}
    assert got == {k: "block" if k in bad else "allow" for k, _, _ in rows}

    # Every set of words by plain counting: the kept ones are those without an equal part.
    def stats(part):
        on = [k for k, _, have in rows[:600] if set(part) <= have]
        return len(on), sum(k in bad for k in on)

    good = {}
    for n in range(1, 6):
        for part in itertools.combinations(words, n):
            support, hit = stats(part)
            if support >= 20 and hit / support >= 0.9:
                good[frozenset(part)] = hit / support
    want = {p for p, c in good.items() if not any(q < p and d >= c for q, d in good.items())}
    tokens = url_rules.url_tokens(F.col("url"), *url_rules.url_parts(F.col("url"))).alias("tokens")
    rules, _ = url_rules.mine(pages.where("page_id < 600").select(
        tokens, F.col("page_id").isin(sorted(bad)).alias("bad")))
    found = {frozenset(t.partition(":")[2] for t in r.tokens) for r in rules.collect()
             if all(t.startswith("path:") for t in r.tokens)}
    assert found == want == {frozenset({"alpha", "beta", "gamma", "42"})}


def test_url_rules_do_not_hang_on_the_number_of_rows(spark):
    """A rule on 30 pages lives among many rows as among few; long URLs and repeats do no harm."""
    rows = [(k, f"http://s{k % 50}.org/{'casino' if k < 30 else 'news'}/{k}") for k in range(20_000)]
    rows += [(20_000, "http://s1.org/casino/" + "x/" * 3000), (20_000, "http://s1.org/casino/")]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    labels = spark.range(20_000).select(
        F.col("id").cast("int").alias("doc_id"), (F.col("id") >= 30).cast("int").alias("quality"),
        F.lit(0).alias("toxic"))
    got = url_rules.judge_urls(pages, labels).where("verdict = 'block'").select("page_id")
    assert sorted(r[0] for r in got.collect()) == [*range(30), 20_000, 20_000]


def test_token_files_and_vectors_without_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "d"), (None, "a b")],
                                 "doc_id bigint, text string")
    stored = token_files.TokenFiles.write(docs, token_files.default_tokenizer(), str(tmp_path / "t"))
    keys = spark.createDataFrame([(None, 0), (None, 1), (None, 2), (None, 3), (3, 0)],
                                 "doc_id bigint, occurrence int")
    got = stored.read(stored.locate(keys)).collect()
    assert sorted((r.doc_id is None, r.occurrence) for r in got) == [
        (False, 0), (True, 0), (True, 1), (True, 2)]
    assert sorted(r.start for r in got if r.doc_id is None)[0] == 0
    frame = spark.createDataFrame(
        [(None, [1.0, 0.0]), (None, [2.0, 0.0]), (4, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.1])],
        "vec_id bigint, embedding array<double>")
    rows = embeddings.near_vectors(frame).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows) == [
        (0, 0, 0), (0, 1, 0), (0, 1, 0), (0, 1, 4), (4, 1, 4)]


def test_short_lines_of_one_edit_and_clashing_columns(spark):
    texts = ["abcdefg", "abcdefh", "abcdef", "abcd", "abce", "xyzzy", "xyzy", "12345678", "1234x5678"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], (
        f"doc_id bigint, text string, {line_dedup.KEPT} string, {line_dedup.REMOVED.upper()} int"))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    # abcdefg ~ abcdefh (6 of 7), abcdef ~ abcdefg (6 of 7), xyzzy ~ xyzy (4 of 5), 8 of 9.
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(
        ["abcdefg", "", "", "abcd", "abce", "xyzzy", "", "12345678", ""]))


def test_digest_is_of_the_text(spark):
    from msgpipe.llm.common import sha256_hex

    row = spark.createDataFrame([("é,1",)], "x string").select(sha256_hex(F.col("x"))).first()
    assert row[0] == hashlib.sha256("é,1".encode()).hexdigest()


def test_line_similarity_is_edit_similarity(spark):
    import random

    from msgpipe.llm.line_dedup import _similar

    chance = random.Random(5)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    rows = []
    for _ in range(150):
        x = "".join(chance.choice("abcd ") for _ in range(chance.randint(9, 60)))
        y = list(x)
        for _ in range(chance.randint(0, len(x) // 3)):
            at = chance.randrange(len(y) + 1)
            y[at:at + chance.randint(0, 1)] = chance.choice(["", "a", "b", "cd"])
        y = "".join(y)
        rows.append((x, y, distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9))
    found = spark.createDataFrame(rows, "x string, y string, want boolean").select(
        "want", _similar(F.col("x"), F.col("y")).alias("got")).collect()
    assert all(r.got == r.want for r in found)
    assert {r.want for r in found} == {True, False}


def test_line_fingerprints_are_majorities(spark):
    """Lines of fewer and more than 2**9 words have the bits of a plain version; widths agree."""
    import xxhash

    def plain(line):
        words = set(line.split())
        telling = {w for w in words if len(w) > line_dedup.SHORT} or words
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in telling]
        return sum(1 << bit for bit in range(63)
                   if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    sizes = (5, 6, 510, 511, 512, 513, 3000)
    texts = [" ".join(f"word{k}" for k in range(n)) for n in sizes]
    texts += ["a b c d e f", "a b c d e words", "again again again again again"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = line_dedup.fingerprints(line_dedup.lines_of(frame)).collect()
    assert {r.doc_id: r.fp for r in got} == {k: plain(t) for k, t in enumerate(texts)}

    hashes = F.array(*(F.xxhash64(F.lit(f"w{k}")) for k in range(7)))
    widths = spark.range(1).select(*(
        line_dedup._majority(hashes, w).alias(f"m{w}") for w in (9, 21, 63))).first()
    assert widths[0] == widths[1] == widths[2]


def _found_of(spark, pairs, more=()):
    """Numbers of the pairs whose second line goes, and of ``more`` lines that go as repeats."""
    # Substitutions keep the length, so the differing places bound the edit distance.
    assert all(a != b and sum(x != y for x, y in zip(a, b, strict=True)) <= 0.2 * len(a)
               for a, b in pairs)
    texts = [a for a, _ in pairs] + [*more] + [b for _, b in pairs] + [*more]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    gone = {r.doc_id for r in line_dedup.removals(frame).collect()}
    half = len(texts) // 2
    assert not gone & set(range(half))
    places = {k - half for k in gone}
    return places & set(range(len(pairs))), places - set(range(len(pairs)))


def test_line_recall(spark):
    """Nearly all pairs of lines of edit similarity 0.8 and more are found."""
    chance = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    for n, changed, count in ((10, 1, 60), (20, 2, 60), (40, 1, 40), (40, 2, 40), (80, 8, 30)):
        while count:
            line = ["".join(chance.choice(letters) for _ in range(chance.randint(2, 9)))
                    for _ in range(n)]
            other = list(line)
            for at in chance.sample(range(n), changed):
                other[at] = "".join(chance.choice(letters) for _ in other[at])
            a, b = " ".join(line), " ".join(other)
            if a != b and sum(x != y for x, y in zip(a, b, strict=True)) <= 0.2 * len(a):
                pairs.append((a, b))
                count -= 1
    found, _ = _found_of(spark, pairs)
    assert len(found) >= 0.98 * len(pairs)


def test_lines_of_every_length(spark):
    """Repeats of few words, lines without spaces and lines of over 4,000 characters are found."""
    chance = random.Random(12)

    def line(n):
        return [chr(0x4E00 + chance.randrange(3000)) for _ in range(n)]

    pairs = []
    for n in (20, 60, 200):
        for _ in range(20):
            a = line(n)
            b = list(a)
            for at in chance.sample(range(n), n // 20):
                b[at] = "\u3042"
            pairs.append(("".join(a), "".join(b)))
    a = [f"word{chance.randrange(1000, 10000)}" for _ in range(900)]
    b = list(a)
    for at in range(0, 900, 20):
        b[at] = "changed!"
    pairs.append((" ".join(a), " ".join(b)))
    more = ["All rights reserved.", "Ietzte.", "\u6f22\u5b57", "x"]
    found, repeats = _found_of(spark, pairs, more)
    assert len(repeats) == len(more)
    assert len(found) >= 0.98 * len(pairs) and len(pairs) - 1 in found


def test_passages_inside_lines_and_wrapped(spark):
    """Passages of 51 to 60 words are found to two words in the middle of lines and wrapped anew."""
    chance = random.Random(13)

    def text(n):
        return [f"v{chance.randrange(100000)}" for _ in range(n)]

    rows, want = [], {}
    for k in range(60):
        passage = text(51 + k % 10)
        a, b = text(30 + k), text(90)
        rows.append((k, " ".join(a + passage + text(50))))
        if k % 2:
            passage = " ".join(passage[:20]) + "\n" + " ".join(passage[20:])
            rows.append((100 + k, " ".join(b) + "\n" + passage + "\n" + " ".join(text(40))))
        else:
            rows.append((100 + k, " ".join(b + passage + text(40))))
        want[k], want[100 + k] = (len(a), 51 + k % 10), (len(b), 51 + k % 10)
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    found = paragraphs.repeated_passages(frame).collect()
    got = {r.doc_id: (r.start, r.start + r.n_words) for r in found}
    # Similar pieces may differ in a word at their ends.
    assert set(got) == set(want) and len(found) == len(want)
    assert all(abs(got[k][0] - start) <= 2 and abs(got[k][1] - start - n) <= 2
               for k, (start, n) in want.items())
    assert all(r.removed == (r.doc_id >= 100) for r in found)


def test_personal_data_learns_from_whole_spans(spark):
    """E-mails without digits and spaced phones are seeds as a whole, and found as a whole."""
    names = ["".join(p) for p in zip("abcdefghijklmnop" * 2, "qrstuvwxyzabcdef" * 2, strict=True)]
    texts = [f"write to {n}{k % 7 * 'x'}@example.com, please now" for k, n in enumerate(names)]
    texts += [f"call +1 (743) 555-{3800 + k} today or never" for k in range(30)]
    new = ["write to jo(at)example please now", "call 743 555 38 today or never"]
    rows = spark.createDataFrame(list(enumerate(texts + new)), "doc_id int, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans]
           for r in personal_data.personal_data(rows).collect()}
    assert got[len(texts)] == [(9, 0, 9 + len("jo(at)example"))]
    assert got[len(texts) + 1] == [(5, 3, 5 + len("743 555 38"))]
