"""Benchmark decontamination with suffix arrays over shards of the training text.

Every Arrow batch of documents is a shard. Its words become numbers of the benchmark
vocabulary (0: not in it, so no match can cross it), and runs of known words that a window
fits in are kept. Their suffixes are sorted, and every benchmark suffix is looked up among them
by binary search: its neighbours there are its longest verbatim matches. Ranks of
prefixes of 1, 2, 4, ... words, which the sort leaves behind, tell how long a match is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from msgpipe.llm.common import sha256_hex, table, texts_of

WINDOW = 10
#: Words of benchmark text that are held at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 2_000_000

# Word bytes are 0-9, a-z (A-Z lower-cased) and all of non-ASCII characters.
_FOLD = bytes(c if c > 127 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32
              for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _starts_of(flags: np.ndarray) -> np.ndarray:
    """First places of the runs of True."""
    return np.flatnonzero(flags & ~np.r_[False, flags[:-1]])


class Benchmark:
    """Word numbers of one block of benchmark items [(item_id, text)]."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.item_ids, flat, item_of, place_of, starts = [], [], [], [], {}
        self.longest_item = 1
        for item_id, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            size, begin = min(window, len(ids)), len(flat)
            if ids:
                starts.setdefault(size, []).extend(range(begin, begin + len(ids) - size + 1))
            # Every item ends with a number of its own: no match crosses it.
            flat += [*ids, -1 - len(self.item_ids)]
            item_of += [len(self.item_ids)] * (len(ids) + 1)
            place_of += range(len(ids) + 1)
            self.item_ids.append(item_id)
            self.longest_item = max(self.longest_item, len(ids))
        self.flat, self.item_of, self.place_of = (
            np.array(x, np.int64) for x in (flat, item_of, place_of))
        #: (words, places of the windows of so many words)
        self.windows = [(size, np.array(x)) for size, x in sorted(starts.items())]


class SuffixArray:
    """Training words of a shard, sorted by suffix together with the benchmark's.

    ``ranks[k]`` orders all places by their first ``2**k`` words, the last one by more words than
    an item has. Training places come first, benchmark places from ``split`` on.
    """

    def __init__(self, training: np.ndarray, benchmark: Benchmark):
        self.split = len(training)
        flat = np.concatenate([training, benchmark.flat])
        self.ranks = [np.unique(flat, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(self.ranks) - 1) <= benchmark.longest_item:
            rank, span = self.ranks[-1], 1 << (len(self.ranks) - 1)
            after = np.concatenate([rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64)])
            self.ranks.append(np.unique(
                rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64))
        last = self.ranks[-1]
        own = np.flatnonzero(training > 0)
        self.training = own[np.argsort(last[own], kind="stable")]
        known = np.flatnonzero(benchmark.flat > 0) + self.split
        self.benchmark = known[np.argsort(last[known], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at the places ``a`` and ``b`` have in common."""
        total, size = np.zeros(len(a), np.int64), len(self.ranks[0])
        for k in reversed(range(len(self.ranks))):
            x, y = a + total, b + total
            inside = (x < size) & (y < size)
            same = inside & (self.ranks[k][np.minimum(x, size - 1)]
                             == self.ranks[k][np.minimum(y, size - 1)])
            total += same << k
        return total

    def longest(self, places: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place): the longest match of each place among sorted others, the first of equals.

        The neighbours of where a place would be sorted in have the longest common beginning.
        """
        last = self.ranks[-1]
        spot = np.searchsorted(last[among], last[places])
        best, where = np.zeros(len(places), np.int64), np.full(len(places), -1)
        for side in (spot - 1, spot):
            there = np.clip(side, 0, len(among) - 1)
            words = np.where((side >= 0) & (side < len(among)), self.common(places, among[there]), 0)
            better = words > best
            best[better], where[better] = words[better], among[there][better]
        return best, where

    def prefixes(self, places: np.ndarray, size: int) -> np.ndarray:
        """A number for the first ``size`` words at each place, the same for the same words."""
        k = size.bit_length() - 1
        rank, top = self.ranks[k], len(self.ranks[0])
        tail = np.minimum(places + size - (1 << k), top - 1)
        return rank[places] * top + rank[tail]


def _shard(benchmark: Benchmark, docs: list[list[bytes]]):
    """Training words that can be part of a match: (numbers, their places in the shard, bounds)."""
    get = benchmark.vocabulary.get
    ids = np.array([n for words in docs for n in (*(get(w, 0) for w in words), 0)], np.int64)
    bounds = np.r_[0, np.cumsum([len(words) + 1 for words in docs])].astype(np.int64)
    size = benchmark.windows[0][0] if benchmark.windows else 1
    known = np.r_[0, np.cumsum(ids != 0)]
    starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else []
    used = np.zeros(len(ids) + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, np.asarray(starts, np.int64) + size, -1)
    place = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    # Runs are parted by numbers that occur once, below those that end an item.
    gaps = np.flatnonzero(np.diff(place) > 1) + 1
    numbers = np.insert(ids[place], gaps, -1 - len(benchmark.item_ids) - np.arange(len(gaps)))
    place = np.insert(place, gaps, -1)
    return (np.append(numbers, -1 - len(benchmark.item_ids) - len(gaps)), np.append(place, -1),
            bounds, len(ids))


def search(benchmark: Benchmark, docs: list[list[bytes]]) -> tuple[list[dict | None], list[tuple]]:
    """(hits, matches): for each document its hit words, items, spans and longest match, or
    None; and for each benchmark suffix with a match its longest one in the shard as (item,
    item_start, n_words, document, start)."""
    out: list[dict | None] = [None] * len(docs)
    numbers, place, bounds, size = _shard(benchmark, docs)
    if not len(benchmark.windows) or not (numbers > 0).any():
        return out, []
    array = SuffixArray(numbers, benchmark)
    cover = np.zeros(size + 1, np.int64)
    items: dict[int, set] = {}
    for words, starts in benchmark.windows:
        keys = array.prefixes(starts + array.split, words)
        wanted, which = np.unique(keys, return_inverse=True)
        # A window of the training text lies within its run if its last word does.
        own = array.training[array.training + words <= len(numbers)]
        own = own[place[own + words - 1] == place[own] + words - 1]
        found = np.searchsorted(wanted, array.prefixes(own, words))
        hit = wanted[np.minimum(found, len(wanted) - 1)] == array.prefixes(own, words)
        own, found = place[own[hit]], found[hit]
        np.add.at(cover, own, 1)
        np.add.at(cover, own + words, -1)
        pairs = np.unique(np.stack([np.searchsorted(bounds, own, "right") - 1, found]), axis=1)
        owners: dict[int, set] = {}
        for key, start in zip(which.tolist(), starts.tolist(), strict=True):
            owners.setdefault(key, set()).add(int(benchmark.item_of[start]))
        for doc, key in pairs.T.tolist():
            items.setdefault(doc, set()).update(owners[key])
    suffixes, (length, where) = array.benchmark, array.longest(array.benchmark, array.training)
    matched = []
    for k in np.flatnonzero(length).tolist():
        at = int(suffixes[k]) - array.split
        start = int(place[where[k]])
        doc = int(np.searchsorted(bounds, start, "right")) - 1
        matched.append((benchmark.item_ids[benchmark.item_of[at]], int(benchmark.place_of[at]),
                        int(length[k]), doc, start - int(bounds[doc])))
    hit = np.cumsum(cover[:-1]) > 0
    position = np.full(size, -1)
    position[place[place >= 0]] = np.flatnonzero(place >= 0)
    for doc, found in items.items():
        begin, end = int(bounds[doc]), int(bounds[doc + 1])
        own = hit[begin:end]
        first, last = _starts_of(own), _starts_of(~own)
        stops = [int(last[np.searchsorted(last, s)]) for s in first]
        places = np.flatnonzero(own)
        words, there = array.longest(position[begin + places], array.benchmark)
        best = int(words.argmax())
        at = int(there[best]) - array.split
        out[doc] = {
            "n_hit": int(own.sum()), "items": {benchmark.item_ids[i] for i in found},
            "spans": [(int(s), e - int(s)) for s, e in zip(first, stops, strict=True)],
            "longest": (int(words[best]), int(places[best]),
                        benchmark.item_ids[benchmark.item_of[at]], int(benchmark.place_of[at])),
        }
    return out, matched


def _merged(parts: list[dict]) -> dict:
    """Hits of one document in several benchmark blocks as one."""
    spans: list[tuple[int, int]] = []
    for start, length in sorted(s for p in parts for s in p["spans"]):
        if spans and start <= sum(spans[-1]):
            spans[-1] = (spans[-1][0], max(sum(spans[-1]), start + length) - spans[-1][0])
        else:
            spans.append((start, length))
    return {"n_hit": sum(n for _, n in spans), "items": set().union(*(p["items"] for p in parts)),
            "spans": spans, "longest": max((p["longest"] for p in parts), key=lambda x: x[:2])}


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast blocks of benchmark items, each of about ``block_words`` words at most."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + size // (6 * block_words)
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(count))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast([tuple(r) for r in items.where(block == k).collect()])
            for k in range(count)]


def _searcher(blocks: list, window: int):
    """A function from texts to (word counts, hits); a lone block is prepared once."""
    ready = Benchmark(blocks[0].value, window) if len(blocks) == 1 else None

    def find(texts: list[str]):
        docs = [words_of(t) for t in texts]
        hits: list[list[dict]] = [[] for _ in docs]
        for block in blocks:
            found, _ = search(ready or Benchmark(block.value, window), docs)
            for own, hit in zip(hits, found, strict=True):
                if hit:
                    own.append(hit)
        return [len(d) for d in docs], [_merged(h) if h else None for h in hits]

    return find


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, longest.

    ``items`` are the ids of the items with occurring windows, ``spans`` the hit words
    (start, n_words) and ``longest`` the longest verbatim match (n_words, start,
    item_id, item_start), NULL without hits. NULL and empty texts have no words, on
    either side. Repeated rows are judged alike, each on its own row; items with a
    NULL id mark words but are not listed. Other columns are ignored. Nothing is
    shuffled: the benchmark is sent to the tasks in blocks of bounded size.
    """
    blocks = _blocks(benchmark, window, block_words)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    item = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = (f"doc_id {doc_type}, n_words bigint, n_hit bigint, items array<{item_type}>, "
              "spans array<struct<start:bigint,n_words:bigint>>, "
              f"longest struct<n_words:bigint,start:bigint,item_id:{item_type},item_start:bigint>")

    def run(batches):
        find = _searcher(blocks, window)
        for batch in batches:
            counts, hits = find(texts_of(batch))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
            listed = [sorted(i for i in h["items"] if i is not None) if h else [] for h in hits]
            best = [dict(zip(("n_words", "start", "item_id", "item_start"), h["longest"],
                             strict=True)) if h else None for h in hits]
            places = [[{"start": s, "n_words": n} for s, n in h["spans"]] if h else []
                      for h in hits]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array([h["n_hit"] if h else 0 for h in hits], pa.int64()),
                pa.array(listed, pa.list_(item)), pa.array(places, spans),
                pa.array(best, pa.struct([("n_words", pa.int64()), ("start", pa.int64()),
                                          ("item_id", item), ("item_start", pa.int64())])),
            ], ["doc_id", "n_words", "n_hit", "items", "spans", "longest"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, item_start, n_words, doc_id, start): for every place of every benchmark item
    the longest verbatim match of the words from there in all of ``docs``, and where it is.

    Only matches that hold a window of the item's block (of its smallest size) are looked for
    and those of fewer than ``least`` words left out. Of equally long ones the smallest doc_id and
    start count. Items with the same id are one. Each shard sends one row per place at most; they are
    reduced by place.
    """
    blocks = _blocks(benchmark, WINDOW, block_words)
    types = {"item_id": benchmark.schema["item_id"].dataType, "doc_id": docs.schema["doc_id"].dataType}

    def run(batches):
        for batch in batches:
            texts, keys = texts_of(batch), batch.column("doc_id").to_pylist()
            words = [words_of(t) for t in texts]
            for block in blocks:
                found = [(i, at, n, keys[doc], start) for i, at, n, doc, start in
                         search(Benchmark(block.value, WINDOW), words)[1] if n >= least]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], to_arrow_type(types["item_id"])),
                    pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], to_arrow_type(types["doc_id"])),
                    pa.array(columns[4], pa.int64())],
                    ["item_id", "item_start", "n_words", "doc_id", "start"])

    rows = docs.select("doc_id", "text").mapInArrow(run, (
        f"item_id {types['item_id'].simpleString()}, item_start bigint, n_words bigint, "
        f"doc_id {types['doc_id'].simpleString()}, start bigint"))
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "start")).alias("best")
    return rows.groupBy("item_id", "item_start").agg(best).select(
        "item_id", "item_start", (-F.col("best.less")).alias("n_words"), "best.doc_id", "best.start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, all columns unchanged and nothing shuffled."""
    blocks = _blocks(benchmark, window, BLOCK_WORDS)

    def run(batches):
        find = _searcher(blocks, window)
        for batch in batches:
            yield batch.filter(pa.array([h is None for h in find(texts_of(batch))[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join(names, ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
