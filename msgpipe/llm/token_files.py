"""Token ids as raw binary shards, with a minimal perfect hash index over document keys.

Shard files hold nothing but ids, little-endian, in ascending doc_id order. The index
maps a document key to its place in constant time: a minimal perfect hash function
(BBHash, Limasset et al., 2017) gives the key's slot in a table of fixed-size entries
(fingerprint, shard, offset, length); the fingerprint tells keys that were never stored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgpipe.llm.common import stage, table
from msgpipe.session import new_staging_path

END_ID = 1
#: Keys of one index part, about: its build holds them all in one task.
PART_KEYS = 100_000
#: Size of each level's bit table against its keys.
GAMMA = 2.0
#: Keys that still collide after so many levels are listed with their hashes.
LEVELS = 40
#: Entries of a worker's caches of words and of pieces of words (two generations of this many).
CACHE, PIECES = 500_000, 250_000
#: A normaliser and cut whose effect on words of printable ASCII and Latin-1 letters is known.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                {"type": "Lowercase"}]
_CUTS = [
    {"type": "Split", "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Lower-case letters of such words, and the pieces that the cut makes of them.
_LOWER = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_LOWER}0-9]+")
#: All their characters but the bracket that special tokens hold, and whole texts of them.
_KNOWN = "!-;=-~À-ÖØ-öø-ÿ"
_WORD, _TEXT = re.compile(rf"[{_KNOWN}]+"), re.compile(rf"[ \n{_KNOWN}]*")

ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def _open(path: str):
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Write under another name, then rename: a retried task replaces its own file whole."""
    files, place = _open(path)
    other = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(other) as out:
        out.write(data)
    files.move(other, place)


def read_file(path: str) -> bytes:
    files, place = _open(path)
    with files.open_input_stream(place) as f:
        return f.read()


class _Kept(dict):
    """Values made when they are first asked for; those of long ago go."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.aged = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.aged.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def turn(self) -> None:
        if len(self) > self.size:
            self.aged = dict(self)
            self.clear()


class WordBPE:
    """The tokenizers library behind a cache of words.

    The tokenizer treats text between spaces on its own, so a word has the same ids
    wherever it stands, and only words not seen lately reach the library. If the tokenizer
    lower-cases and cuts words in the way of ``_NORMALIZERS`` and ``_CUTS``, common words are
    cut here and only pieces not seen lately go to the library's model: a word with another
    capital letter or comma is not encoded again. All other words go to it as they are.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.words = _Kept(self._word, CACHE)
        self.pieces = _Kept(self._piece, PIECES)
        self.cuts = self._cuts()
        if self.cuts:
            self.model = self.tokenizer.model
            self.written = {code: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(code))[0][0]
                            for code in range(0xDF, 0x100) if code != 0xF7}

    def _cuts(self) -> bool:
        """Whether the tokenizer cuts words as ``_PIECE`` does."""
        config = json.loads(self.tokenizer.to_str())
        steps = [(config[name] or {}).get(list_) for name, list_ in (
            ("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        special = self.tokenizer.get_added_tokens_decoder().values()
        return (steps == [_NORMALIZERS, _CUTS] and config["model"]["type"] == "BPE"
                and not config["truncation"] and not config["padding"]
                and all("<" in t.content for t in special))

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.written))
        return np.array([t.id for t in found], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if self.cuts and _WORD.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word.lower())))
        found = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)
        return np.array(found[0].ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Raw ids of each text, the end id last."""
        self.words.turn()
        self.pieces.turn()
        end = np.array([END_ID], self.dtype).tobytes()
        found, ids = [], self.words.__getitem__
        for text in texts:
            if self.cuts and _TEXT.fullmatch(text):
                text = text.lower()
            found.append(b"".join(map(ids, text.replace("\n", " ").split(" "))) + end)
        return found


@lru_cache(maxsize=2)
def word_bpe(tokenizer_file: str) -> WordBPE:
    return WordBPE(tokenizer_file)


def _mix(value: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    value = value + np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0xD1342543DE82EF95 + 1) & (1 << 64) - 1)
    return (_mix(hashes ^ seed) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over different 64-bit hashes; keys it cannot part are listed."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.r_[0, np.cumsum(bits)]
        self.base = np.r_[0, np.cumsum(sizes)].astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, tables = [], []
        left = hashes
        while len(left) and len(sizes) < LEVELS:
            size = max(1, int(GAMMA * len(left)))
            slot = _slots(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            tables.append(alone)
            left = left[~alone[slot]]
        bits = np.concatenate(tables) if tables else np.zeros(0, bool)
        return cls(sizes, bits, np.sort(left))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, from 0 to the number of keys less one; -1 if surely no key."""
        slot = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + _slots(hashes[open_], level, size)
            hit = self.bits[at]
            slot[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.searchsorted(self.rest, hashes[open_])
            same = self.rest[np.minimum(at, len(self.rest) - 1)] == hashes[open_]
            slot[open_[same]] = self.before[-1] + at[same]
        return slot

    def dump(self) -> bytes:
        head = json.dumps({"sizes": self.sizes, "rest": len(self.rest)}).encode()
        return (len(head).to_bytes(8, "little") + head + np.packbits(self.bits).tobytes()
                + self.rest.astype("<u8").tobytes())

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The function, and how many bytes it took."""
        at = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:at])
        total = sum(head["sizes"])
        octets = np.frombuffer(data, np.uint8, (total + 7) // 8, at)
        at += len(octets)
        rest = np.frombuffer(data, "<u8", head["rest"], at)
        return cls(head["sizes"], np.unpackbits(octets, count=total).astype(bool), rest), \
            at + rest.nbytes


def _key_columns(key, occurrence):
    """Two independent hashes of a document key, NULL included, and of which of its rows is meant."""
    return (F.xxhash64(key, occurrence).alias("h"),
            F.hash(occurrence, key).alias("mark"))


class TokenFiles:
    """A folder of id shards, their index and the list of shards."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def shards(self) -> DataFrame:
        """(shard, first, n_tokens): ids before each shard, and in it."""
        return self.spark.read.parquet(f"{self.folder}/shards")

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_file: str, folder: str) -> TokenFiles:
        """Encode whole texts and write them in ascending doc_id order.

        NULL and empty texts are the end id alone. Rows of one doc_id lie together,
        each as an occurrence of it; a NULL doc_id comes first. Other columns are
        ignored, an empty table gives no shard. Only doc_id and text are shuffled, by
        ranges of doc_id; a shard is written as its batches arrive.
        """
        spark = docs.sparkSession
        kind = docs.schema["doc_id"].dataType.simpleString()
        ordered = (
            docs.select("doc_id", "text").repartitionByRange("doc_id")
            .sortWithinPartitions("doc_id", F.xxhash64("text"))
        )
        schema = f"doc_id {kind}, occurrence int, shard int, start bigint, n_tokens bigint"

        def run(batches):
            from pyspark import TaskContext

            model = word_bpe(tokenizer_file)
            shard = TaskContext.get().partitionId()
            files, place = _open(f"{folder}/shard-{shard:06d}.ids")
            other, out, at, last, seen = f"{place}.{uuid.uuid4().hex}", None, 0, place, 0
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                raw = model.encode(texts)
                out = out or files.open_output_stream(other)
                out.write(b"".join(raw))
                keys, starts, counts, times = batch.column("doc_id"), [], [], []
                for key, data in zip(keys.to_pylist(), raw, strict=True):
                    seen, last = seen + 1 if key == last else 0, key
                    n = len(data) // model.dtype.itemsize
                    times.append(seen)
                    starts.append(at)
                    counts.append(n)
                    at += n
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(times, pa.int32()),
                    pa.array([shard] * len(raw), pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64())],
                    ["doc_id", "occurrence", "shard", "start", "n_tokens"])
            if out:
                out.close()
                files.move(other, place)

        files, place = _open(folder)
        files.create_dir(place, recursive=True)
        places = stage(ordered.mapInArrow(run, schema), "token-places")
        width = word_bpe(tokenizer_file).dtype.itemsize
        sizes = places.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        sizes.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"),
                     "n_tokens").write.parquet(f"{folder}/shards")
        cls._write_index(places, folder)
        parts = 1 + places.count() // PART_KEYS
        write_file(f"{folder}/format.json", json.dumps(
            {"width": width, "end_id": END_ID, "parts": parts}).encode())
        return cls(spark, folder)

    @staticmethod
    def _write_index(places: DataFrame, folder: str) -> None:
        """One index part per hash range of keys, each built in a task of bounded size."""
        parts = 1 + places.count() // PART_KEYS
        keyed = places.select(
            *_key_columns(F.col("doc_id"), F.col("occurrence")), "shard", "start", "n_tokens",
        ).withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)))

        def build(part: pa.Table) -> pa.Table:
            number = part.column("part")[0].as_py()
            columns = {n: part.column(n).to_numpy() for n in ("h", "mark", "shard", "start",
                                                             "n_tokens")}
            hashes = columns["h"].view(np.uint64)
            function = PerfectHash.build(hashes)
            slot = function.lookup(hashes)
            entries = np.zeros(len(hashes), ENTRY)
            entries["fingerprint"][slot] = columns["mark"].view(np.uint32)
            for name, column in (("shard", "shard"), ("offset", "start"), ("n", "n_tokens")):
                entries[name][slot] = columns[column]
            write_file(f"{folder}/index-{number:06d}.mph", function.dump() + entries.tobytes())
            return pa.table({"part": [number], "keys": [len(hashes)]})

        written = keyed.groupBy("part").applyInArrow(build, "part bigint, keys bigint")
        written.write.parquet(f"{folder}/index")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, occurrence, shard, start, n_tokens) of keys (doc_id, occurrence) by the index.

        Keys that are not stored have no row.
        """
        folder = self.folder
        parts = json.loads(read_file(f"{folder}/format.json"))["parts"]
        kind = keys.schema["doc_id"].dataType.simpleString()
        wanted = keys.select(
            "doc_id", "occurrence", *_key_columns(F.col("doc_id"), F.col("occurrence")),
        ).withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)))

        def look(part: pa.Table) -> pa.Table:
            data = read_file(f"{folder}/index-{part.column('part')[0].as_py():06d}.mph")
            function, at = PerfectHash.load(data)
            entries = np.frombuffer(data, ENTRY, -1, at)
            slot = function.lookup(part.column("h").to_numpy().view(np.uint64))
            mark = part.column("mark").to_numpy().view(np.uint32)
            good = slot >= 0
            good[good] = entries["fingerprint"][slot[good]] == mark[good]
            found = entries[slot[good]]
            return pa.table({
                **{n: part.column(n).filter(pa.array(good)) for n in ("doc_id", "occurrence")},
                "shard": found["shard"].astype(np.int32), "start": found["offset"].astype(np.int64),
                "n_tokens": found["n"].astype(np.int64)})

        return wanted.groupBy("part").applyInArrow(look, (
            f"doc_id {kind}, occurrence int, shard int, start bigint, n_tokens bigint"))

    def read(self, places: DataFrame) -> DataFrame:
        """Places with their ids: (doc_id, occurrence, shard, start, n_tokens, ids), shard by shard."""
        return self._each(places, "ids array<bigint>", lambda ids: pa.array(
            [i.astype(np.int64) for i in ids], pa.list_(pa.int64())))

    def checksums(self, places: DataFrame) -> DataFrame:
        """As ``read``, with the crc32 of the ids as unsigned 32-bit integers in their place."""
        return self._each(places, "ids_crc32 bigint", lambda ids: pa.array(
            [crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()))

    def _each(self, places: DataFrame, column: str, make) -> DataFrame:
        folder = self.folder
        width = json.loads(read_file(f"{folder}/format.json"))["width"]
        kind = places.schema["doc_id"].dataType.simpleString()
        names = ["doc_id", "occurrence", "shard", "start", "n_tokens"]

        def run(batches):
            opened, number = None, None
            for batch in batches:
                ids = []
                for shard, start, n in zip(*(batch.column(c).to_pylist() for c in names[2:]),
                                           strict=True):
                    if shard != number:
                        if opened:
                            opened.close()
                        files, place = _open(f"{folder}/shard-{shard:06d}.ids")
                        opened, number = files.open_input_file(place), shard
                    opened.seek(start * width)
                    ids.append(np.frombuffer(opened.read(n * width), f"<u{width}"))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), make(ids)], [*names, column.split()[0]])
            if opened:
                opened.close()

        nearby = places.select(*names).repartition("shard", F.floor(
            F.col("start") / (1 << 24))).sortWithinPartitions("shard", "start")
        return nearby.mapInArrow(run, (
            f"doc_id {kind}, occurrence int, shard int, start bigint, n_tokens bigint, {column}"))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files by the index."""
    docs = table(spark, sf_dir, "documents")
    stored = TokenFiles.write(docs, default_tokenizer(), new_staging_path(spark, "token-files"))
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    keys = counted.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence"))
    found = stored.checksums(stored.locate(keys))
    return found.join(F.broadcast(stored.shards), "shard").select(
        "doc_id", (F.col("first") + F.col("start")).alias("start"),
        found["n_tokens"], "ids_crc32")
