"""Which keys a store holds: key files by hash bucket, and a Bloom filter for each bucket.

A batch asks the filters first. Keys they have never seen are new; only the buckets
of the other keys are read. A filter is a table of blocks of four 64-bit words; a key sets two
bits in each word of one block, so one row answers for it and the answer is a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.session import remove, stage

# Buckets of a new index, and keys of a bucket above which there are more of them.
BUCKETS = 16
BUCKET_KEYS = 1 << 20
# How many times as many buckets a growing index gets.
GROWTH = 4
# Keys that share a block: 16 bits a key.
BLOCK_KEYS = 16
WORDS = ("w0", "w1", "w2", "w3")
# Buckets named in a scan's partition filter; more are pruned by the join alone.
NAMED_BUCKETS = 2000

_LAYOUT = "generation int, buckets int, blocks int, bucket_keys bigint"
_KEYS = "key string, attempt string, bucket int"
_FILTER = "block int, w0 bigint, w1 bigint, w2 bigint, w3 bigint, bucket int"


@dataclass(frozen=True)
class Layout:
    generation: int
    buckets: int
    blocks: int
    bucket_keys: int


@dataclass(frozen=True)
class Probe:
    """Keys of a batch that may be stored, staged, and the buckets they lie in."""

    maybe: DataFrame
    buckets: list[int]


def placed(keys: DataFrame, layout: Layout) -> DataFrame:
    """(key) with its bucket, its block and the bits it sets there."""
    first, second = F.xxhash64("key"), F.xxhash64("key", F.lit(1))

    def bit(place: int) -> Column:
        # The lowest 16 bits of the hash choose the block.
        chosen = F.shiftrightunsigned(F.col("second"), 16 + 6 * place).bitwiseAND(F.lit(63))
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), chosen.cast("int"))

    return keys.select(
        "*", F.pmod(first, F.lit(layout.buckets)).cast("int").alias("bucket"),
        second.alias("second"),
    ).select(
        "*", F.pmod(F.col("second"), F.lit(layout.blocks)).cast("int").alias("block"),
        *(bit(2 * k).bitwiseOR(bit(2 * k + 1)).alias(w) for k, w in enumerate(WORDS)),
    ).drop("second")


@dataclass(frozen=True)
class KeyIndex:
    """The index below one folder. NULL keys are not held."""

    spark: SparkSession
    path: str

    def create(self, buckets: int = BUCKETS, bucket_keys: int = BUCKET_KEYS) -> KeyIndex:
        """Lay the index out if it is absent; repeatable."""
        empty = self.spark.createDataFrame([], _LAYOUT)
        empty.write.mode("ignore").json(f"{self.path}/layouts")
        if self._layouts().isEmpty():
            self._lay_out(Layout(0, buckets, self._blocks(bucket_keys), bucket_keys))
        return self

    @staticmethod
    def _blocks(bucket_keys: int) -> int:
        """A power of two, so that a block's number and a key's bits share no bits of a hash."""
        return min(1 << 16, 1 << max(0, (-(-bucket_keys // BLOCK_KEYS) - 1).bit_length()))

    def _layouts(self) -> DataFrame:
        return self.spark.read.schema(_LAYOUT).json(f"{self.path}/layouts")

    def _lay_out(self, layout: Layout) -> None:
        """The new layout counts from the moment its row is there."""
        for name, schema in (("keys", _KEYS), ("filter", _FILTER)):
            self.spark.createDataFrame([], schema).drop("bucket").write.mode("ignore").parquet(
                f"{self._folder(layout, name)}/bucket=-1")
        row = [(layout.generation, layout.buckets, layout.blocks, layout.bucket_keys)]
        self.spark.createDataFrame(row, _LAYOUT).coalesce(1).write.mode("append").json(
            f"{self.path}/layouts")

    def layout(self) -> Layout:
        return Layout(*self._layouts().orderBy(F.desc("generation")).first())

    def _folder(self, layout: Layout, name: str) -> str:
        return f"{self.path}/generation-{layout.generation:04d}/{name}"

    def _read(self, layout: Layout, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._folder(layout, name))

    def keys(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, attempt, bucket) of the given buckets; others are not even listed.

        They must be buckets that hold keys, as those of a probe do.
        """
        layout = self.layout()
        if buckets is None or len(buckets) > NAMED_BUCKETS:
            return self._read(layout, "keys", _KEYS)
        folder = self._folder(layout, "keys")
        return self.spark.read.schema(_KEYS).option("basePath", folder).parquet(
            *(f"{folder}/bucket={b}" for b in buckets or [-1]))

    def probe(self, keys: DataFrame) -> Probe:
        """Ask the filters about a batch's keys (key)."""
        layout = self.layout()
        asked = placed(keys.where("key is not null").distinct(), layout)
        # With few buckets a batch is in all of them anyway.
        buckets = None if layout.buckets <= BUCKETS else _buckets(asked)
        blocks = self._read(layout, "filter", _FILTER)
        if buckets is not None and len(buckets) <= NAMED_BUCKETS:
            blocks = blocks.where(F.col("bucket").isin(buckets))
        blocks = blocks.alias("f")
        asked = asked.alias("a")
        seen = [(F.col(f"f.{w}").bitwiseAND(F.col(f"a.{w}"))) == F.col(f"a.{w}") for w in WORDS]
        on = (F.col("a.bucket") == F.col("f.bucket")) & (F.col("a.block") == F.col("f.block"))
        for word in seen:
            on = on & word
        maybe = stage(asked.join(blocks, on, "left_semi").select("key", "bucket"), "maybe-stored")
        return Probe(maybe, _buckets(maybe))

    def stored(self, keys: DataFrame, attempts: DataFrame) -> DataFrame:
        """Those of a batch's keys (key) that one of the ``attempts`` (attempt) has stored."""
        probe = self.probe(keys)
        held = self.keys(probe.buckets).join(attempts, "attempt", "left_semi")
        return probe.maybe.select("key").join(held.select("key"), "key", "left_semi")

    def add(self, keys: DataFrame, attempt: str, total: int) -> None:
        """Add an attempt's new keys (key); ``total`` is how many the index then holds."""
        layout = self._grown(total)
        self._write(placed(keys.where("key is not null").select(
            "key", F.lit(attempt).alias("attempt")), layout), layout)

    def _write(self, rows: DataFrame, layout: Layout) -> None:
        """One file per bucket, sorted; keys before filters, so that no filter names a lost key."""
        dealt = rows.repartition("bucket")
        (dealt.select("key", "attempt", "bucket").sortWithinPartitions("bucket", "key")
         .write.mode("append").partitionBy("bucket").parquet(self._folder(layout, "keys")))
        (dealt.groupBy("bucket", "block").agg(*(F.bit_or(w).alias(w) for w in WORDS))
         .select("block", *WORDS, "bucket").sortWithinPartitions("bucket", "block")
         .write.mode("append").partitionBy("bucket").parquet(self._folder(layout, "filter")))

    def _grown(self, total: int) -> Layout:
        """Deal all keys to more buckets once they have outgrown theirs, so that the size
        of a bucket, and what a batch reads, does not grow with the store."""
        layout = self.layout()
        if total <= layout.buckets * layout.bucket_keys:
            return layout
        buckets = layout.buckets
        while total > buckets * layout.bucket_keys:
            buckets *= GROWTH
        new = Layout(layout.generation + 1, buckets, layout.blocks, layout.bucket_keys)
        held = self._read(layout, "keys", _KEYS).select("key", "attempt")
        # What an interrupted run left there would only repeat keys; start clean.
        remove(self.spark, f"{self.path}/generation-{new.generation:04d}")
        self._write(placed(held, new), new)
        self._lay_out(new)
        remove(self.spark, f"{self.path}/generation-{layout.generation:04d}")
        return new


def _buckets(rows: DataFrame) -> list[int]:
    """Buckets of rows, at most as many as the index has."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())
