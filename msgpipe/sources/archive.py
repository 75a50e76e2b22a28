"""Raw messages in files of their own, with a label index that grows with every append.

A listing reads the index of its label only, from the newest month back as far as it must, and
then the files that hold the messages it found. No payload is read to find one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpipe.operators.firsts import first_per_key
from msgpipe.schemas import ERROR, carried_error
from msgpipe.sources.listing import message_index

_MESSAGES = f"message_id string, payload variant, err {ERROR.simpleString()}"
_INDEX = "message_id string, received_at timestamp, appended string, file string"
# Month of messages whose time cannot be read; it sorts before all others.
_NO_MONTH = "0000-00"
# Files a fetch names one by one; a listing in more of them reads the folder.
NAMED_FILES = 2000


@dataclass(frozen=True)
class Archive:
    """Messages and label index below one folder. One writer at a time."""

    spark: SparkSession
    path: str

    @property
    def _messages(self) -> str:
        return f"{self.path}/messages"

    @property
    def _index(self) -> str:
        return f"{self.path}/label_index"

    def create(self) -> Archive:
        """Create the archive if it is absent; repeatable."""
        empty = self.spark.createDataFrame
        empty([], _MESSAGES).write.mode("ignore").parquet(f"{self._messages}/appended=none")
        empty([], _INDEX).write.mode("ignore").parquet(
            f"{self._index}/label_id=__HIVE_DEFAULT_PARTITION__/month={_NO_MONTH}")
        return self

    def append(self, raw: DataFrame) -> str:
        """Add raw messages; returns the name of the append, later ones sort behind it.

        Messages are written first and indexed from what was written. What an append that
        broke off wrote is in no index and is found by no listing.
        """
        number = self.spark.read.schema(f"{_INDEX}, label_id string, month string").parquet(
            self._index).agg(F.max("appended")).first()[0]
        appended = f"{int((number or '0-').partition('-')[0]) + 1:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self._messages}/appended={appended}"
        raw.select("message_id", "payload", carried_error(raw).alias("err")).write.parquet(folder)
        written = self.spark.read.schema(_MESSAGES).parquet(folder)
        index = message_index(written, F.col("_metadata.file_name").alias("file"))
        month = F.coalesce(F.date_format("received_at", "yyyy-MM"), F.lit(_NO_MONTH))
        (index.select("message_id", "received_at", F.lit(appended).alias("appended"), "file",
                      F.explode("labels").alias("label_id"), month.alias("month"))
         .hint("rebalance", "label_id", "month").sortWithinPartitions("label_id", "month")
         .write.mode("append").partitionBy("label_id", "month").parquet(self._index))
        return appended

    def labelled(self, label_id: str, months: list[str] | None = None) -> DataFrame:
        """(message_id, received_at, appended, file) under a label, of the given months or of all."""
        rows = self.spark.read.schema(f"{_INDEX}, label_id string, month string").parquet(
            self._index).where(F.col("label_id") == label_id)
        if months is not None:
            rows = rows.where(F.col("month").isin(months) if months else F.lit(False))
        return rows.select("message_id", "received_at", "appended", "file")

    def months(self, label_id: str) -> list[str]:
        """Months with messages under a label, the newest first; the names of folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = hadoop.Path(self._index, f"label_id={escaped.escapePathName(label_id)}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = (entry.getPath().getName() for entry in files.listStatus(folder))
        return sorted((n.removeprefix("month=") for n in names if n.startswith("month=")),
                      reverse=True)

    def newest(self, label_id: str, limit: int | None = None) -> DataFrame:
        """Where the newest messages under a label are; None lists all.

        Of a message that was appended more than once the newest by its own time counts, of
        equal ones the first append. Months are added until they hold enough, so an old label
        with millions of messages costs what its latest months do.
        """
        ranks = [F.col("received_at").desc_nulls_last(), "appended", "file"]
        if limit is None:
            return first_per_key(self.labelled(label_id), "message_id", ranks)
        months = self.months(label_id)
        taken = 1
        while True:
            rows = first_per_key(self.labelled(label_id, months[:taken]), "message_id", ranks)
            found = rows.orderBy(F.col("received_at").desc_nulls_last(), "message_id").limit(
                max(limit, 0))
            if taken >= len(months) or found.count() >= limit:
                return found
            taken *= 2

    def fetch(self, listed: DataFrame) -> DataFrame:
        """The messages of a listing, from the files that hold them.

        Other files are not opened, unless the listing is in more than NAMED_FILES of them.
        """
        places = listed.select("appended", "file").distinct().limit(NAMED_FILES + 1).collect()
        reader = self.spark.read.schema(f"{_MESSAGES}, appended string").option(
            "basePath", self._messages)
        paths = [f"{self._messages}/appended={a}/{f}" for a, f in sorted(map(tuple, places))]
        few = 0 < len(paths) <= NAMED_FILES
        rows = reader.parquet(*paths) if few else reader.parquet(self._messages)
        return rows.join(listed.select("message_id", "appended"), ["message_id", "appended"],
                         "left_semi")
