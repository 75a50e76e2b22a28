"""Records out: JSON lines, or one document per record for small samples."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from msgpipe.operators.numbering import sample_names
from msgpipe.operators.records import record_json, record_json_column

# Fixed value: the ending of a numbered document's name.
SAMPLE_SUFFIX = "_sample.json"
# Folder of emitted lines below the path that the caller names.
EMITTED = "emitted=records"


def emit_records(records: DataFrame, path: str) -> None:
    """Write records as JSON lines below ``path``; content is allowed in this output.

    Lines emitted there before are replaced, whatever else lies there stays.
    """
    record_json(records).write.mode("overwrite").text(f"{path}/{EMITTED}")


def sample_documents(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(sample_name, value): numbered JSON documents in key order."""
    return sample_names(records, keys).select(
        "sample_name", record_json_column(pretty=True).alias("value"))


def export_samples(records: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Replace the samples in the folder ``path``: one JSON file per record, 001_sample.json on.

    All documents are written beside the folder first; only when that has succeeded do they
    take the place of the old ones, so a failing export leaves those. Other files in the
    folder stay. For sample-sized sets: files are moved one by one. Use
    :func:`emit_records` for large ones. Returns the number of samples.
    """
    spark = records.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # On the target's own file system, where a file is moved and not copied.
    written = hadoop.Path(folder.getParent() or folder, f".{folder.getName()}-{uuid.uuid4().hex}")
    try:
        sample_documents(records, keys).write.partitionBy("sample_name").text(
            written.toString())
        new = {entry.getPath().getParent().getName().partition("=")[2]: entry.getPath()
               for entry in files.globStatus(hadoop.Path(written, "sample_name=*/part-*")) or ()}
        files.mkdirs(folder)
        for entry in files.globStatus(hadoop.Path(folder, f"*{SAMPLE_SUFFIX}")) or ():
            if entry.getPath().getName() not in new:
                files.delete(entry.getPath(), True)
        for name, source in sorted(new.items()):
            target = hadoop.Path(folder, name)
            files.delete(target, True)
            if not files.rename(source, target):
                raise OSError(f"{target}: the sample could not be moved there")
        return len(new)
    finally:
        files.delete(written, True)

