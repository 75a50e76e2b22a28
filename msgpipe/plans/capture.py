"""Capture job: scrub captured records, export them, check the timings."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession

from msgpipe.functions.redaction import redact_record
from msgpipe.operators.export import export_samples
from msgpipe.operators.timing import slo_breaches, timing_summary
from msgpipe.session import stage
from msgpipe.sources.captures import read_captured_records, read_timings


class Outcome(IntEnum):
    OK = 0
    NO_RECORDS = 1
    SLO_BREACH = 2


@dataclass(frozen=True)
class CaptureResult:
    """Outcome and tables; timing tables are None without timing lines."""

    outcome: Outcome
    records: DataFrame
    timing: DataFrame | None = None
    breaches: DataFrame | None = None


def run_capture(spark: SparkSession, stdout_path: str, output: str,
                stderr_path: str | None = None) -> CaptureResult:
    """Record lines to masked samples, then timing lines against the targets.

    Without any record nothing is written. Without timing lines the target check
    is skipped.
    """
    records = stage(redact_record(read_captured_records(spark, stdout_path)), "captured")
    if records.isEmpty():
        return CaptureResult(Outcome.NO_RECORDS, records)
    export_samples(records, output, ("origin", "position"))
    if stderr_path is None:
        return CaptureResult(Outcome.OK, records)
    timings = read_timings(spark, stderr_path)
    if timings.isEmpty():
        return CaptureResult(Outcome.OK, records)
    breaches = slo_breaches(timings)
    outcome = Outcome.OK if breaches.isEmpty() else Outcome.SLO_BREACH
    return CaptureResult(outcome, records, timing_summary(timings), breaches)
