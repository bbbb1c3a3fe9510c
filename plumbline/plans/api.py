"""Scans of one file and of folders, with exit codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import ScanError
from ..limits import DEFAULT, Limits
from ..operators import scoring
from ..operators.registry import Registry
from .scan import Scan, read_files, scan


@dataclass
class FileResult:
    """The report of one file, and its findings in order."""

    report: Row
    findings: list[Row]
    exit_code: int


def scan_path(spark: SparkSession, path: str, mode: str = "forensic", limits: Limits = DEFAULT, rules: Registry | None = None) -> Scan:
    """All files of a folder, or one file; ScanError where the path is not there."""
    try:
        files = read_files(spark, path, limits.file_bytes)
    except AnalysisException as e:
        raise ScanError(f"{path}: {e.getCondition()}") from e
    return scan(files, mode, limits, rules)


def scan_file(spark: SparkSession, path: str, mode: str = "forensic", limits: Limits = DEFAULT, rules: Registry | None = None) -> FileResult:
    """One file's report and findings, brought to the driver."""
    s = scan_path(spark, path, mode, limits, rules)
    reports = s.reports.limit(2).collect()
    if len(reports) != 1:
        raise ScanError(f"{path}: {'no file' if not reports else 'more than one file'}")
    found = s.findings.orderBy("ordinal").collect()
    code = exit_code(s)
    s.release()
    return FileResult(reports[0], found, code)


def exit_codes(s: Scan) -> DataFrame:
    """file_id, code: 2 for a file that could not be read whole, 1 for one with findings, else 0."""
    return s.reports.select("file_id", scoring.exit_code(F.col("incomplete"), F.col("n_findings")).alias("code"))


def exit_code(s: Scan) -> int:
    """The largest code of the batch, 0 for an empty one."""
    return exit_codes(s).agg(F.coalesce(F.max("code"), F.lit(0)).alias("code")).collect()[0]["code"]
