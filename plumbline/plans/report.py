"""Reports of a scan as JSON rows, text, and plain counts; formatters are looked up by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def formatter(name: str):
    def add(f):
        if name in FORMATTERS:
            raise ValueError(f"formatter {name!r} exists")
        FORMATTERS[name] = f
        return f

    return add


@formatter("json")
def as_json(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """file_id, report: one JSON text a file, findings in order."""
    one = F.struct("ordinal", "mechanism", "tier", "confidence", "location", F.struct(F.lit("").alias("surface"), "concealed").alias("inversion_recovery"))
    per = findings.groupBy("file_id").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    j = reports.join(per, "file_id", "left")
    return j.select("file_id", F.to_json(F.struct("file_id", "score", "verdict", (~F.col("incomplete")).alias("scan_complete"), F.coalesce("findings", F.array()).alias("findings"))).alias("report"))


@formatter("text")
def as_text(reports: DataFrame, findings: DataFrame) -> DataFrame:
    line = F.concat(F.lpad(F.col("ordinal").cast("string"), 3, " "), F.lit(". [tier "), "tier", F.lit("] "), "mechanism", F.lit(" at "), "location", F.lit(": "), F.substring(F.coalesce("concealed", F.lit("")), 1, 240))
    per = findings.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("t")))).alias("l"))
    j = reports.join(per, "file_id", "left")
    head = F.concat("file_id", F.lit(": "), "verdict", F.lit(", score "), F.format_number("score", 3))
    return j.select("file_id", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("report"))


@formatter("counts")
def as_counts(reports: DataFrame, findings: DataFrame) -> DataFrame:
    return findings.groupBy("mechanism", "tier").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files")).orderBy(F.desc("n"), "mechanism")


def batch_summary(reports: DataFrame, findings: DataFrame, cross: DataFrame) -> DataFrame:
    """One row: files, findings, cross-file matches, whether any scan is incomplete."""
    a = reports.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("per_file_findings"), F.coalesce(F.max("incomplete"), F.lit(False)).alias("any_incomplete"))
    b = cross.agg(F.count("*").alias("cross_file_findings"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("total_findings", F.col("per_file_findings") + F.col("cross_file_findings"))


def cross_findings(cross: DataFrame, cross_files: DataFrame) -> DataFrame:
    """Findings of payloads shared by files; location lists the files in order, for a batch that a reader reads.

    ``cross_files`` itself has a row a file, for batches in which a payload is in very many."""
    files = cross_files.groupBy("fingerprint").agg(F.array_join(F.sort_array(F.collect_set(F.col("file_id").cast("string"))), "; ").alias("location"))
    j = cross.join(files, "fingerprint")
    concealed = F.concat(F.lit("payload fingerprint "), "fingerprint", F.lit(" across "), F.col("n_files").cast("string"), F.lit(" file(s)"))
    return j.select(F.lit("cross_format_payload_match").alias("mechanism"), "tier", F.lit(0.3).alias("severity"), "confidence", "location", concealed.alias("concealed"), "mechanisms")


def involved_files(cross_files: DataFrame) -> DataFrame:
    """The files named in any cross-file finding, each once, in order."""
    return cross_files.select("file_id").distinct().orderBy("file_id")
