"""files -> units -> findings -> reports -> correlations, as one lazy plan.

Only the format parsers run in Python, batch by batch; detectors, dimension join, scores and
correlation are expressions and grouped sums.  File contents never enter a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ModeError
from ..functions.mechanisms import MECHANISMS, with_dimension
from ..limits import DEFAULT, Limits
from ..operators import scoring
from ..operators.detectors import CARRIED, DETECTORS, findings_and
from ..operators.overlap import overlapping
from ..operators.registry import Registry
from ..operators.routing import extension, other_office, route
from ..sources import binary_formats as B
from ..sources import text_formats as X

#: Characters of units that a batch holds, and what a unit counts for beside its text.
BATCH_CHARS, UNIT_CHARS = 4 << 20, 256
UNITS = "file_id string, kind string, mismatch boolean, ord int, unit string, loc string, text string, a map<string,string>"
#: Analyzer of a unit kind, and the order in which analyzers report.
ANALYZERS = ["pdf_text", "pdf_objects", "text", "json", "image", "svg", "docx", "html", "xlsx", "pptx", "eml", "csv", "file", "video", "audio"]


def analyzer_of(unit: str) -> str:
    head = unit.partition("_")[0]
    if unit in ("pdf_span", "pdf_origin", "pdf_note", "pdf_invisible"):
        return "pdf_text"
    return {"pdf": "pdf_objects", "line": "text", "png": "image", "jpeg": "image", "trailing": "image", "lsb": "image", "image": "image", "subtitle": "video", "cover": "video", "scan": "file"}.get(head, head)


def units_of(raw: bytes, name: str, nested: int = 0, limits: Limits = DEFAULT):
    """(kind, mismatch, units) of one file; attachments and cover pictures are scanned in place."""
    kind, _, mismatch = route(raw, name)
    out = [("file", name, "", {"kind": kind, "ext": extension(name), "length": len(raw), "mismatch": mismatch, "other_office": other_office(raw, kind)})]
    if limits.over("file_bytes", len(raw)):
        return kind, mismatch, [*out, ("scan_limited", name, "file size", {})]
    try:
        for u in _parsed(raw, kind, nested, limits):
            out.append(u)
    except Exception as e:  # whatever a broken file does to a parser is a finding beside those made before, not a failure
        out.append(("scan_error", name, f"{type(e).__name__}: {e}"[:240], {}))
    return kind, mismatch, out


def unread(name: str, length: int):
    """(kind, mismatch, units) of a file too large to read; its kind is that of its name alone."""
    kind, _, _ = route(b"", name)
    return kind, False, [("file", name, "", {"kind": kind, "ext": extension(name), "length": length, "mismatch": False, "other_office": False}), ("scan_limited", name, "file size", {})]


def _parsed(raw: bytes, kind: str, nested: int, limits: Limits):
    text = lambda: raw.decode("utf-8", "replace")
    if kind in ("markdown", "code"):
        yield from X.lines(text())
    elif kind == "html":
        yield from X.lines(text())
        yield from X.html_file(text())
    elif kind == "json":
        yield from X.json_file(raw)
    elif kind == "csv":
        yield from X.table(raw, limits)
    elif kind == "eml":
        for u in X.mail(raw, limits=limits):
            if u[0] == "attachment":
                yield from _inner(u[3]["bytes"], u[1], nested, "", limits)
            else:
                yield u
    elif kind in ("docx", "xlsx", "pptx"):
        yield from B.office(raw, kind)
    elif kind in ("png", "jpeg", "svg"):
        yield from getattr(B, kind)(raw)
    elif kind in ("mp4", "mov", "m4a", "mkv", "webm"):
        for u in B.video(raw):
            yield from _inner(u[3]["bytes"], u[1], nested, "video", limits) if u[0] == "cover" else [u]
    elif kind in ("mp3", "wav", "flac", "ogg"):
        for u in B.audio(raw):
            if u[0] == "audio_picture":
                data = u[3]["bytes"]
                if data[:3] == b"\xff\xd8\xff" or data[:4] == b"\x89PNG":
                    yield from _inner(data, u[1], nested, "audio", limits)
                elif data:
                    yield "audio_foreign", u[1], B.foreign(data), {}
            else:
                yield u
    elif kind == "pdf":
        yield from B.pdf(raw)


def _inner(raw: bytes, name: str, nested: int, parent: str, limits: Limits = DEFAULT):
    if limits.over("nested", nested + 1):
        yield "scan_limited", name, "nesting", {"parent": parent}
        return
    _, _, units = units_of(raw, name, nested + 1, limits)
    for unit, loc, text, a in units:
        if unit != "file":
            yield unit, f"{name} > {loc}", text, {**a, "parent": a.get("parent") or parent}


def decompose(files: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """files(file_id, content) -> units; file_id ends in the file's name.

    Where there is a column ``length``, a file whose content was not read (null) is limited, not empty."""

    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_id", "kind", "mismatch", "ord", "unit", "loc", "text", "a"])

    def run(batches):
        # one file at a time is in Python; what is handed back at once is bounded by characters, not by files
        rows, held = [], 0
        for b in batches:
            for at in range(b.num_rows):
                file_id, raw, length = (b.column(c)[at].as_py() for c in ("file_id", "content", "length"))
                kind, mismatch, units = units_of(raw or b"", file_id or "", limits=limits) if raw is not None or not length else unread(file_id or "", length)
                for i, (unit, loc, text, a) in enumerate(units):
                    plain = text.encode("utf-8", "replace").decode("utf-8")
                    attrs = [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in a.items() if not isinstance(v, bytes)]
                    rows.append((file_id, kind, mismatch, i, unit, loc.encode("utf-8", "replace").decode(), plain, attrs))
                    held += len(plain) + UNIT_CHARS
                    if held >= BATCH_CHARS:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    length = F.col("length").cast("long") if "length" in files.columns else F.lit(None).cast("long")
    return files.select("file_id", "content", length.alias("length")).mapInArrow(run, UNITS)


@dataclass
class Scan:
    """Lazy results of a batch."""

    findings: DataFrame
    reports: DataFrame
    cross: DataFrame
    cross_files: DataFrame
    gate: DataFrame
    held: tuple[DataFrame, ...] = ()

    def stem_findings(self, more=()) -> DataFrame:
        return with_dimension(scoring.stem_findings(self.reports, self.findings, more=more))

    def release(self) -> None:
        """Give back the blocks that the scan's results are read from; they are computed anew if read again."""
        for d in self.held:
            d.unpersist()


def read_files(spark: SparkSession, path: str, max_size: int = DEFAULT.file_bytes) -> DataFrame:
    """A folder of files with their lengths; those larger than ``max_size`` have null content, which is never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("path").alias("file_id")
    small = f.where(F.col("length") <= max_size).select(name, "content", "length")
    return small.unionByName(f.where(F.col("length") > max_size).select(name, F.lit(None).cast("binary").alias("content"), "length"))


def ranked(found: DataFrame, rules: Registry | None = None) -> DataFrame:
    """findings with their analyzer and its rank: the dearest of its mechanisms' cost classes, then the order of analyzers."""
    detectors = DETECTORS if rules is None else rules.detectors
    classes = {m[0]: "ABCD".index(m[4]) for m in (MECHANISMS if rules is None else rules.mechanisms.values())}
    units = sorted({d.unit for d in detectors} | {u for u, _ in CARRIED.values()} | {"pdf_overlap", "correlation"})
    which = F.create_map(*[x for u in units for x in (F.lit(u), F.lit(analyzer_of(u)))])
    cost: dict[str, int] = {}
    for unit, m in [*((d.unit, d.mechanism) for d in detectors), *CARRIED.values()]:
        cost[analyzer_of(unit)] = max(cost.get(analyzer_of(unit), 0), classes.get(m, 0))
    f = found.withColumn("analyzer", F.coalesce(which[F.col("unit")], F.lit("file")))
    return f.withColumn("rank", F.coalesce(F.create_map(*[x for i, a in enumerate(ANALYZERS) for x in (F.lit(a), F.lit(i + 100 * cost.get(a, 0)))])[F.col("analyzer")], F.lit(99)))


def scan(files: DataFrame, mode: str = "forensic", limits: Limits = DEFAULT, rules: Registry | None = None) -> Scan:
    """``rules``: detectors and mechanisms in place of the library's own; words and overlaps are looked at all the same."""
    if mode not in ("forensic", "production"):
        raise ModeError(f"unknown mode {mode!r}")
    rules = Registry() if rules is None else rules
    known = list(rules.mechanisms.values())
    # units are as large as the files and are not held; findings, files and PDF spans are all that is read again
    narrow = findings_and(decompose(files, limits), ("file", "scan_error", "scan_limited", "pdf_span"), rules.detectors).persist()
    units, found = narrow.where("mechanism IS NULL"), narrow.where("mechanism IS NOT NULL").drop("text", "a")
    # the detectors run once for scores, gate and both correlations
    found = with_dimension(ranked(found.unionByName(overlapping(units)), rules), known).persist()
    held = (narrow, found)
    if mode == "production":
        found = scoring.early_exit(found)
    # one file's payloads meeting at two sites are a finding themselves; PDFs are not correlated
    pairs = scoring.correlate(found.where("kind <> 'pdf'"))
    same = pairs.join(units.where("unit = 'file'").select("file_id", "kind"), "file_id")
    extra = same.select("file_id", "kind", F.lit("correlation").alias("unit"), F.lit(1 << 30).alias("ord"), F.col("fingerprint").alias("location"), F.lit("coordinated_concealment").alias("mechanism"), "confidence", F.col("tier").alias("tier_override"), F.lit(None).cast("double").alias("severity_override"), F.col("payload").alias("concealed"), F.lit(None).cast("string").alias("payload"), F.lit(950).alias("trig"))
    found = found.unionByName(with_dimension(ranked(extra, rules), known))
    base = units.where("unit = 'file'").groupBy("file_id", "kind").agg(F.count("*").alias("_n")).drop("_n")
    broken = units.where("unit IN ('scan_error', 'scan_limited')").select("file_id").distinct().withColumn("_broken", F.lit(True))
    base = base.join(broken, "file_id", "left").select("file_id", "kind", (F.coalesce("_broken", F.lit(False)) | (F.col("kind") == "unknown")).alias("incomplete"))
    found = found.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy("rank", "ord", "trig", "location")))
    rep = scoring.reports(base, found)
    cross = scoring.correlate(found.where("kind <> 'pdf'"), within=None)
    return Scan(found, rep, cross, scoring.cross_files(found.where("kind <> 'pdf'"), cross), scoring.gate(rep, found), held)
