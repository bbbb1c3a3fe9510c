"""Score, verdict, gate and correlation: grouped folds over findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Mechanisms whose payload may be correlated.
CORRELATED = ["image_text_metadata", "svg_hidden_text", "svg_microscopic_text", "high_entropy_metadata", "generative_cipher_signature", "tag_chars", "svg_embedded_script", "svg_embedded_data_uri", "svg_external_reference"]
LEAST_LENGTH, LEAST_ENTROPY, INCOMPLETE_SCORE = 8, 2.5, 0.5
VERDICTS = ("sound", "suspicious", "concealed", "severe", "withheld")


def score(severity_confidence_sum):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - severity_confidence_sum))


def verdict(score_, n, tier0, tier1, incomplete):
    """First rule that fits."""
    return (
        F.when(tier0 | incomplete, "withheld").when((score_ >= 1) & (n == 0), "sound").when((score_ < 0.3) & tier1, "severe").when(score_ < 0.7, "concealed").otherwise("suspicious")
    )


def reports(files: DataFrame, findings: DataFrame, key: str = "file_id") -> DataFrame:
    """files(key, incomplete) and findings(key, severity, confidence, tier) -> one row a file.

    Sums use decimals, so the order of rows doesn't matter."""
    worth = (F.col("severity").cast("decimal(10,6)") * F.col("confidence").cast("decimal(10,6)")).cast("decimal(18,9)")
    per = findings.groupBy(key).agg(
        F.sum(F.when(F.col("tier") > 0, worth).otherwise(F.lit(0).cast("decimal(18,9)"))).alias("_lost"), F.count("*").alias("n_findings"),
        F.max(F.col("tier") == 0).alias("_t0"), F.max(F.col("tier") == 1).alias("_t1"),
    )
    j = files.join(per, key, "left")
    s = score(F.coalesce(F.col("_lost"), F.lit(0)).cast("double"))
    s = F.round(F.when(F.col("incomplete"), F.least(s, F.lit(INCOMPLETE_SCORE))).otherwise(s), 3)
    no = F.lit(False)
    n = F.coalesce("n_findings", F.lit(0).cast("long"))
    return j.select(*files.columns, s.alias("score"), n.alias("n_findings"), verdict(s, n, F.coalesce("_t0", no), F.coalesce("_t1", no), F.col("incomplete")).alias("verdict"))


def exit_code(error, n_findings):
    return F.when(error, 2).when(n_findings > 0, 1).otherwise(0)


def gate(reports_: DataFrame, findings: DataFrame, key: str = "file_id") -> DataFrame:
    """key, blocked, reason: verdicts first, then the first finding (in order) that blocks."""
    bad = findings.where((F.col("tier") == 1) | ((F.col("tier") == 2) & (F.col("confidence") >= 0.7)))
    first = bad.groupBy(key).agg(F.min_by(F.when(F.col("tier") == 1, "tier 1: ").otherwise("tier 2: "), "ordinal").alias("_t"), F.min_by("mechanism", "ordinal").alias("_m"))
    j = reports_.join(first, key, "left")
    reason = F.when(F.col("verdict") == "withheld", "withheld").when(F.col("verdict") == "severe", "severe").otherwise(F.concat("_t", "_m"))
    return j.select(key, "verdict", reason.isNotNull().alias("blocked"), reason.alias("reason"))


def payloads(findings: DataFrame) -> DataFrame:
    """Findings with a payload fit to correlate but for its entropy, normalised."""
    p = findings.where(F.col("mechanism").isin(*CORRELATED) & F.col("payload").isNotNull()).withColumn("payload", X.normal_payload(F.col("payload")))
    return p.where((F.length("payload") >= LEAST_LENGTH) & ~F.col("payload").isin(*X.STOPWORDS))


def correlation_confidence(length, sites, mechanisms, entropy):
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    c = 0.75 + 0.08 * unit((length - 16) / 48.0) + 0.08 * unit((sites - 2) / 4.0) + 0.04 * unit((mechanisms - 1) / 3.0) + 0.04 * unit((entropy - 2.5) / 2.5)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.75), c)), 6)


def correlate(findings: DataFrame, within: str | None = "file_id", file: str = "file_id") -> DataFrame:
    """Payloads met at two sites of a file (``within``), or, with None, in two files.

    A grouped count, not a self-join: a payload in many files stays one row.  Entropy is a matter of the payload alone,
    so it is counted once for each that met, after the grouping."""
    p = payloads(findings)
    keys = [within, "payload"] if within else ["payload"]
    site = F.concat_ws("\x00", "mechanism", "location") if within else F.col(file).cast("string")
    g = p.groupBy(*keys).agg(
        F.count_distinct(site).alias("n_sites"), F.count_distinct("mechanism").alias("n_mechanisms"), F.count_distinct(file).alias("n_files"),
        F.sort_array(F.collect_set("mechanism")).alias("mechanisms"),
    ).where("n_sites >= 2")
    g = g.withColumn("entropy", X.entropy(F.col("payload"))).where(F.col("entropy") >= LEAST_ENTROPY)
    conf = correlation_confidence(F.length("payload"), F.col("n_sites"), F.col("n_mechanisms"), F.col("entropy"))
    return g.select(*keys, X.fingerprint(F.col("payload")).alias("fingerprint"), "n_sites", "n_files", "mechanisms", conf.alias("confidence"), F.when(F.col("n_sites") >= 5, 1).otherwise(2).alias("tier"))


def cross_files(findings: DataFrame, cross: DataFrame, file: str = "file_id") -> DataFrame:
    """fingerprint, file: one row for each file that holds a payload of ``cross``; however many they are, none is one row's list."""
    return payloads(findings).join(cross.select("payload", "fingerprint"), "payload").select("fingerprint", file).distinct()


# Mechanisms by the stem of a media file that they speak of, and words with which metadata declares text.
STEMS = {
    "lyric": ["audio_lyrics_prompt_injection"],
    "embedded": ["video_embedded_attachment", "video_frame_stego_candidate", "audio_embedded_payload"],
    "container": ["video_container_anomaly", "audio_container_anomaly"],
    "sample": ["audio_lsb_stego_candidate"],
    "inventory": ["video_stream_inventory", "audio_stem_inventory"],
}
DECLARES = ["caption", "subtitle", "subtitled", "lyric", "transcript", "dialog", "narration", "sdh", "cc "]


def stems(files: DataFrame, findings: DataFrame, key: str = "file_id") -> DataFrame:
    """files(key, kind) -> key, kind, findings a stem, and ``undeclared``: text is carried that no metadata declares."""
    named = {m: s for s, ms in STEMS.items() for m in ms}
    stem = F.when(F.col("mechanism").startswith("subtitle_"), "subtitle").when(F.col("mechanism").isin(*STEMS["lyric"]), "lyric").when(F.col("mechanism").contains("metadata"), "metadata")
    for m, s in named.items():
        stem = stem.when(F.col("mechanism") == m, s)
    said = F.lower(F.concat_ws(" ", "location", "concealed"))
    declared = reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in DECLARES])
    f = findings.select(key, stem.alias("stem"), declared.alias("declared")).where("stem IS NOT NULL")
    names = ["subtitle", "lyric", "metadata", *[s for s in STEMS if s != "lyric"]]
    g = f.groupBy(key).agg(*[F.count_if(F.col("stem") == s).alias(s) for s in names], F.max((F.col("stem") == "metadata") & F.col("declared")).alias("_declared"))
    j = files.select(key, "kind").join(g, key, "left").fillna(0, names).fillna(False, ["_declared"])
    return j.withColumn("undeclared", ((F.col("subtitle") + F.col("lyric")) > 0) & ~F.col("_declared")).drop("_declared")


def stem_findings(files: DataFrame, findings: DataFrame, key: str = "file_id", more: Iterable[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """Findings across the stems of each file: an inventory for every file, and text that its metadata keeps silent about.

    They are asked for, not part of a scan.  ``more``: rules of users, from the counts of ``stems`` to rows of the key, kind,
    mechanism, confidence and concealed."""
    s = stems(files, findings, key)
    names = sorted(c for c in s.columns if c not in (key, "kind", "undeclared"))
    counts = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names])), ", ")
    one = lambda m, c, text: F.struct(F.lit(m).alias("mechanism"), F.lit(c).alias("confidence"), text.alias("concealed"))
    both = F.array(F.when(F.col("undeclared"), one("cross_stem_undeclared_text", 0.85, counts)), one("cross_stem_inventory", 1.0, counts))
    own = s.select(key, "kind", F.inline(F.array_compact(both)))
    return reduce(lambda a, rule: a.unionByName(rule(s)), more, own).withColumn("location", F.col(key).cast("string"))


def early_exit(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """The findings of a staged run: analyzers in order of cost, none after one with a terminal finding."""
    w = Window.partitionBy(key).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    terminal = ((F.col("tier") == 1) & (F.col("confidence") >= 0.9)).cast("int")
    return findings.withColumn("_before", F.coalesce(F.max(terminal).over(w), F.lit(0))).where("_before = 0").drop("_before")
