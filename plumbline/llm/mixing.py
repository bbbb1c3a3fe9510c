"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; its rate is target over size, the expected copies
of each of its documents.  Documents of a source are put in order of size, then id; expected
copies are summed along that order from one random offset a source, and a document is emitted
once for each whole number that its step crosses.  In order of size the words taken differ
from the target by less than about one large document.

The order is a range partitioning over (source, size, id) of narrow rows, so a hot source is
spread over tasks; ranks add up from counts of one row a source and partition.

Null texts and texts without words have size 0 and take 0 words; null sources come last, and
null ids sort first in their source.  Rows that agree in source, size and id are dealt with one after another
(in any order: they can't be told apart).  An empty table gives an empty mix; a corpus without
words has targets of 0.  Columns other than those named pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, read

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "plumbline"


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size), one row a source -> and target, rate, offset.

    Water filling: sources in order of size for each unit of weight stop at their cap until the
    rest can share what is left by weight.  The table has one row a source; it alone is ordered
    in one task."""
    at = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(at) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    s = s.withColumns({"_capped": CAP * F.coalesce(F.sum("source_size").over(before), zero), "_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero), "_all": F.sum("source_size").over(whole)})
    level = (SHARE * F.col("_all") - F.col("_capped")) / F.col("_left")
    s = s.withColumn("_level", F.when(level * F.col("weight") <= CAP * F.col("source_size"), level))
    s = s.withColumn("_level", F.max("_level").over(whole))
    target = F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(F.col("_level") * F.col("weight"), (CAP * F.col("source_size")).cast("double")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "/"), F.coalesce("source", F.lit("\x00null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))


def plan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, size) -> the same rows with source_size, target and copies."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", "source", "size").repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", "doc_id")
    # which partition a row is in must not change between the two reads below, so it is written
    d = cut(d.select("*", F.spark_partition_id().alias("_part")), "mix-order")
    per = d.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    t = targets(per.groupBy("source").agg(F.sum("_size").alias("source_size"))).withColumnRenamed("source", "_source")
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    per = per.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumnsRenamed({"_part": "_p"}).drop("source")
    inner = Window.partitionBy("_part", "source").orderBy("size", "doc_id")
    d = d.withColumn("_row", F.row_number().over(inner))
    j = d.join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    rank = F.col("_before") + F.col("_row")
    up_to = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    return j.select("doc_id", "source", "size", "source_size", "target", (up_to(rank) - up_to(rank - 1)).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each row as often as it is taken, with all their columns.

    Rows of one id must agree in source and text; copies are dealt to ids, then to their rows in turn."""
    sized = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"))
    copies, rows, id_, row, copy = fresh(docs.columns, "_copies", "_rows", "_id", "_row", "_copy")
    taken = plan(sized).groupBy("doc_id").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    taken = cut(taken.withColumnRenamed("doc_id", id_), "mix-taken")
    j = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)))
    # only rows of ids with several rows are numbered
    several = j.where(F.col(rows) > 1).withColumn(row, F.row_number().over(Window.partitionBy(id_).orderBy(id_)))
    j = j.where(F.col(rows) == 1).withColumn(row, F.lit(1)).unionByName(several)
    each = F.floor((F.col(copies) + F.col(rows) - F.col(row)) / F.col(rows)).cast("int")
    return j.select(*[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), each)).alias(copy)).drop(copy)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return plan(d).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
f AS (SELECT *, {CAP} * coalesce(sum(source_size) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest, sum(source_size) OVER () AS whole FROM w
 WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ({SHARE}::DOUBLE * whole - capped) / rest AS level FROM f),
m AS (SELECT *, max(CASE WHEN level * weight <= {CAP} * source_size THEN level END) OVER () AS lev FROM l),
t AS (SELECT source, source_size, least({CAP} * source_size::DOUBLE, coalesce(lev * weight, {CAP} * source_size::DOUBLE)) AS target,
 ('0x' || substr(md5('{SEED}/' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size AS taken, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT AS copies FROM r"""
