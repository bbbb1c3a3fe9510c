"""Boxes that lie on one another: a spatial self-join by grid cells, without all pairs of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_pairs(boxes: DataFrame, group: str, cell_w: float, cell_h: float, least: float = 0.5) -> DataFrame:
    """boxes(group, id, x0, y0, x1, y1, text) -> group, i < j, iou of pairs of different texts with IoU of ``least`` or more.

    Two boxes with IoU of a half or more share the cell of their overlap's corner; a pair is
    taken in that cell only, so it appears once and needs no distinct."""
    b = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.btrim("text") != ""))
    at = lambda c, size: F.floor(F.col(c) / size)
    b = b.withColumn("cx", F.explode(F.sequence(at("x0", cell_w), at("x1", cell_w)))).withColumn("cy", F.explode(F.sequence(at("y0", cell_h), at("y1", cell_h))))
    l, r = (b.select(F.col(group), "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1", "text")]) for p in "lr")
    j = l.join(r, [group, "cx", "cy"]).where("l_id < r_id AND btrim(l_text) <> btrim(r_text)")
    ix0, iy0 = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    w, h = F.least("l_x1", "r_x1") - ix0, F.least("l_y1", "r_y1") - iy0
    inter = w * h
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    iou = inter / (area("l") + area("r") - inter)
    j = j.where((w > 0) & (h > 0) & (F.floor(ix0 / cell_w) == F.col("cx")) & (F.floor(iy0 / cell_h) == F.col("cy")) & (iou >= least))
    return j.select(group, F.col("l_id").alias("i"), F.col("r_id").alias("j"), F.round(iou, 6).alias("iou"), "l_text", "r_text")


def overlapping(units: DataFrame) -> DataFrame:
    """Findings for overlapping spans of PDF pages; those outside their page are findings of their own."""
    n = lambda c: F.col("a")[c].cast("double")
    spans = units.where("unit = 'pdf_span' AND a['outside'] = 'false'").select(F.concat_ws("\x00", "file_id", F.col("a")["page"]).alias("page"), F.col("ord").alias("id"), n("x0").alias("x0"), n("y0").alias("y0"), n("x1").alias("x1"), n("y1").alias("y1"), "text")
    p = overlap_pairs(spans, "page", 72.0, 14.0)
    return p.select(
        F.substring_index("page", "\x00", 1).alias("file_id"), F.lit("pdf").alias("kind"), F.lit("pdf_overlap").alias("unit"), F.col("i").cast("int").alias("ord"), F.concat(F.lit("spans "), "i", F.lit(","), "j").alias("location"),
        F.lit("overlapping_text").alias("mechanism"), F.lit(0.75).alias("confidence"), F.lit(None).cast("int").alias("tier_override"), F.lit(None).cast("double").alias("severity_override"),
        F.concat_ws(" / ", "l_text", "r_text").alias("concealed"), F.lit(None).cast("string").alias("payload"), F.lit(899).alias("trig"),
    )
