"""Queries of the training-data operators and their SQL."""

from .boosted_quality import op3_quality_classifier
from .byte_bpe import op1_byte_bpe
from .image_copies import op9_image_copies
from .license_scan import op6_license_scan, op6_sql
from .line_dedup import op7_line_dedup, op7_sql
from .mixing import op10_mix_sources, op10_sql
from .near_dedup import op4_near_dedup
from .quality_rules import op8_quality_rules, op8_sql
from .substring_dedup import op5_sql, op5_substring_dedup
from .url_filter import op2_sql, op2_url_filter

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_dedup": op4_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_image_copies": op9_image_copies,
    "op10_mix_sources": op10_mix_sources,
}
SQL = {"op2_url_filter": op2_sql(), "op5_substring_dedup": op5_sql(), "op6_license_scan": op6_sql(), "op7_line_dedup": op7_sql(), "op8_quality_rules": op8_sql(), "op10_mix_sources": op10_sql()}
