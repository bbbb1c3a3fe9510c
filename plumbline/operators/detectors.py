"""The detectors: what makes a unit a finding, as SQL expressions over (unit, loc, text, a).

``findings`` evaluates all of them in one pass: each unit goes through the array of its own
unit kind's detectors only, so nothing is scanned twice and nothing is shuffled."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def T(name: str) -> str:
    return f"coalesce(a['{name}'] = 'true', false)"


def N(name: str) -> str:
    return f"cast(a['{name}'] AS DOUBLE)"


@dataclass(frozen=True)
class Detector:
    mechanism: str
    unit: str
    when: str
    confidence: str = "1.0"
    tier: str = "NULL"
    severity: str = "NULL"
    payload: str = "NULL"


def _rx(pattern: str, text: str = "text", flags: str = "") -> str:
    p = (f"(?{flags})" if flags else "") + pattern
    return f"{text} rlike r'{p}'" if "'" not in p else f"{text} rlike r\"{p}\""


ZW, BIDI, TAG, MATH = (_rx(p) for p in (X.ZERO_WIDTH, X.BIDI, X.TAG, X.MATH))
CONFUSED = _rx(X.CONFUSABLE_CLASS)
INVISIBLE = f"({ZW} OR {BIDI} OR {TAG})"
NARROW = _rx(X.ZERO_WIDTH_NARROW)
SHADOW = "shadow"  # set by findings()
INJECTED = "(" + " OR ".join(_rx(p, flags="i") for p in X.INJECTION) + ")"
# What makes subtitles and lyrics suspicious.
SCRIPTED = "(" + " OR ".join(_rx(p, flags="i") for p in [r"<\s*script\b", r"javascript\s*:", r"\bon(?:click|load|error|mouseover)\s*=", "data:text/html"]) + ")"
SUBTITLE = f"({SCRIPTED} OR {_rx(r'<\s*iframe\b', flags='i')})"
LYRIC = "(" + " OR ".join([SCRIPTED, *(_rx(p, flags="i") for p in ["ignore (?:all )?previous instruction", "disregard (?:all )?previous", r"system\s*:\s*you (?:are|must)"])]) + ")"
COLLAPSED = "regexp_replace(btrim(text), '\\\\s+', ' ')"

#: Units whose text a reader sees, scanned for hidden characters.
VISIBLE = ["line", "html_text", "csv_cell", "json_leaf", "docx_run", "xlsx_text", "pptx_text", "svg_line"]

DETECTORS: list[Detector] = [
    *(Detector("zero_width_chars", u, ZW, "0.9") for u in VISIBLE),
    *(Detector("tag_chars", u, TAG, "1.0", payload=SHADOW) for u in VISIBLE),
    *(Detector("bidi_control", u, BIDI, "0.9") for u in VISIBLE),
    *(Detector("mathematical_alphanumeric", u, MATH, "0.9") for u in ("svg_line", "pptx_text", "image_text")),
    Detector("zero_width_chars", "image_text", ZW, "0.85"),
    Detector("tag_chars", "image_text", TAG, "0.95"),
    Detector("bidi_control", "image_text", BIDI, "0.85"),
    Detector("zero_width_chars", "pdf_span", ZW, "0.8"),
    Detector("tag_chars", "pdf_span", TAG, "0.99"),
    Detector("bidi_control", "pdf_span", BIDI, "0.85"),
    # tables
    Detector("csv_formula_injection", "csv_cell", "substr(text, 1, 1) IN ('=', '+', '-', '@', '\\t', '\\r')", "CASE WHEN substr(text, 1, 1) = '=' THEN 0.95 ELSE 0.8 END"),
    Detector("csv_bidi_payload", "csv_cell", BIDI, "0.95"),
    Detector("csv_zero_width_payload", "csv_cell", ZW, "0.95"),
    Detector("csv_oversized_freetext_cell", "csv_cell", f"{N('row')} > 0 AND {N('data_rows')} >= 3 AND length(text) > 500 AND length(text) >= 10 * greatest(1, {N('median')})", "0.85"),
    Detector("csv_column_type_drift", "csv_cell", f"{N('row')} > 0 AND a['usual'] IN ('numeric', 'short_token') AND a['type'] = 'free_text' AND NOT {T('free_header')} AND length(text) > 50", "0.85", severity="CASE WHEN length(text) > 200 THEN NULL ELSE 0.1 END"),
    Detector("csv_payload_in_adjacent_cell", "csv_cell", f"{T('beside')} AND length(text) > 50", "0.85"),
    Detector("csv_oversized_field", "csv_cell", f"{N('bytes')} >= 1048576", "0.8"),
    Detector("csv_quoted_newline_payload", "csv_quoted", f"({N('newlines')} >= 2 AND length(text) > 128) OR ({N('newlines')} >= 3 AND length(text) > 256)", "0.85"),
    Detector("csv_null_byte", "csv_file", f"{N('nul')} > 0"),
    Detector("csv_bom_anomaly", "csv_file", f"{T('bom')} OR {T('inner_bom')}", f"CASE WHEN {T('inner_bom')} THEN 1.0 ELSE 0.7 END"),
    Detector("csv_mixed_encoding", "csv_encoding", "true", "0.8"),
    Detector("csv_mixed_delimiter", "csv_loser", "true", "0.75"),
    Detector("csv_comment_row", "csv_comment", "true", "0.85"),
    Detector("csv_quoting_anomaly", "csv_line", f"{N('odd_quotes')} = 1", "0.6"),
    Detector("csv_inconsistent_columns", "csv_width", "true", "0.9"),
    Detector("csv_encoding_divergence", "csv_divergent", "true", "0.9"),
    # JSON
    Detector("json_comment_anomaly", "json_comment", "true"),
    Detector("json_unicode_escape_payload", "json_escape", f"{NARROW} OR {BIDI}", "0.95"),
    Detector("json_trailing_payload", "json_rest", "true", "0.95"),
    Detector("excessive_nesting", "json_file", f"{N('depth')} >= 32", "0.9"),
    Detector("duplicate_keys", "json_twice", "true"),
    Detector("json_prototype_pollution_key", "json_key", "text IN ('__proto__', 'constructor', 'prototype')", "0.95"),
    Detector("json_key_invisible_chars", "json_key", f"{ZW} OR {BIDI}", "0.95"),
    Detector("json_oversized_string_band", "json_leaf", f"length(text) > 1000 AND {N('leaves')} >= 3 AND length(text) >= 5 * greatest(1, {N('median')})", "0.85"),
    Detector("json_nested_payload", "json_leaf", f"{N('depth')} >= 32 AND length(text) > 256", "0.9"),
    # HTML
    Detector("html_hidden_text", "html_text", T("hidden")),
    Detector("html_inline_script", "html_script", "true"),
    Detector("html_inline_script", "html_attr", "a['name'] rlike '^on.' AND btrim(text) <> ''"),
    Detector("html_data_attribute", "html_attr", "a['name'] rlike '^data-' AND length(text) >= 64", "0.8"),
    Detector("html_external_reference", "html_attr", f"{T('url')} AND {T('external')}", "0.9"),
    Detector("html_title_text_divergence", "html_title", f"length(text) > 80 OR (length(text) >= 40 AND NOT {T('in_body')})"),
    Detector("html_noscript_payload", "html_noscript", "text <> ''"),
    Detector("html_template_payload", "html_template", "text <> ''"),
    Detector("html_comment_payload", "html_comment", "NOT startswith(text, '[if') AND length(text) >= 32"),
    Detector("html_meta_payload", "html_meta", f"length(text) > 256 OR (a['name'] IN ('description', 'keywords', 'abstract', 'subject', 'summary', 'og:description', 'twitter:description') AND length(text) >= 16 AND NOT {T('in_body')})"),
    Detector("html_style_content_payload", "html_style", f"length(text) >= 16 AND (length(text) > 64 OR {T('suppressed')})"),
    # mail
    Detector("eml_multipart_alternative_divergence", "eml_alternatives", f"NOT ({N('plain')} < 6 AND {N('html')} < 6) AND {N('common')} < 0.5 * {N('union')}", "0.9"),
    Detector("eml_hidden_html_content", "eml_hidden", "true"),
    Detector("eml_display_name_spoof", "eml_name", f"{T('other_domain')} OR {T('brand')}", "0.9"),
    Detector("eml_encoded_subject_anomaly", "eml_encoded", f"{INVISIBLE} OR {MATH} OR {CONFUSED}", "0.95"),
    Detector("eml_from_replyto_mismatch", "eml_domains", f"a['name'] = 'reply-to' AND NOT {T('same')}", "0.9"),
    Detector("eml_returnpath_from_mismatch", "eml_domains", f"a['name'] = 'return-path' AND NOT {T('same')}", "0.9"),
    Detector("eml_received_chain_anomaly", "eml_received", f"NOT {T('shares')}", "0.85"),
    Detector("eml_base64_text_part", "eml_text", T("base64"), "0.95"),
    Detector("eml_executable_attachment", "eml_attachment", T("executable")),
    Detector("eml_macro_attachment", "eml_attachment", T("macro")),
    Detector("eml_nested_eml", "eml_attachment", T("message")),
    Detector("eml_attachment_present", "eml_attached", "true"),
    Detector("eml_external_reference", "eml_reference", "true", "0.9"),
    Detector("eml_smuggled_header", "eml_repeated", "true", "0.9"),
    Detector("eml_smuggled_header", "eml_header", T("broken"), "0.95"),
    Detector("eml_mime_boundary_anomaly", "eml_boundary", f"length(text) < 4 OR {N('n')} > 1", "CASE WHEN length(text) < 4 THEN 0.8 ELSE 0.85 END"),
    Detector("eml_header_continuation_payload", "eml_header", f"{N('folds')} >= 6 AND NOT {T('large_ok')}", "0.9"),
    Detector("eml_xheader_payload", "eml_header", f"startswith(a['name'], 'x-') AND NOT {T('large_ok')} AND length(text) >= 128", "0.9"),
    *(Detector(m, "eml_text", w, c) for m, w, c in (("zero_width_chars", ZW, "0.9"), ("tag_chars", TAG, "1.0"), ("bidi_control", BIDI, "0.9"))),
    # office
    *(Detector(f"{k}_vba_macros", f"{k}_member", T("macro")) for k in ("docx", "xlsx", "pptx")),
    *(Detector(f"{k}_embedded_object", f"{k}_member", T("embedded")) for k in ("docx", "xlsx", "pptx")),
    *(Detector(f"{k}_revision_history", f"{k}_member", T("revisions"), "0.95") for k in ("xlsx", "pptx")),
    *(Detector(f"{k}_external_link", f"{k}_member", T("external"), "0.9") for k in ("xlsx", "pptx")),
    *(Detector(f"{k}_external_link", f"{k}_rel", T("external"), "0.9") for k in ("xlsx", "pptx")),
    Detector("docx_external_relationship", "docx_rel", T("external"), "0.9"),
    Detector("docx_alt_chunk", "docx_rel", T("chunk"), "0.95"),
    Detector("docx_hidden_text", "docx_run", f"{T('vanish')} AND NOT {T('edge')}"),
    Detector("docx_white_text", "docx_run", f"{T('white')} AND NOT {T('edge')}"),
    Detector("docx_microscopic_font", "docx_run", f"{N('half_points')} <= 4 AND NOT {T('edge')}"),
    Detector("docx_header_footer_payload", "docx_run", f"{T('edge')} AND {T('white')}"),
    Detector("docx_header_footer_payload", "docx_run", f"{T('edge')} AND {N('half_points')} <= 4"),
    Detector("docx_revision_history", "docx_revisions", f"{N('ins')} + {N('del')} > 0", "0.95"),
    Detector("docx_comment_payload", "docx_comment", f"text <> '' AND NOT {T('referenced')}"),
    Detector("docx_comment_payload", "docx_comment", f"length(text) >= 16 AND NOT {T('in_body')}", "0.9"),
    Detector("docx_orphan_footnote", "docx_footnote", f"text <> '' AND NOT {T('referenced')}"),
    *(Detector(f"{k}_metadata_payload", f"{k}_meta", f"{N('bytes')} > 512 OR (NOT {T('exempt')} AND length(text) >= 16 AND NOT {T('in_body')})") for k in ("docx", "xlsx")),
    Detector("xlsx_hidden_row_column", "xlsx_hidden", f"{N('n')} > 0"),
    Detector("xlsx_hidden_sheet", "xlsx_sheet", "a['state'] IN ('hidden', 'veryHidden')"),
    Detector("xlsx_white_text", "xlsx_text", T("white")),
    Detector("xlsx_microscopic_font", "xlsx_text", f"{N('points')} <= 4.0"),
    Detector("xlsx_csv_injection_formula", "xlsx_formula", _rx(r"cmd\s*\||mshta\s*\||rundll32\s*\||powershell\s*\||\bDDE\s*\(", flags="i")),
    Detector("xlsx_csv_injection_formula", "xlsx_formula", _rx(r'HYPERLINK\s*\(\s*\"[a-zA-Z][a-zA-Z0-9+.-]*://[^\"]+\"\s*,\s*\"[^\"]{16,}\"\s*\)', flags="i"), tier="2"),
    Detector("xlsx_data_validation_formula", "xlsx_validation", _rx(r"(?:INDIRECT|HYPERLINK|WEBSERVICE|IMPORT[A-Z]*)\s*\(", flags="i"), "0.85"),
    Detector("xlsx_defined_name_payload", "xlsx_name", "text rlike '^\".+\"$' OR (length(text) >= 16 AND NOT text rlike '^[=+@$#-]' AND NOT text rlike '[!$]')"),
    Detector("xlsx_comment_payload", "xlsx_comment", "length(text) >= 16"),
    Detector("pptx_hidden_slide", "pptx_slide", f"NOT {T('shown')}"),
    Detector("pptx_speaker_notes_injection", "pptx_notes", INJECTED, "0.85"),
    Detector("pptx_slide_master_injection", "pptx_text", f"{T('master')} AND NOT {T('placeholder')} AND length(btrim(text)) >= 16", "0.85"),
    Detector("pptx_action_hyperlink", "pptx_action", "lower(text) rlike '^(ppaction://|macro:|vbascript:)'", "0.9"),
    Detector("pptx_custom_xml_payload", "pptx_member", f"{T('custom')} AND {N('size')} >= 80", "0.8"),
    # pictures
    Detector("image_text_metadata", "image_text", T("readable"), "0.6", payload=f"substr({COLLAPSED}, 1, 80)"),
    Detector("high_entropy_metadata", "image_text", f"{N('bytes')} >= 64 AND {N('entropy')} > 7.0", "0.7", payload=f"concat(a['bytes'], '-byte high-entropy payload ', format_number({N('entropy')}, 2))"),
    Detector("generative_cipher_signature", "image_text", f"{N('bytes')} >= 64 AND {N('entropy')} > 7.0 AND ({_rx(X.BASE64_RUN)} OR {_rx(X.HEX_RUN)})", "0.85", payload=f"substr(regexp_extract(text, '{X.BASE64_RUN}|{X.HEX_RUN}', 0), 1, 60)"),
    Detector("image_png_text_chunk_payload", "image_text", f"substr(loc, 3, 2) = 'Xt' AND {N('chars')} > 1024", "0.9"),
    Detector("image_png_text_chunk_payload", "image_text", f"substr(loc, 3, 2) = 'Xt' AND ({BIDI} OR {NARROW})", "0.95"),
    Detector("image_png_text_chunk_payload", "image_text", "substr(loc, 3, 2) = 'Xt' AND text rlike 'HIDDEN_|BATIN_|ZAHIR_|PAYLOAD'", "0.9"),
    Detector("suspicious_image_chunk", "png_chunk", f"NOT {T('standard')}", "0.75"),
    Detector("suspicious_image_chunk", "jpeg_segment", f"NOT {T('standard')}", "0.75"),
    Detector("oversized_metadata", "png_chunk", f"{T('meta')} AND {N('bytes')} > 65536", "0.9"),
    Detector("oversized_metadata", "jpeg_segment", f"{N('bytes')} > 65535", "0.9"),
    Detector("image_png_private_chunk", "png_chunk", f"{T('private')} AND length(text) >= 32 AND {N('density')} >= 0.7", "0.75"),
    Detector("image_png_private_chunk", "png_chunk", f"{T('private')} AND length(text) >= 32 AND {N('density')} >= 0.7 AND ({BIDI} OR {NARROW} OR length(text) > 1024)", "0.9", tier="1"),
    Detector("image_jpeg_appn_payload", "jpeg_segment", f"{N('marker')} BETWEEN 228 AND 239 AND length(text) >= 32 AND {N('density')} >= 0.7", "0.9"),
    Detector("multiple_idat_streams", "png_runs", f"{N('broken')} > 0", "0.8"),
    Detector("trailing_data", "trailing", f"{N('bytes')} >= 4"),
    Detector("suspected_lsb_steganography", "lsb", f"{N('off')} <= 0.01", "0.5"),
    Detector("svg_embedded_script", "svg_element", "a['tag'] = 'script'", payload="substr(text, 1, 80)"),
    Detector("svg_foreign_object", "svg_element", "a['tag'] = 'foreignObject'", "0.9"),
    Detector("svg_event_handler", "svg_attr", "a['name'] rlike '^on.'", "0.95"),
    Detector("svg_external_reference", "svg_attr", "a['name'] = 'href' AND lower(btrim(text)) rlike '^(https?|ftp)://'", "0.9", payload="text"),
    Detector("svg_embedded_data_uri", "svg_attr", "a['name'] = 'href' AND startswith(lower(btrim(text)), 'data:')", "0.95", payload="concat('data: URI (', length(text), ' chars)')"),
    Detector("svg_hidden_text", "svg_element", T("hidden"), "0.95", payload="substr(text, 1, 60)"),
    Detector("svg_microscopic_text", "svg_element", T("small"), "0.9", payload="substr(text, 1, 60)"),
    Detector("svg_white_text", "svg_element", T("white")),
    Detector("svg_title_payload", "svg_element", f"a['tag'] = 'title' AND {N('bytes')} > 64", "0.85"),
    Detector("svg_desc_payload", "svg_element", f"a['tag'] = 'desc' AND {N('bytes')} > 256", "0.85"),
    Detector("svg_metadata_payload", "svg_element", f"a['tag'] = 'metadata' AND {N('bytes')} > 128", "0.85"),
    Detector("svg_defs_unreferenced_text", "svg_element", T("lost"), "0.9"),
    # video and audio
    Detector("video_stream_inventory", "video_file", "true"),
    Detector("video_container_anomaly", "video_file", f"{N('boxes')} = 0 OR {N('rest')} > 0", "0.9"),
    Detector("video_container_anomaly", "video_anomaly", "true", "0.9"),
    Detector("video_embedded_attachment", "video_attachment", "a['kind'] <> ''", "0.92"),
    Detector("video_metadata_suspicious", "video_tag", f"{INVISIBLE} OR {CONFUSED} OR {_rx('[A-Za-z0-9+/]{80,}={0,2}')}", "0.9"),
    Detector("subtitle_injection", "subtitle", SUBTITLE, "0.95"),
    Detector("subtitle_invisible_chars", "subtitle", f"{INVISIBLE} OR {CONFUSED}", "0.95"),
    Detector("audio_stem_inventory", "audio_file", "true"),
    Detector("audio_metadata_injection", "audio_tag", f"NOT {T('lyric')} AND ({INVISIBLE} OR {CONFUSED})", "0.95"),
    Detector("audio_lyrics_prompt_injection", "audio_tag", f"{T('lyric')} AND {LYRIC}", "0.92"),
    Detector("audio_metadata_identity_anomaly", "audio_identity", f"{T('marked')} OR {T('same')}", f"CASE WHEN {T('marked')} THEN 0.95 ELSE 0.75 END"),
    Detector("audio_high_entropy_metadata", "audio_tag", f"length(text) >= 128 AND {N('entropy')} >= 6.0", "0.85"),
    Detector("audio_container_anomaly", "audio_anomaly", "true", "CASE a['what'] WHEN 'tail' THEN 0.7 WHEN 'rest' THEN 0.9 ELSE 0.85 END"),
    Detector("audio_embedded_payload", "audio_foreign", "true", "CASE WHEN text <> '' THEN 0.95 ELSE 0.75 END"),
    Detector("audio_lsb_stego_candidate", "audio_lsb", f"{N('off')} < 0.02 AND {N('kinds')} > 32", "0.65"),
    # PDF
    Detector("invisible_render_mode", "pdf_invisible", "true", f"CASE WHEN {T('drawn')} THEN 0.95 ELSE 0.6 END", f"CASE WHEN {T('drawn')} THEN NULL ELSE 3 END", f"CASE WHEN {T('drawn')} THEN NULL ELSE 0.05 END"),
    Detector("white_on_white_text", "pdf_span", f"{N('light')} >= 0.95 AND NOT {T('dark_behind')} AND btrim(text) <> ''", "0.9"),
    Detector("microscopic_font", "pdf_span", f"{N('size')} > 0 AND {N('size')} < 1.0", "0.8"),
    Detector("off_page_text", "pdf_span", f"{T('outside')} AND btrim(text) <> ''", "0.9"),
    Detector("pdf_off_page_text", "pdf_origin", T("outside")),
    Detector("pdf_hidden_text_annotation", "pdf_note", f"text <> '' AND (cast({N('flags')} AS INT) & 546) <> 0"),
    Detector("javascript", "pdf_file", T("javascript"), "0.99"),
    Detector("openaction", "pdf_file", T("open_action"), "0.9"),
    Detector("additional_actions", "pdf_file", T("additional"), "0.85"),
    Detector("launch_action", "pdf_file", T("launch"), "0.95"),
    Detector("embedded_file", "pdf_embedded", "true", "0.95"),
    Detector("file_attachment_annot", "pdf_file", T("attachment"), "0.95"),
    Detector("incremental_update", "pdf_file", f"{N('eofs')} >= 2", "0.7"),
    Detector("metadata_anomaly", "pdf_dates", T("before"), "0.6"),
    Detector("hidden_ocg", "pdf_file", T("hidden_layers"), "0.8"),
    Detector("tounicode_anomaly", "pdf_cmap", f"{INVISIBLE} OR {CONFUSED}", "0.9"),
    Detector("pdf_metadata_analyzer", "pdf_field", f"{N('bytes')} > 512"),
    Detector("pdf_metadata_analyzer", "pdf_field", BIDI),
    Detector("pdf_metadata_analyzer", "pdf_field", NARROW),
    Detector("pdf_metadata_analyzer", "pdf_field", f"{T('compared')} AND length(btrim(text)) >= 16 AND NOT {T('in_text')}"),
    Detector("pdf_trailer_analyzer", "pdf_file", f"{N('rest')} > 0"),
    # files as such
    Detector("extension_mismatch", "file", f"{T('mismatch')} AND a['kind'] <> 'pdf'"),
    Detector("format_routing_divergence", "file", f"{T('mismatch')} OR {N('length')} < 16 OR a['kind'] = 'unknown' OR {T('other_office')}"),
    Detector("unknown_format", "file", "a['kind'] = 'unknown'"),
    Detector("scan_limited", "scan_limited", "true"),
    Detector("scan_error", "scan_error", "true"),
]

#: Units whose words are tested for confusable letters, with the confidence of a finding.
WORDED = {**{u: 0.85 for u in VISIBLE}, "eml_text": 0.85, "image_text": 0.85, "pdf_span": 0.8}

#: What a finding in a picture that a media file carries becomes: unit and mechanism, by the kind of the carrier.
CARRIED = {"video": ("cover_finding", "video_frame_stego_candidate"), "audio": ("audio_picture", "audio_embedded_payload")}


def carried(found: DataFrame) -> DataFrame:
    """findings with ``parent``, the kind of the carrier: those of carried pictures are their carrier's, with its severity and tier."""
    inside = F.col("parent").isin(*CARRIED) & ~F.col("unit").startswith("scan_") & F.col("mechanism").isNotNull()
    of = lambda i: reduce(lambda c, kv: c.when(F.col("parent") == kv[0], kv[1][i]), CARRIED.items(), F.when(F.lit(False), ""))
    new = {c: F.when(inside, of(i)).otherwise(F.col(c)) for i, c in enumerate(("unit", "mechanism"))}
    return found.withColumns(new | {c: F.when(~inside, F.col(c)) for c in ("tier_override", "severity_override", "payload")}).drop("parent")


def findings(units: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """units(file_id, kind, unit, ord, loc, text, a) -> one row a finding, trig the place of its detector."""
    return findings_and(units, (), detectors).drop("text", "a")


def findings_and(units: DataFrame, kept: tuple[str, ...], detectors: list[Detector] | None = None) -> DataFrame:
    """findings, and for each unit of the kinds ``kept`` a row without a mechanism, with its text and attributes.

    One pass over the units, after which no other unit is needed: what comes out is narrow."""
    kind = "struct<mechanism:string,confidence:double,tier_override:int,severity_override:double,concealed:string,payload:string,trig:int>"
    by: dict[str, list[tuple[int, Detector]]] = {}
    for i, d in enumerate(DETECTORS if detectors is None else detectors):
        by.setdefault(d.unit, []).append((i, d))

    def row(i: int, d: Detector) -> str:
        return f"CASE WHEN {d.when} THEN named_struct('mechanism', '{d.mechanism}', 'confidence', cast({d.confidence} AS DOUBLE), 'tier_override', cast({d.tier} AS INT), 'severity_override', cast({d.severity} AS DOUBLE), 'concealed', substr(text, 1, 240), 'payload', cast({d.payload} AS STRING), 'trig', {i}) END"

    u = units.withColumn("shadow", F.when(F.col("text").rlike(X.TAG), X.tag_shadow(F.col("text"))))
    pick = reduce(lambda c, kv: c.when(F.col("unit") == kv[0], F.expr(f"array({', '.join(row(i, d) for i, d in kv[1])})")), by.items(), F.when(F.lit(False), F.expr(f"cast(array() AS array<{kind}>)")))
    worded = F.when(F.col("unit").isin(*WORDED), X.homoglyph_words(F.col("text")))
    conf = reduce(lambda c, kv: c.when(F.col("unit") == kv[0], kv[1]), WORDED.items(), F.when(F.lit(False), 0.0))
    letters = F.transform(worded, lambda w: F.struct(F.lit("homoglyph").alias("mechanism"), conf.cast("double").alias("confidence"), F.lit(None).cast("int").alias("tier_override"), F.lit(None).cast("double").alias("severity_override"), w["recovered"].alias("concealed"), F.lit(None).cast("string").alias("payload"), F.lit(900).alias("trig")))
    empty = F.expr(f"cast(array() AS array<{kind}>)")
    keep = F.col("unit").isin(*kept)
    bare = F.when(keep, F.expr(f"array(cast(named_struct('mechanism', NULL, 'confidence', NULL, 'tier_override', NULL, 'severity_override', NULL, 'concealed', NULL, 'payload', NULL, 'trig', NULL) AS {kind}))")).otherwise(empty)
    both = F.concat(F.filter(F.coalesce(pick, empty), lambda x: x.isNotNull()), F.coalesce(letters, empty), *([bare] if kept else []))
    own = [F.when(keep, F.col(c)).alias(c) for c in ("text", "a")]
    return carried(u.select("file_id", "kind", "unit", "ord", F.col("loc").alias("location"), *own, F.coalesce(F.col("a")["parent"], F.lit("")).alias("parent"), F.inline(both)))
