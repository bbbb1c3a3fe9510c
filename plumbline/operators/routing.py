"""Which format a file is: signatures first, then sniffing, then its extension."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

HEAD = 65_536
# Extensions by kind, and signatures in the order in which they are tried.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "html": "html htm", "markdown": "md markdown", "json": "json", "png": "png", "jpeg": "jpg jpeg", "svg": "svg svgz", "eml": "eml", "csv": "csv tsv psv",
    "mp4": "mp4 m4v", "mov": "mov", "webm": "webm", "mkv": "mkv", "mp3": "mp3", "wav": "wav wave", "flac": "flac", "m4a": "m4a m4b", "ogg": "ogg oga opus", "code": "txt py js ts tsx jsx go rs java c cpp h hpp rb",
}
KIND_OF = {e: k for k, v in EXTENSIONS.items() for e in v.split()}
SIGNATURES = [(b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"\x1aE\xdf\xa3", "mkv"), (b"ID3", "mp3"), (b"fLaC", "flac"), (b"OggS", "ogg")]
HEADERS = {*"from to cc bcc subject date message-id mime-version received return-path delivered-to reply-to sender x-mailer x-originating-ip dkim-signature authentication-results list-unsubscribe in-reply-to references".split()}
MARKERS = {"docx": b"word/document.xml", "xlsx": b"xl/workbook.xml", "pptx": b"ppt/presentation.xml"}
TEXTUAL = {"html", "markdown", "json", "svg", "eml", "csv", "code"}
FLOOR = 16


def extension(name: str) -> str:
    return name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def _table(head: bytes) -> bool:
    rows = [x for x in head.decode("utf-8", "replace").split("\n") if x.strip()][:6]
    if len(rows) < 2:
        return False
    for d in "\t|,":
        n = rows[0].count(d)
        if n >= 2 and sum(abs(r.count(d) - n) <= 1 for r in rows[1:]) >= max(2, (len(rows) - 1) // 2):
            return True
    return False


def _sniffed(head: bytes, ext: str) -> str:
    for magic, kind in SIGNATURES:
        if head.startswith(magic):
            return "webm" if kind == "mkv" and ext == "webm" else kind
    if head[4:8] == b"ftyp":
        brand = head[8:12]
        return "m4a" if brand[:3] in (b"M4A", b"M4B") else "mov" if brand[:2] == b"qt" else "mp4"
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    if ext == "mp3" and len(head) > 1 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        return "mp3"
    if head.startswith(b"PK\x03\x04"):
        if ext == "docx":
            return "docx"
        for kind in ("xlsx", "pptx"):
            if ext == kind or MARKERS[kind] in head:
                return kind
    low = head.lstrip().lower()
    if low.startswith(b"<svg") or low.startswith(b"<?xml") and b"<svg" in low[:1024]:
        return "svg"
    if low.startswith((b"<!doctype html", b"<html")):
        return "html"
    first = re.match(rb"([!-9;-~]+):", head)
    if head.startswith(b"From ") or first and first[1].decode().lower() in HEADERS:
        return "eml"
    if low[:1] in (b"{", b"["):
        try:
            json.loads(head)
            return "json"
        except ValueError:
            pass
    return "csv" if ext not in KIND_OF and _table(head) else ""


def route(raw: bytes, name: str) -> tuple[str, str, bool]:
    """(kind, reason, whether a known extension says otherwise)."""
    ext = extension(name)
    claimed = KIND_OF.get(ext, "")
    kind = _sniffed(raw[:HEAD], ext)
    if kind:
        soft = kind in TEXTUAL and claimed in TEXTUAL | {"markdown", "code"}
        if soft:
            return claimed, "extension", False
        return kind, "signature", bool(claimed) and claimed != kind
    if claimed in TEXTUAL:
        return claimed, "extension", False
    if claimed in ("mp4", "mov", "webm", "mkv", "mp3", "wav", "flac", "m4a", "ogg"):
        return claimed, "extension without signature", True
    if claimed == "pdf":
        return "pdf", "extension", False
    return "unknown", "nothing known", False


def other_office(raw: bytes, kind: str) -> bool:
    """The archive has the main part of another office kind and not its own."""
    head = raw[:HEAD]
    return kind in MARKERS and head.startswith(b"PK\x03\x04") and MARKERS[kind] not in head and any(m in head for k, m in MARKERS.items() if k != kind)


def kind_column(head, ext):
    """Signature routing as a column over hexadecimal heads, for files that are rows already; text kinds by extension."""
    out = None
    for magic, kind in SIGNATURES:
        fits = F.startswith(head, F.lit(magic.hex().upper()))
        value = F.when(ext == "webm", "webm").otherwise("mkv") if kind == "mkv" else F.lit(kind)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    out = out.when(F.substring(head, 9, 8) == b"ftyp".hex().upper(), F.when(F.substring(head, 17, 6).isin(b"M4A".hex().upper(), b"M4B".hex().upper()), "m4a").when(F.substring(head, 17, 4) == b"qt".hex().upper(), "mov").otherwise("mp4"))
    out = out.when((F.substring(head, 1, 8) == b"RIFF".hex().upper()) & (F.substring(head, 17, 8) == b"WAVE".hex().upper()), "wav")
    for kind, exts in EXTENSIONS.items():
        out = out.when(ext.isin(exts.split()), kind)
    return out.otherwise("unknown")


__all__ = ["HEAD", "KIND_OF", "extension", "kind_column", "other_office", "route"]
