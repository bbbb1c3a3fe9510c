"""Units of binary containers: office archives, pictures, video, audio and PDF; standard library and numpy only."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np

# Signatures of files inside files.
FOREIGN = [(b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"PK\x03\x04", "zip"), (b"<!DOCTYPE html", "html"), (b"<script", "html script"), (b"MZ", "windows executable"), (b"\x7fELF", "elf executable")]
PNG_CHUNKS = {*"IHDR PLTE IDAT IEND tRNS cHRM gAMA iCCP sBIT sRGB cICP mDCv cLLi tEXt zTXt iTXt bKGD hIST pHYs sPLT eXIf tIME acTL fcTL fdAT".split()}
JPEG_MARKERS = {*range(0xC0, 0xD0), *range(0xD0, 0xDF), *range(0xE0, 0xF0), 0xFE, 0x01}
SVG_INVISIBLE = {"opacity": {"0", "0.0", "0.00"}, "fill-opacity": {"0", "0.0", "0.00"}, "display": {"none"}, "visibility": {"hidden", "collapse"}, "fill": {"none", "transparent"}}
NEAR_WHITE = {"ffffff", "fefefe", "fdfdfd", "fcfcfc"}
EXEMPT = {*"created modified lastmodifiedby creator revision template totaltime pages words characters application docsecurity lines paragraphs scalecrop company linksuptodate characterswithspaces shareddoc hyperlinkschanged appversion language".split()}
PLACEHOLDERS = re.compile(r"click to edit|click to add|click icon|second level|third level|fourth level|fifth level|master (title|text|subtitle)", re.I)


def entropy(b: bytes) -> float:
    if not b:
        return 0.0
    p = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / len(b)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def density(text: str) -> float:
    return sum(32 <= ord(c) < 127 or c in "\t\n\r" for c in text) / len(text) if text else 0.0


def local(tag) -> str:
    return str(tag).rpartition("}")[2]


def attr(e, name: str, default=None):
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def inner_text(e) -> str:
    return "".join(e.itertext())


# ---- office archives


def office(raw: bytes, kind: str):
    top = {"docx": "word/", "xlsx": "xl/", "pptx": "ppt/"}[kind]
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        names = sorted(n for n in z.namelist() if not n.endswith("/"))
    except zipfile.BadZipFile as e:
        yield "scan_error", "file", str(e), {}
        return

    def xml(name):
        try:
            return ET.fromstring(z.open(name).read(32 << 20)) if name in names else None
        except ET.ParseError:
            return None

    def part(pattern):
        return [(n, e) for n in names if re.fullmatch(pattern, n) and (e := xml(n)) is not None]

    for n in names:
        yield f"{kind}_member", n, n, {"size": z.getinfo(n).file_size, "macro": n.endswith("vbaProject.bin"), "embedded": n.startswith(top + "embeddings/"), "revisions": kind == "xlsx" and n.startswith("xl/revisions/") or kind == "pptx" and bool(re.search(r"commentAuthors|/comments/|revisionInfo|/revisions/", n)), "external": n.startswith(top + "externalLinks/"), "custom": bool(re.fullmatch(r"customXml/(?!itemProps1?\.xml)[^/]*\.xml", n))}
    for n, e in part(r".*\.rels"):
        for r in e:
            yield f"{kind}_rel", n, r.get("Target", ""), {"external": r.get("TargetMode") == "External", "chunk": r.get("Type", "").endswith("/aFChunk")}
    shown = []
    if kind == "docx":
        doc = xml("word/document.xml")
        back = next((attr(e, "color") for e in doc.iter() if local(e.tag) == "background"), None) if doc is not None else None
        canvas_white = back is None or back.lower() in NEAR_WHITE
        for n, root in part(r"word/(?:document|(?:header|footer)\d*)\.xml"):
            edge = "document" not in n
            for i, r in enumerate(e for e in root.iter() if local(e.tag) == "r"):
                text = "".join(t.text or "" for t in r if local(t.tag) == "t")
                pr = next((p for p in r if local(p.tag) == "rPr"), None)
                of = {local(p.tag): attr(p, "val") for p in pr} if pr is not None else {}
                if not edge:
                    shown.append(text)
                if text:
                    size = float(of["sz"]) if re.fullmatch(r"[\d.]+", of.get("sz") or "") else 99
                    yield "docx_run", f"{n} run {i}", text, {"vanish": "vanish" in of and of["vanish"] not in ("0", "false"), "white": (of.get("color") or "").lower() in NEAR_WHITE and canvas_white, "half_points": size, "edge": edge}
            if not edge:
                n_rev = {k: sum(local(e.tag) == k for e in root.iter()) for k in ("ins", "del")}
                yield "docx_revisions", n, "", n_rev
        body = "".join(shown)
        refs = {k: {attr(e, "id") for _, root in part(r"word/(?:document|header\d*|footer\d*)\.xml") for e in root.iter() if local(e.tag) in k} for k in (("commentReference", "commentRangeStart"), ("footnoteReference",))}
        for n, root in part(r"word/comments\.xml"):
            for e in root:
                t = inner_text(e).strip()
                yield "docx_comment", f"comment {attr(e, 'id')}", t, {"referenced": attr(e, "id") in refs[("commentReference", "commentRangeStart")], "in_body": t in body}
        for n, root in part(r"word/footnotes\.xml"):
            for e in root:
                if attr(e, "type") not in ("separator", "continuationSeparator"):
                    yield "docx_footnote", f"footnote {attr(e, 'id')}", inner_text(e).strip(), {"referenced": attr(e, "id") in refs[("footnoteReference",)]}
    if kind == "xlsx":
        styles = xml("xl/styles.xml")
        fonts, uses = [], []
        if styles is not None:
            for e in styles.iter():
                if local(e.tag) == "fonts":
                    fonts = [{local(p.tag): attr(p, "rgb") if local(p.tag) == "color" else attr(p, "val") for p in f} for f in e]
                if local(e.tag) == "cellXfs":
                    uses = [int(attr(x, "fontId", "0")) for x in e]
        wb = xml("xl/workbook.xml")
        for e in wb.iter() if wb is not None else ():
            if local(e.tag) == "sheet":
                yield "xlsx_sheet", e.get("name", ""), e.get("name", ""), {"state": e.get("state", "visible")}
            if local(e.tag) == "definedName":
                yield "xlsx_name", e.get("name", ""), (e.text or "").strip(), {}
        for n, root in part(r"xl/sharedStrings\.xml"):
            for i, e in enumerate(root):
                shown.append(inner_text(e))
                yield "xlsx_text", f"string {i}", inner_text(e), {}
        for n, root in part(r"xl/worksheets/[^/]*\.xml"):
            hidden = sum(e.get("hidden") in ("1", "true") for e in root.iter() if local(e.tag) in ("row", "col"))
            yield "xlsx_hidden", n, str(hidden), {"n": hidden}
            for e in root.iter():
                if local(e.tag) == "dataValidation":
                    yield "xlsx_validation", n, " ".join(x.text or "" for x in e if local(x.tag) in ("formula1", "formula2")), {}
                if local(e.tag) == "c":
                    t = "".join(x.text or "" for x in e.iter() if local(x.tag) == "t")
                    f = next((x.text or "" for x in e if local(x.tag) == "f"), "")
                    shown.append(t)
                    if f:
                        yield "xlsx_formula", f"{n}!{e.get('r')}", f, {}
                    if t:
                        s = int(e.get("s", "0"))
                        font = fonts[uses[s]] if s < len(uses) and uses[s] < len(fonts) else {}
                        yield "xlsx_text", f"{n}!{e.get('r')}", t, {"white": (font.get("color") or "")[-6:].lower() in NEAR_WHITE, "points": font.get("sz") or 99}
        for n, root in [*part(r"xl/comments[^/]*\.xml"), *part(r"xl/threadedComments/[^/]*\.xml")]:
            for e in root.iter():
                if local(e.tag) in ("comment", "threadedComment"):
                    yield "xlsx_comment", f"{n}!{e.get('ref')}", inner_text(e).strip(), {}
    if kind == "pptx":
        deck = xml("ppt/presentation.xml")
        for e in deck.iter() if deck is not None else ():
            if local(e.tag) == "sldId":
                yield "pptx_slide", f"slide id {e.get('id')}", "", {"shown": e.get("show", "1") not in ("0", "false")}
        for n, root in part(r"ppt/slides/[^/]*\.xml"):
            yield "pptx_slide", n, "", {"shown": root.get("show", "1") not in ("0", "false")}
        for n, root in part(r"ppt/(?:slides|notesSlides|slideMasters|slideLayouts)/[^/]*\.xml"):
            where = n.split("/")[1]
            runs = [e.text or "" for e in root.iter() if local(e.tag) == "t"]
            for i, t in enumerate(runs):
                if t:
                    yield "pptx_text", f"{n} run {i}", t, {"master": where in ("slideMasters", "slideLayouts"), "placeholder": bool(PLACEHOLDERS.search(t))}
            if where == "notesSlides":
                yield "pptx_notes", n, " ".join(runs), {}
            for e in root.iter():
                if local(e.tag) in ("hlinkClick", "hlinkMouseOver") and e.get("action"):
                    yield "pptx_action", n, e.get("action"), {}
    body = " ".join(shown) if kind == "xlsx" else "".join(shown)
    if kind in ("docx", "xlsx"):
        for n, root in part(r"docProps/(?:core|app|custom)\.xml"):
            for e in root.iter():
                t = (e.text or "").strip()
                if t and not len(e):
                    yield f"{kind}_meta", f"{n} {local(e.tag)}", t, {"exempt": local(e.tag).lower() in EXEMPT, "in_body": t in body, "bytes": len(t.encode())}


# ---- pictures


def svg(raw: bytes):
    text = raw.decode("utf-8", "replace")
    for i, line in enumerate(text.split("\n"), 1):
        yield "svg_line", f"line {i}", line, {}
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        yield "scan_error", "file", str(e), {}
        return
    size = (root.get("width"), root.get("height"))
    rect = next((e for e in root.iter() if local(e.tag) == "rect" and e.get("x", "0") in ("0", "") and e.get("y", "0") in ("0", "") and (e.get("width"), e.get("height")) in (size, ("100%", "100%"))), None)
    canvas_white = rect is None or colour(rect.get("fill", "white")) in NEAR_WHITE
    used = {v.lstrip("#") for e in root.iter() if local(e.tag) == "use" for k, v in e.attrib.items() if local(k) == "href"}
    in_defs = {id(x) for e in root.iter() if local(e.tag) == "defs" for x in e.iter()}
    for e in root.iter():
        tag, t = local(e.tag), " ".join(inner_text(e).split()) if isinstance(e.tag, str) else ""
        a = {local(k): v for k, v in e.attrib.items()}
        style = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in a.get("style", "").split(";"))}
        both = a | style
        words = tag in ("text", "tspan", "textPath") and bool(t)
        size_of = re.match(r"\s*([\d.]+)", both.get("font-size", ""))
        yield "svg_element", tag, t, {
            "tag": tag, "words": words, "hidden": words and any(str(both.get(k, "")).lower() in v for k, v in SVG_INVISIBLE.items()), "small": words and bool(size_of) and float(size_of[1]) <= 1.0,
            "white": tag == "text" and bool(t) and colour(both.get("fill", "")) in NEAR_WHITE and canvas_white, "bytes": len(inner_text(e).strip().encode()) if isinstance(e.tag, str) else 0,
            "lost": tag == "text" and bool(t) and id(e) in in_defs and a.get("id") not in used,
        }
        for k, v in a.items():
            yield "svg_attr", f"{tag}@{k}", v, {"name": k}


def colour(v: str) -> str:
    v = v.strip().lower()
    if v == "white":
        return "ffffff"
    if m := re.fullmatch(r"#([0-9a-f]{3})", v):
        return "".join(c * 2 for c in m[1])
    if m := re.fullmatch(r"#([0-9a-f]{6})(?:[0-9a-f]{2})?", v):
        return m[1]
    if m := re.fullmatch(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+).*\)", v):
        return "".join(f"{min(255, int(x)):02x}" for x in m.groups())
    return v


def picture_text(where: str, payload: bytes, text: str | None = None):
    t = payload.decode("utf-8", "replace") if text is None else text
    yield "image_text", where, t, {"readable": bool(re.search(rb"[ -~]{4}", payload) or re.search(r"[ -~]{4}", t)), "bytes": len(payload), "chars": len(t.encode("utf-8", "replace")), "entropy": entropy(payload)}


def png(raw: bytes):
    at, end, idat, gap, pixels = 8, None, False, False, b""
    broken = 0
    while at + 12 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        name, body = kind.decode("latin-1"), raw[at + 8 : at + 8 + n]
        text = body.partition(b"\0")[2].lstrip(b"\0").decode("latin-1") if name == "tEXt" else body.decode("utf-8", "replace").strip("\0 ")
        yield "png_chunk", f"offset {at}", text, {"type": name, "standard": name in PNG_CHUNKS, "bytes": n, "private": len(name) == 4 and name[0].islower() and name[1].islower(), "density": density(text), "meta": name != "IDAT"}
        if name in ("tEXt", "zTXt", "iTXt"):
            key, _, rest = body.partition(b"\0")
            value = rest
            try:
                if name == "zTXt":
                    value = zlib.decompress(rest[1:])
                elif name == "iTXt":
                    packed = rest[:1] == b"\x01"
                    value = rest[2:].split(b"\0", 2)[2]
                    value = zlib.decompress(value) if packed else value
            except (zlib.error, IndexError):
                pass
            yield from picture_text(f"{name} {key.decode('latin-1')}", value, value.decode("latin-1") if name == "tEXt" and not _utf8(value) else None)
        if name == "IDAT":
            broken += gap and idat
            idat, gap, pixels = True, False, pixels + body
        elif idat and name != "IEND":
            gap = True
        at += 12 + n
        if name == "IEND":
            end = at
            break
    yield "png_runs", "file", "", {"broken": broken}
    if end is not None:
        yield "trailing", "file", raw[end:][:200].decode("latin-1"), {"bytes": len(raw) - end}
    try:
        flat = zlib.decompress(pixels)
        if len(flat) >= 2048:
            yield "lsb", "file", "", {"off": abs(float((np.frombuffer(flat, np.uint8) & 1).mean()) - 0.5)}
    except zlib.error:
        pass


def _utf8(b: bytes) -> bool:
    try:
        b.decode()
        return True
    except UnicodeDecodeError:
        return False


def jpeg(raw: bytes):
    at, end = 2, None
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xD9:
            end = at + 2
            break
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        n = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + n]
        text = body.replace(b"\0", b"").decode("utf-8", "replace").strip()
        yield "jpeg_segment", f"offset {at}", text, {"marker": marker, "standard": marker in JPEG_MARKERS, "bytes": len(body), "density": density(text)}
        if marker in (0xFE, 0xE1, 0xED):
            yield from picture_text(f"segment {marker:02X}", body)
        at += 2 + n
        if marker == 0xDA:
            end = raw.rfind(b"\xff\xd9")
            end = end + 2 if end >= 0 else None
            break
    if end is not None:
        yield "trailing", "file", raw[end:][:200].decode("latin-1"), {"bytes": len(raw) - end}


# ---- video and audio


def boxes(raw: bytes, at: int = 0, end: int | None = None):
    end = len(raw) if end is None else end
    while at + 8 <= end:
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack(">Q", raw[at + 8 : at + 16])[0], 16
        n = end - at if n == 0 else n
        if n < head or at + n > end:
            return
        yield kind.decode("latin-1"), at, at + head, at + n
        at += n


def foreign(b: bytes, within: int = 0) -> str:
    return next((name for magic, name in FOREIGN if b.startswith(magic) or within and len(magic) > 3 and magic in b[:within]), "")


def video(raw: bytes):
    if raw[:4] == b"\x1aE\xdf\xa3":
        yield "video_file", "file", "", {"boxes": 1, "rest": 0}
        yield "video_attachment", "file", "", {"kind": "matroska" if b"\x19\x41\xa4\x69" in raw else ""}
        return
    if raw[4:8] != b"ftyp":
        yield "video_anomaly", "file", "unknown signature", {}
        return
    top = list(boxes(raw))
    last = max((e for *_, e in top), default=0)
    yield "video_file", "file", ", ".join(k for k, *_ in top), {"boxes": len(top), "rest": len(raw) - last}

    def walk(at, end, path=""):
        for kind, start, body, stop in boxes(raw, at, end):
            yield path + kind, start, body, stop
            if kind in ("moov", "trak", "mdia", "minf", "stbl", "udta", "ilst", "edts", "dinf"):
                yield from walk(body, stop, path + kind + "/")
            elif kind == "meta":
                yield from walk(body + 4, stop, path + "meta/")
            elif path.endswith("ilst/"):
                yield from walk(body, stop, path + kind + "/")

    handler = ""
    for path, start, body, stop in walk(0, len(raw)):
        kind, data = path.rpartition("/")[2], raw[body:stop]
        if kind == "hdlr":
            handler = data[8:12].decode("latin-1")
        if kind in ("free", "skip", "uuid"):
            yield "video_attachment", f"{kind} at {start}", "", {"kind": foreign(data, 4096 if len(data) > 32 else 0)}
        if kind == "mdat":
            if foreign(data):
                yield "video_anomaly", f"mdat at {start}", foreign(data), {}
            if handler in ("sbtl", "subt", "text") or b"sbtl" in raw or b"subt" in raw:
                i = 0
                while i + 2 <= len(data):
                    n = struct.unpack(">H", data[i : i + 2])[0]
                    if n == 0 or i + 2 + n > len(data):
                        break
                    yield "subtitle", f"sample at {body + i}", data[i + 2 : i + 2 + n].decode("utf-8", "replace"), {}
                    i += 2 + n
        if "udta" in path and kind == "data" or kind.startswith("\xa9") and not path.endswith("/data"):
            if kind == "data":
                if "covr" in path:
                    yield "cover", f"data at {start}", "", {"bytes": data[8:]}
                else:
                    yield "video_tag", path, data[8:].decode("utf-8", "replace"), {}
            elif data[4:8] != b"data":
                n = struct.unpack(">H", data[:2])[0] if len(data) >= 4 else 0
                yield "video_tag", path, (data[4 : 4 + n] if 0 < n <= len(data) - 4 else data).decode("utf-8", "replace"), {}


IDENTITY = {*"tpe1 tpe2 tcom artist albumartist composer performer ©art ©alb ©wrt".split()}
FABRICATED = re.compile(r"\bgenerated by\b|\bsynthesi[sz]ed\b|\bcloned(?: voice)?\b|\bai voice\b|\btext to speech\b|\btts engine\b", re.I)


def _tag(key: str, text: str, lyric: bool = False):
    return "audio_tag", key, text, {"key": key.lower(), "identity": key.lower() in IDENTITY, "fabricated": bool(FABRICATED.search(text)), "lyric": lyric, "bytes": len(text.encode("utf-8", "replace")), "entropy": entropy(text.encode("utf-8", "replace"))}


def _id3_text(enc: int, b: bytes) -> str:
    return b.decode(["latin-1", "utf-16", "utf-16-be", "utf-8"][enc & 3], "replace").strip("\0")


def audio(raw: bytes):
    tags, end = [], 0
    if raw[:3] == b"ID3":
        n = 0
        for c in raw[6:10]:
            n = n << 7 | c & 127
        at, end, four = 10, 10 + n, raw[3] >= 4
        while at + 10 <= min(end, len(raw)) and raw[at : at + 1].isalnum():
            key = raw[at : at + 4].decode("latin-1")
            size = struct.unpack(">I", raw[at + 4 : at + 8])[0]
            if four:
                size = sum((c & 127) << s for c, s in zip(raw[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
            body = raw[at + 10 : at + 10 + size]
            if key[0] == "T" and body:
                tags.append(_tag(key, _id3_text(body[0], body[1:])))
            elif key in ("USLT", "COMM") and len(body) > 4:
                wide = body[0] in (1, 2)
                rest = body[4:]
                cut = rest.find(b"\0\0") + 2 if wide else rest.find(b"\0") + 1
                tags.append(_tag(key, _id3_text(body[0], rest[max(cut, 0) :]), key == "USLT"))
            elif key == "APIC":
                rest = body[1:].partition(b"\0")[2][1:]
                yield "audio_picture", "APIC", "", {"bytes": rest.partition(b"\0")[2]}
            at += 10 + size
    elif raw[:4] == b"fLaC":
        at = 4
        while at + 4 <= len(raw):
            last, kind, n = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + n]
            if kind == 4 and len(body) >= 8:
                i = 4 + struct.unpack("<I", body[:4])[0]
                count = struct.unpack("<I", body[i : i + 4])[0] if i + 4 <= len(body) else 0
                i += 4
                for _ in range(count):
                    if i + 4 > len(body):
                        break
                    k = struct.unpack("<I", body[i : i + 4])[0]
                    key, _, v = body[i + 4 : i + 4 + k].decode("utf-8", "replace").partition("=")
                    tags.append(_tag(key, v, key.lower() == "lyrics"))
                    i += 4 + k
            if kind == 6 and len(body) > 32:
                m = struct.unpack(">I", body[4:8])[0]
                d = struct.unpack(">I", body[8 + m : 12 + m])[0]
                yield "audio_picture", "PICTURE", "", {"bytes": body[32 + m + d :]}
            at += 4 + n
            if last:
                break
    elif raw[:4] == b"RIFF":
        at, stop, bits, data = 12, 8 + struct.unpack("<I", raw[4:8])[0], 0, b""
        while at + 8 <= min(stop, len(raw)):
            kind, n = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
            body = raw[at + 8 : at + 8 + n]
            if kind == b"fmt " and len(body) >= 16:
                bits = struct.unpack("<H", body[14:16])[0]
            if kind == b"data":
                data = body
            if kind == b"LIST" and body[:4] == b"INFO":
                i = 4
                while i + 8 <= len(body):
                    m = struct.unpack("<I", body[i + 4 : i + 8])[0]
                    key = {b"IART": "artist", b"INAM": "title", b"ICMT": "comment"}.get(body[i : i + 4], body[i : i + 4].decode("latin-1"))
                    tags.append(_tag(key, body[i + 8 : i + 8 + m].strip(b"\0").decode("utf-8", "replace")))
                    i += 8 + m + m % 2
            at += 8 + n + n % 2
        if len(raw) > stop:
            yield "audio_anomaly", "file", raw[stop:][:200].decode("latin-1"), {"what": "rest"}
        low = np.frombuffer(data, np.uint8)[:: 2 if bits == 16 else 1] & 1
        if bits in (8, 16) and len(low) >= 2048:
            yield "audio_lsb", "data", "", {"off": abs(float(low.mean()) - 0.5), "kinds": len(set(data[:2048]))}
    elif raw[:1] != b"\xff" and raw[:4] != b"OggS":
        yield "audio_anomaly", "file", raw[:16].hex(), {"what": "signature"}
        return
    if raw[:3] == b"ID3" or raw[:1] == b"\xff":
        tail = raw[-32:]
        if len(raw) >= 128 and not re.search(rb"TAG|APETAGEX", raw[-128:]) and all(32 <= c < 127 for c in tail):
            yield "audio_anomaly", "file", tail.decode("latin-1"), {"what": "tail"}
    yield "audio_file", "file", "", {"tags": len(tags)}
    yield from tags
    who = [t[2].strip() for t in tags if t[3]["identity"]]
    yield "audio_identity", "tags", ", ".join(who), {"marked": any(t[3]["identity"] and t[3]["fabricated"] for t in tags), "same": len(who) >= 2 and len(set(who)) == 1 and bool(who[0])}


# ---- PDF


def _literal(b: bytes) -> str:
    out, i = bytearray(), 0
    while i < len(b):
        if b[i] == 92 and i + 1 < len(b):
            m = re.match(rb"[0-7]{1,3}", b[i + 1 :])
            if m:
                out.append(int(m[0], 8) & 255)
                i += 1 + len(m[0])
                continue
            out += {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(b[i + 1 : i + 2], b[i + 1 : i + 2])
            i += 2
        else:
            out.append(b[i])
            i += 1
    return out.decode("utf-16") if out[:2] in (b"\xfe\xff", b"\xff\xfe") else out.decode("utf-8") if _utf8(bytes(out)) else out.decode("latin-1")


def _strings(stream: bytes) -> str:
    parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>", stream)
    return "".join(_literal(a) if a or not b else bytes.fromhex(re.sub(rb"\s", b"", b).decode().ljust(len(b) + len(b) % 2, "0")[: len(re.sub(rb"\s", b"", b)) // 2 * 2]).decode("utf-16-be" if len(b) % 4 == 0 else "latin-1", "replace") for a, b in parts)


def pdf(raw: bytes):
    streams = []
    for m in re.finditer(rb"<<((?:(?!endobj).)*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", raw, re.S):
        body = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        streams.append((m[1], body))
    eofs = [m.start() for m in re.finditer(rb"%%EOF", raw)]
    rest = raw[eofs[-1] + 5 :] if eofs else b""
    # objects may sit in object streams, so dictionaries are sought in both
    dicts = raw + b"\n" + b"\n".join(b for h, b in streams if b"/ObjStm" in h)
    yield "pdf_file", "file", "", {
        "eofs": len(eofs), "rest": len(rest) if rest[:4096].strip() else 0, "open_action": bool(re.search(rb"/OpenAction\b", dicts)), "additional": bool(re.search(rb"/AA\s*(?:<<|\d)", dicts)),
        "javascript": bool(re.search(rb"/Names\s*<<(?:(?!endobj).)*?/JavaScript|/JavaScript\s+\d+ \d+ R|/S\s*/JavaScript", dicts, re.S)), "launch": bool(re.search(rb"/S\s*/Launch\b", dicts)),
        "attachment": bool(re.search(rb"/Subtype\s*/FileAttachment", dicts)), "hidden_layers": bool(re.search(rb"/OFF\s*\[\s*\d", dicts)),
    }
    for m in re.finditer(rb"/Type\s*/Filespec(?:(?!endobj).)*?/(?:F|UF)\s*\(((?:\\.|[^\\()])*)\)|/EmbeddedFiles\b", dicts, re.S):
        if m[1]:
            yield "pdf_embedded", "names", _literal(m[1]), {}
    drawn = [(h, b) for h, b in streams if re.search(rb"\bBT\b", b)]
    shown = " ".join(_strings(b) for _, b in drawn)
    fields = {k.decode(): _literal(v) for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate|ModDate)\s*\(((?:\\.|[^\\()])*)\)", dicts)}
    if fields.get("ModDate") and fields.get("CreationDate"):
        yield "pdf_dates", "info", fields["ModDate"], {"before": fields["ModDate"] < fields["CreationDate"]}
    for h, b in streams:
        if b"/Metadata" in h or b"<x:xmpmeta" in b:
            for tag, v in re.findall(rb"<((?:dc|pdf|xmp):\w+)[^>]*>(.*?)</\1>", b, re.S):
                fields[tag.decode()] = re.sub(r"<[^>]+>", " ", v.decode("utf-8", "replace")).strip()
    for k, v in fields.items():
        yield "pdf_field", k, v, {"bytes": len(v.encode()), "compared": k in ("Keywords", "dc:description", "pdf:Keywords"), "in_text": v.strip() in shown}
    for m in re.finditer(rb"<<((?:(?!endobj).)*?/Subtype\s*/(Text|FreeText|Popup|Stamp)(?:(?!endobj).)*?)>>", dicts, re.S):
        note, flags = re.search(rb"/Contents\s*\(((?:\\.|[^\\()])*)\)", m[1]), re.search(rb"/F\s+(\d+)", m[1])
        yield "pdf_note", m[2].decode(), _literal(note[1]).strip() if note else "", {"flags": int(flags[1]) if flags else 0}
    box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", dicts)
    # 14,400 units is the largest page that viewers are bound to show
    page = [max(-14400.0, min(14400.0, float(x))) for x in box.groups()] if box else [0.0, 0.0, 612.0, 792.0]
    widths = _widths(dicts)
    for n, (_, b) in enumerate(drawn):
        yield from _spans(n, b, page, widths)
    fonts = set()
    for h, b in streams:
        if b"beginbfchar" in b or b"beginbfrange" in b:
            to = re.findall(rb"<[0-9A-Fa-f]+>\s*(?:<[0-9A-Fa-f]+>\s*)?<([0-9A-Fa-f]+)>", b)
            text = "".join(bytes.fromhex(t.decode()).decode("utf-16-be", "replace") for t in to if len(t) % 4 == 0)
            if text not in fonts:
                fonts.add(text)
                yield "pdf_cmap", f"font {len(fonts)}", text, {}


def _widths(dicts: bytes) -> dict[bytes, tuple[int, list[float]] | None]:
    """First code and glyph widths (for size 1) of simple fonts by resource name; None where a name has none, or means two fonts."""
    seen: dict[bytes, bytes] = {}

    def inside(ref: bytes) -> bytes:
        if ref not in seen:
            m = re.search(rb"(?<!\d)" + ref + rb"\s+\d+\s+obj\b(.*?)(?:endobj|stream\b)", dicts, re.S)
            seen[ref] = m[1] if m else b""
        return seen[ref]

    out: dict[bytes, tuple[int, list[float]] | None] = {}
    for m in re.finditer(rb"/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", dicts, re.S):
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inside(m[2]) if m[2] else m[1]):
            font, of = inside(ref), None
            first, list_ = re.search(rb"/FirstChar\s+(\d+)", font), re.search(rb"/Widths\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", font)
            if first and list_:
                of = (int(first[1]), [float(v) / 1000 for v in re.findall(rb"\d+(?:\.\d+)?", list_[1] if list_[1] is not None else inside(list_[2]))])
            out[name] = of if out.get(name, of) == of else None
    return out


def _times(m, n):
    """The matrix that applies m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _corners(m, w: float, low: float, high: float):
    """(x0, y0, x1, y1) of the box (0..w, low..high) under the matrix."""
    at = [(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (0.0, w) for y in (low, high)]
    return min(x for x, _ in at), min(y for _, y in at), max(x for x, _ in at), max(y for _, y in at)


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_PDF_NUMBER, _PDF_WORD, _NEXT_ORIGIN = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)"), re.compile(rb"[A-Za-z'\"*]+"), re.compile(rb"\bTm\b|\bET\b")
_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _spans(page: int, stream: bytes, box: list[float], widths: dict):
    """The text state of a content stream: matrices of page, line and text, font, leading, colour and render mode.

    A glyph is as wide as its font's /Widths say, or half the size where the font has none."""
    stack, saved = [], []
    place, size, font, lead, rgb = _SAME, 12.0, None, 0.0, (0.0, 0.0, 0.0)
    line, along, mode, region = _SAME, 0.0, 0, 0
    fills, drawn, rect = [], {}, None
    light_of = lambda c: sum(a * b for a, b in zip(c, (0.2126, 0.7152, 0.0722), strict=True))
    for m in _PDF_TOKEN.finditer(stream):
        t = m[0]
        if not _PDF_WORD.fullmatch(t):
            stack.append(t)
            continue
        try:
            num = [float(v) for v in stack if _PDF_NUMBER.fullmatch(v)]
            if t == b"q":
                saved.append((place, size, font, lead, rgb, mode))
            elif t == b"Q":
                place, size, font, lead, rgb, mode = saved.pop()
            elif t == b"cm":
                place = _times(num[-6:], place)
            elif t == b"Tf":
                size, font = num[-1], widths.get(stack[0][1:])
            elif t == b"TL":
                lead = num[-1]
            elif t in (b"Td", b"TD"):
                # from the start of the line, wherever the text on it has got to
                line, along = _times((1.0, 0.0, 0.0, 1.0, num[-2], num[-1]), line), 0.0
                lead = -num[-1] if t == b"TD" else lead
            elif t == b"Tm":
                line, along = tuple(num[-6:]), 0.0
                x, y = line[4], line[5]
                out = x < box[0] - 1 or y < box[1] - 1 or x > box[2] + 1 or y > box[3] + 1
                stop = _NEXT_ORIGIN.search(stream, m.end())
                yield "pdf_origin", f"page {page} at {x:g},{y:g}", _strings(stream[m.end() : stop.start() if stop else len(stream)])[:240], {"outside": out}
            elif t == b"BT":
                line, along = _SAME, 0.0
            elif t in (b"rg", b"g"):
                rgb = tuple(num[-3:]) if t == b"rg" else (num[-1],) * 3
            elif t == b"Tr":
                mode, region = int(num[-1]), region + 1
                if mode == 3:
                    drawn.setdefault(region, "")
            elif t == b"re":
                rect = _corners(_times((1.0, 0.0, 0.0, 1.0, num[-4], num[-3]), place), num[-2], 0.0, num[-1])
            elif t in (b"f", b"F", b"f*") and rect:
                if light_of(rgb) < 0.95:
                    fills.append(rect)
            if t in (b"T*", b"'", b'"'):
                line, along = _times((1.0, 0.0, 0.0, 1.0, 0.0, -lead), line), 0.0
            if t in (b"Tj", b"TJ", b"'", b'"') and stack:
                text = _strings(stack[-1])
                first, of = font or (0, [])
                w = size * sum(of[k] if 0 <= (k := ord(c) - first) < len(of) else 0.5 for c in text)
                if t == b"TJ":
                    w -= size / 1000 * sum(float(v) for v in _PDF_NUMBER.findall(re.sub(rb"\((?:\\.|[^\\()])*\)|<[^>]*>", b" ", stack[-1])))
                at = _times((1.0, 0.0, 0.0, 1.0, along, 0.0), _times(line, place))
                high = abs(size) * (at[2] ** 2 + at[3] ** 2) ** 0.5
                x0, y0, x1, y1 = _corners(at, w, 0.0, size)
                x1, y1 = max(x1, x0 + 0.1), max(y1, y0 + 0.01)
                if mode == 3:
                    drawn[region] = drawn.get(region, "") + text
                light = light_of(rgb)
                dark = light >= 0.95 and any(max(0, min(x1, f[2]) - max(x0, f[0])) * max(0, min(y1, f[3]) - max(y0, f[1])) > 0.5 * (x1 - x0) * (y1 - y0) for f in fills)
                where = f"page {page} at {x0:g},{y0:g}"
                out = not (x1 >= box[0] - 1 and y1 >= box[1] - 1 and x0 <= box[2] + 1 and y0 <= box[3] + 1)
                if not out:  # boxes are compared as far as they are on the page, which bounds what a broken matrix can do
                    x0, y0 = max(x0, box[0]), max(y0, box[1])
                    x1, y1 = max(min(x1, box[2]), x0 + 0.1), max(min(y1, box[3]), y0 + 0.01)
                yield "pdf_span", where, text, {"size": high, "light": light, "dark_behind": dark, "page": page, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "outside": out}
                along += w
        except (IndexError, ValueError, ArithmeticError):
            pass
        stack = []
    for r, text in drawn.items():
        yield "pdf_invisible", f"page {page} region {r}", text, {"drawn": bool(text)}
