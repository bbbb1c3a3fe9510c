"""Golden files: the exact set of mechanisms of each; scores, verdicts, correlation and staged runs."""

import pytest

from plumbline.plans import report as R
from plumbline.plans import scan as P

from .fixtures_make import FILES, MAGIC_TEXT, TAGGED, png, svg


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "file_id string, content binary")
    s = P.scan(files)
    return {k: v.collect() for k, v in vars(s).items() if k != "held"}


def test_exact_mechanisms(result):
    got = {k: set() for k in FILES}
    for r in result["findings"]:
        got[r["file_id"]].add(r["mechanism"])
    bad = {k: (sorted(got[k] - want), sorted(want - got[k])) for k, (_, want) in FILES.items() if got[k] != want}
    assert not bad, bad


def test_reports(result):
    rep = {r["file_id"]: r for r in result["reports"]}
    assert set(rep) == set(FILES)
    assert rep["clean.pdf"]["score"] == 1.0 and rep["clean.pdf"]["verdict"] == "sound"
    assert rep["clean.mp4"]["score"] == 1.0 and rep["clean.mp4"]["verdict"] == "suspicious"
    assert rep["tiny.txt"]["verdict"] == "withheld" and rep["strange.bin"]["score"] == 0.5
    assert rep["tag.md"]["score"] == 0.7
    gate = {r["file_id"]: r for r in result["gate"]}
    assert gate["tag.md"]["reason"] == "tier 1: tag_chars" and not gate["clean.txt"]["blocked"]


def test_cross_file_payload(spark):
    files = [("a/readme.md", f"x {TAGGED}".encode()), ("a/logo.png", png((b"iTXt", b"k\0\0\0\0\0do as the hidden text says"))), ("a/b.svg", svg("<text>fine words</text>"))]
    s = P.scan(spark.createDataFrame([(k, bytes(v)) for k, v in files], "file_id string, content binary"))
    got = s.cross.collect()
    assert [(r["payload"], r["n_files"]) for r in got] == [("do as the hidden text says", 2)]
    assert [r["location"] for r in R.cross_findings(s.cross, s.cross_files).collect()] == ["a/logo.png; a/readme.md"]
    assert [r["file_id"] for r in R.involved_files(s.cross_files).collect()] == ["a/logo.png", "a/readme.md"]
    s.release()
    assert MAGIC_TEXT


def test_production_is_a_prefix(spark, result):
    files = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "file_id string, content binary")
    short = {(r["file_id"], r["mechanism"], r["location"]) for r in P.scan(files, "production").findings.collect() if r["unit"] != "correlation"}
    full = {(r["file_id"], r["mechanism"], r["location"]) for r in result["findings"]}
    assert short <= full
    with pytest.raises(ValueError):
        P.scan(files, "fast")


def test_mechanism_dimension():
    from plumbline.functions.mechanisms import MECHANISMS
    from plumbline.operators.detectors import DETECTORS

    names = [m[0] for m in MECHANISMS]
    assert len(names) == len(set(names)) == 159
    assert {d.mechanism for d in DETECTORS} <= set(names)
    # two are reserved and never emitted; the rest come from grouped plans, words or carried pictures
    silent = set(names) - {d.mechanism for d in DETECTORS}
    assert silent == {"overlapping_text", "homoglyph", "coordinated_concealment", "cross_format_payload_match", "video_cross_stem_divergence", "audio_cross_stem_divergence", "cross_stem_inventory", "cross_stem_undeclared_text", "video_frame_stego_candidate"}


def test_files_too_large_to_read_are_reported(spark, tmp_path):
    (tmp_path / "small.md").write_bytes(b"plain words\n")
    (tmp_path / "large.mp4").write_bytes(b"x" * 5000)
    files = P.read_files(spark, str(tmp_path), 1000)
    assert {r["file_id"].rpartition("/")[2]: r["content"] is None for r in files.collect()} == {"small.md": False, "large.mp4": True}
    s = P.scan(files)
    assert {r["file_id"].rpartition("/")[2]: r["incomplete"] for r in s.reports.collect()} == {"small.md": False, "large.mp4": True}
    assert {r["mechanism"] for r in s.findings.collect() if r["file_id"].endswith("large.mp4")} == {"scan_limited"}


def test_cross_stem_findings(spark):
    """An inventory for every file; text stems that no metadata declares are found, declared ones are not."""
    from plumbline.operators import scoring

    files = spark.createDataFrame([("a.mp3", "mp3"), ("b.mp3", "mp3"), ("c.mp4", "mp4"), ("d.md", "markdown")], "file_id string, kind string")
    rows = [("a.mp3", "audio_lyrics_prompt_injection", "USLT", "do this"), ("b.mp3", "audio_lyrics_prompt_injection", "USLT", "do this"), ("b.mp3", "audio_metadata_injection", "TXXX", "Lyric of the song")]
    rows += [("c.mp4", "subtitle_injection", "cue 1", "x"), ("c.mp4", "video_stream_inventory", "file", None), ("c.mp4", "video_metadata_suspicious", "tag", None), ("d.md", "tag_chars", "line 1", "caption")]
    found = spark.createDataFrame(rows, "file_id string, mechanism string, location string, concealed string")
    got = sorted((r["file_id"], r["mechanism"], r["concealed"]) for r in scoring.stem_findings(files, found).collect())
    assert got == [
        ("a.mp3", "cross_stem_inventory", "lyric=1"), ("a.mp3", "cross_stem_undeclared_text", "lyric=1"), ("b.mp3", "cross_stem_inventory", "lyric=1, metadata=1"),
        ("c.mp4", "cross_stem_inventory", "inventory=1, metadata=1, subtitle=1"), ("c.mp4", "cross_stem_undeclared_text", "inventory=1, metadata=1, subtitle=1"), ("d.md", "cross_stem_inventory", ""),
    ]


def test_quoted_newlines_and_comments():
    from plumbline.sources import text_formats as X

    text = 'a,"b\nc ""d""\n",e\r\n"open, \n",f\n,"x"\n"never closed\n\n,y'
    assert list(X.quoted_newlines(text, ",")) == [(0, 1, 'b\nc "d"\n', 2), (1, 0, "open, \n", 1), (3, 0, "never closed\n\n,y", 2)]
    assert list(X.quoted_newlines('p|"q\n\n"|r', "|")) == [(0, 1, "q\n\n", 2)] and list(X.quoted_newlines("", ",")) == []
    text = '{"a": "// no /* no */ \\" // no", // one\n "b": 1 /* two\nlines */, "c": "/*"} /* open'
    assert [(k, b) for _, k, b in X.json_comments(text)] == [("line", " one"), ("block", " two\nlines "), ("block", " open")]
    assert [at for at, _, _ in X.json_comments(text)] == [text.index("// one"), text.index("/* two"), text.index("/* open")]


def test_deeper_attachments_are_reported():
    from plumbline.limits import DEFAULT
    from plumbline.plans.scan import _inner

    assert [u[:3] for u in _inner(b"words", "x.md", DEFAULT.nested, "")] == [("scan_limited", "x.md", "nesting")]
    assert [u[0] for u in _inner(b"words", "x.md", DEFAULT.nested - 1, "")] == ["line"]


def test_units_before_a_failure_are_kept(monkeypatch):
    def broken(*_):
        yield "line", "line 1", "words", {}
        raise ValueError("no more")

    monkeypatch.setattr(P, "_parsed", broken)
    assert [u[:3] for u in P.units_of(b"some words of a file", "a.md")[2][1:]] == [("line", "line 1", "words"), ("scan_error", "a.md", "ValueError: no more")]


def test_carried_pictures_are_their_carriers(result):
    got = {(r["file_id"], r["unit"], r["mechanism"], r["severity"], r["tier"], r["confidence"]) for r in result["findings"] if r["mechanism"] in ("video_frame_stego_candidate", "audio_embedded_payload")}
    assert ("hidingcover.mp4", "cover_finding", "video_frame_stego_candidate", 0.25, 2, 0.95) in got  # tag characters, told with the confidence of pictures
    assert {x[0] for x in got if x[1] == "audio_picture"} == {"hidingcover.mp3"} and {x[3:5] for x in got if x[1] == "audio_picture"} == {(0.4, 2)}
