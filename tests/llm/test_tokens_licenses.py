import functools
import re

import pytest

from . import helpers as H


def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(spark):
    from plumbline.llm import byte_bpe

    enc = tiktoken_encoding()
    d = H.table(spark)
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(d))).collect()
    assert sorted(map(str, got)) == sorted(map(str, byte_bpe.digests(byte_bpe.round_trip(d)).collect()))
    want = sorted((r[0] if r[0] is not None else -1, len(i := enc.encode_ordinary(r[1] or "")), H.sha(",".join(map(str, i))), H.sha(r[1] or "")) for r in H.rows())
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want


def test_byte_bpe_characters_one_by_one():
    from plumbline.llm import byte_bpe

    enc, own = tiktoken_encoding(), byte_bpe.tokenizer(*byte_bpe.public_vocabulary())
    bad = [c for c in [*range(0x300), *range(0x300, 0xD800, 7), *range(0xE000, 0x30000, 41)] if own.encode(t := f"a{chr(c)}b {chr(c)}{chr(c)} 1") != enc.encode_ordinary(t)]
    assert not bad, bad[:20]


def test_byte_bpe_empty_and_errors(spark):
    from plumbline.llm import byte_bpe

    d = H.table(spark, [])
    assert byte_bpe.decode(byte_bpe.encode(d)).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.tokenizer(*byte_bpe.public_vocabulary()).decode([10**6])


def brute_licenses(text):
    """All regexes of the rules over words with one blank between them, without keywords."""
    from plumbline.llm import license_scan as L

    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.low(text))
    form = " " + " ".join(ws) + " "
    starts, base = [], set()
    for p, label in L.BASE.items():
        k = p.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(k)] == k]
        starts += at
        base |= {label} if at else set()
    hits = []
    for p, (label, _, r) in enumerate(L.rules()):
        hits += [(form[: m.start()].count(" ") - 1, -(form[: m.end()].count(" ")), p, label) for m in compiled(r).finditer(form)]
    end, found = -1, []
    for s, e, _, label in sorted(hits):
        if -e > end:
            end = -e
            found.append((label, s, -e))
    covered = sum(e - s for _, s, e in found)
    score = min(1.0, 0.5 + covered / 40) if found or starts else 0.0
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})), score


@functools.cache
def compiled(r):
    return re.compile(f"(?<= ){r}(?= )")


def licensed(d, spark):
    from plumbline.llm import license_scan as L

    real = L.read
    try:
        L.read = lambda *a: d
        return L.op6_license_scan(spark, "")
    finally:
        L.read = real


def test_license_scan_equals_brute_force(spark):
    got = licensed(H.table(spark), spark).collect()
    want = [(r[0], *brute_licenses(r[1])) for r in H.rows()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r["labels"].count(",") >= 3 for r in got)
    assert licensed(H.table(spark, []), spark).collect() == []


def test_license_scan_documents(spark):
    from plumbline.llm import license_scan as L

    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in L.op6_license_scan(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r["doc_id"]] == brute_licenses(r["text"])


def test_rule_list():
    from plumbline.llm import license_scan as L

    assert len(L.rules()) >= 200
    assert len(L.SENTENCES) >= 50
    for _, kws, r in L.rules():
        re.compile(r)
        assert all(re.fullmatch("[a-z0-9]+", kw) for kw in kws.split())


def matches(tree):
    """All strings that a parsed regex matches (a run of any character stands as one word)."""
    from re import _constants as C

    out = [""]
    for op, a in tree:
        if op is C.LITERAL:
            new = [chr(a)]
        elif op is C.NOT_LITERAL or op is C.IN and a[0][0] is C.NEGATE:
            new = ["x"]
        elif op is C.IN:
            new = [chr(x) for o, x in a if o is C.LITERAL]
            assert len(new) == len(a)
        elif op is C.SUBPATTERN:
            new = matches(a[3])
        elif op is C.BRANCH:
            new = [x for b in a[1] for x in matches(b)]
        elif op is C.MAX_REPEAT and a[:2] == (0, 1):
            new = ["", *matches(a[2])]
        else:
            assert op in (C.MIN_REPEAT, C.MAX_REPEAT), op  # once, and for a star not at all
            new = matches(a[2]) + [""] * (a[0] == 0)
        out = [x + y for x in out for y in new]
    return out


def rule_matches():
    """regex -> (keywords, all of its matches)."""
    from re import _parser

    from plumbline.llm import license_scan as L

    keys = {}
    for _, kw, r in L.rules():
        keys.setdefault(r, set()).update(kw.split())
    return {r: (kws, matches(_parser.parse(r))) for r, kws in keys.items()}


def ungated_labels(text):
    return brute_licenses(text)[-2:]


def test_license_keywords_are_in_every_match():
    for r, (kws, all_) in rule_matches().items():
        bad = [m for m in all_ if not any(f" {kw} " in f" {m} " for kw in kws)]
        assert not bad, (r, kws, bad[:3])


def test_license_scan_equals_ungated_regexes(spark):
    texts = ["under the LGPL 2.1 license", "SPDX-License-Identifier: AGPL-3.0", "SPDX-License-Identifier: 0BSD", "the FreeBSD license", "the expat license", "under the universal permissive license"]
    texts += [f"some license of {m} here" for _, all_ in rule_matches().values() for m in {all_[0], all_[len(all_) // 2], all_[-1]}]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licensed(H.table(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]), spark).collect()}
    bad = [(t, got[i], w) for i, t in enumerate(texts) if got[i] != (w := ungated_labels(t))]
    assert not bad, (len(bad), bad[:5])


def test_license_scan_needs_no_word_beside_the_match(spark):
    texts = ["Released under the MIT.", "distributed under the GPL 2.0", "available under Apache 2.0", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", "neither the name of X nor the names of its contributors"]
    texts += [m for _, all_ in rule_matches().values() for m in {all_[0], all_[-1]}]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licensed(H.table(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]), spark).collect()}
    bad = [(t, got[i], w) for i, t in enumerate(texts) if got[i] != (w := ungated_labels(t))]
    assert not bad, (len(bad), bad[:5])
    assert all(got[i][0] for i in range(5))
