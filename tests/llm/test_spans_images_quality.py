import random

import numpy as np
import pyarrow as pa
import pytest

from . import helpers as H
from .test_near_lines_mix import key


def brute_spans(rows, size=50):
    first = {}
    ws = [H.words(r[1]) for r in rows]
    for r, w in zip(rows, ws, strict=True):
        for i in range(len(w) - size + 1):
            if r[0] is not None:
                h = tuple(w[i : i + size])
                first[h] = min(first.get(h, r[0]), r[0])
    out = []
    for r, w in zip(rows, ws, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if r[0] is not None and first[tuple(w[i : i + size])] < r[0]:
                gone |= set(range(i, i + size))
        out.append((r[0], len(w), len(gone), H.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def span_rows():
    r = random.Random(9)
    v = [f"w{i}" for i in range(800)]
    text = lambda k: [r.choice(v) for _ in range(k)]
    long, other = text(400), text(90)
    data = []
    for i in range(60):
        t = text(r.randint(0, 120))
        if i % 3 == 0:
            a, n = r.randrange(250), r.randint(40, 150)
            t = t + long[a : a + n] + text(r.randint(0, 30))
        if i % 5 == 0:
            t = other + t
        if i % 7 == 0:
            t = t + ["again"] * r.randint(40, 200)
        if i % 11 == 0:
            t = list(long)
        data.append((i * 7 % 61, " ".join(t), None, None, 0, None, None, None))
    return data + [data[3], (data[4][0], data[9][1], None, None, 0, None, None, None)]


def spans(spark, d):
    from plumbline.llm.substring_dedup import dedup_spans
    from pyspark.sql import functions as F

    from plumbline.llm.substring_dedup import _joined

    out = dedup_spans(d)
    assert out.columns == [*d.columns, "n_words", "n_removed"]
    kept = F.sha2(_joined(F.col("text")).cast("binary"), 256)
    return [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", kept).collect()]


def test_substring_dedup_equals_brute_force(spark):
    for data in (H.rows(), span_rows()):
        want = brute_spans(data)
        assert sorted(spans(spark, H.table(spark, data)), key=key) == sorted(want, key=key)
        assert sum(r[2] for r in want) > 100
    assert spans(spark, H.table(spark, [])) == []


def test_windows_choose_equal_kmers():
    from plumbline.llm import substring_dedup as S

    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.r_[w[:200], w[50:150]], np.r_[w[200:], w[50:150]]
    ka, pa = S.chosen(a)
    kb, pb = S.chosen(b)
    at = 100  # the shared run starts at 200 of a and at 100 of b
    for i in range(51):
        assert pa[200 + i] - 200 == pb[at + i] - at and ka[pa[200 + i]] == kb[pb[at + i]]
    plain = [i + int(np.argmin(ka[i : i + S.WINDOW - S.K + 1])) for i in range(len(a) - S.WINDOW + 1)]
    assert pa.tolist() == plain
    same = np.full(120, 7, np.uint64)  # ties: the leftmost
    assert S.chosen(same)[1].tolist() == list(range(71))
    assert all(len(x) == 0 for x in S.chosen(w[:5]))


def test_paths_are_compacted_by_joins(spark):
    """Heads and distances on paths of many lengths, against walking back along only links."""
    from plumbline.llm import substring_dedup as S

    r = random.Random(6)
    rows, want, node = [], {}, 1
    for n in (1, 2, 3, 5, 8, 17, 40):
        head, off = node, 0
        for i in range(n):
            gap = r.randint(1, 43)
            inner = i + 1 < n
            rows.append((node, node + 1 if inner else 999_000 + node, gap, 5000 + node if inner else None, 5000 + node - 1 if i else None))
            if i:
                want[node] = (head, off)
            off += gap
            node += 1
    rows.append((node, 1, 4, 77, 77))  # its only successor has another predecessor
    got = {x[0]: (x[1], x[2]) for x in S.paths(spark.createDataFrame(rows, "kmer long, next long, gap long, link_out long, link_in long")).collect()}
    assert got == want


def test_quality_classifier(spark):
    from plumbline.llm import boosted_quality as B

    sf = "/root/testdata/sf0.1"
    out = B.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    acc = (out["predicted"] == out["quality"]).mean()
    low, high = out[out.quality == 0]["score"].to_numpy(), out[out.quality == 1]["score"].to_numpy()
    auc = (high[:, None] > low[None]).mean()
    assert acc > 0.95 and auc > 0.97, (acc, auc)


def test_quality_classifier_edges(spark):
    from plumbline.llm import boosted_quality as B

    d = H.table(spark)
    none = B.train(d, spark.createDataFrame([], "doc_id long, label int"))
    got = B.score(d, none).collect()
    assert len(got) == d.count() and {r["score"] > 0.99 for r in got} == {True}
    one = B.train(d, spark.createDataFrame([(3, 1), (None, 0), (6, None)], "doc_id long, label int"))
    assert all(0 <= r["score"] <= 1 for r in B.score(d, one).collect())
    assert B.score(H.table(spark, []), none).collect() == []
    labels = spark.createDataFrame([(i * 3 % 1000, i % 2) for i in range(120)], "doc_id long, label int")
    a, b = B.train(d, labels), B.train(d.repartition(5), labels)
    assert all((x == y).all() for x, y in ((a.feature, b.feature), (a.threshold, b.threshold), (a.leaf, b.leaf)))


def test_image_copies(spark):
    from plumbline.llm import image_copies as I

    rng = np.random.default_rng(4)
    made = [I.render(rng.normal(size=64)) for _ in range(12)]
    media = [(i * 10, I.pgm(x)) for i, x in enumerate(made)]
    media += [(i * 10 + 1, I.pgm(I.edited(x, i))) for i, x in enumerate(made[:8])]
    media += [(i * 10 + 2, I.pgm(np.clip(x[8:92, 4:90] * 1.1, 0, 255))) for i, x in enumerate(made[:4])]
    media += [(500, None), (501, b""), (502, b"not a picture"), (503, b"not a picture"), (None, I.pgm(made[0])), (504, I.pgm(np.full((60, 60), 7.0))), (0, I.pgm(made[0]))]
    got = sorted({(r[0], r[2]) for r in I.image_classes(spark.createDataFrame(media, "media_id long, media binary")).collect()}, key=key)
    want = sorted({(m, None if m is None else m // 10 * 10 if m < 500 else 502 if m == 503 else m) for m, _ in media}, key=key)
    assert got == want
    assert I.image_classes(spark.createDataFrame([], "media_id long, media binary")).collect() == []


def test_png_filters():
    import zlib
    import struct

    from plumbline.llm import image_copies as I

    px = np.arange(48, dtype=np.uint8).reshape(6, 8) * 5
    lines = []
    for y in range(6):
        row, up = px[y].astype(int), px[y - 1].astype(int) if y else np.zeros(8, int)
        left = np.r_[0, row[:-1]]
        diag = np.r_[0, up[:-1]]
        q = left + up - diag
        paeth = np.where((abs(q - left) <= abs(q - up)) & (abs(q - left) <= abs(q - diag)), left, np.where(abs(q - up) <= abs(q - diag), up, diag))
        kind = y % 5
        pred = [np.zeros(8, int), left, up, (left + up) // 2, paeth][kind]
        lines.append(bytes([kind]) + bytes(((row - pred) & 255).tolist()))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (I.gray(raw) == px).all()
    assert I.gray(raw[:40]) is None


def test_quality_rules_and_urls_on_awkward_rows(spark):
    from plumbline.llm import quality_rules as Q
    from plumbline.llm import url_filter as U
    from pyspark.sql import functions as F

    d = H.table(spark)
    c = Q.document_counts(d)
    out = Q.judge(c, Q.thresholds(c)).collect()
    assert len(out) == d.count()
    for r in out:
        assert not (r["base_failed"] and r["kept"])
    by = {r["doc_id"]: r for r in c.collect()}
    for row in H.rows():
        w = H.words(row[1])
        runs, hit = {}, set()
        for i in range(len(w) - 7):
            runs.setdefault(tuple(w[i : i + 8]), []).append(i)
        for v in runs.values():
            if len(v) > 1:
                hit |= {i + j for i in v for j in range(8)}
        ls = [x for x in (row[1] or "").split("\n") if H.words(x)]
        got = by[row[0]]
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"], got["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(ls) - len(set(ls)))
        assert got["n_symbols"] == sum(ch in "#*$%&|<>" for ch in row[1] or "")
    e = Q.document_counts(H.table(spark, []))
    assert Q.judge(e, Q.thresholds(e)).collect() == []

    urls = ["https://WWW.Example.com/en/x?y", "http://a.net/es/", "http://net/fr/z", "http://x.com", "http://x.com/", None, "no scheme", "://", "http://h:80/p#q", "http://notexample.com/en/"]
    p = spark.createDataFrame([(i if i != 8 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = U.split_url(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    got = {r["page_id"]: r for r in p.select("*", *[x.alias(n) for x, n in zip(U.fitting_rule(F.col("host"), F.col("path")), ("rule", "verdict"))]).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (0, 1, 2, 3, 4, 5)] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.net", "/es/", "net/es/", "block"), ("net", "/fr/z", "net/fr/", "block"), ("x.com", "", None, None), ("x.com", "/", "com/", "allow"), ("", "", None, None),
    ]
    rep = U.reputation(p.select("host", F.lit(None).cast("long").alias("good"))).collect()
    assert {r["host"] for r in rep} == {r["host"] for r in p.collect()} and all(r["mean"] == 1 and r["n"] == 0 for r in rep)
    assert U.reputation(p.select("host", F.lit(1).cast("long").alias("good")).where("false")).collect() == []


def plain_reputation(hosts, z=1.645):
    """hosts: name -> (n, s) -> name -> (mean, bound), corpus rate; beta-binomial priors level by level, in plain Python."""
    import re

    def level(groups):
        big = [(n, s) for n, s in groups.values() if n]
        N, S = sum(n for n, _ in big), sum(s for _, s in big)
        p = S / N
        v = sum(s * s / n for n, s in big) / N - p * p - p * (1 - p) * len(big) / N
        return round(p, 6), round(max(1.0, min(1000.0, p * (1 - p) / v - 1)) if v > 0 else 1000.0, 3)

    def summed(key):
        out = {}
        for h, (n, s) in hosts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + s)
        return out

    suffix = lambda h: h.rpartition(".")[2]
    domain = lambda h: re.search(r"[^.]+\.[^.]+$", h)[0]
    xs, ds = summed(suffix), summed(domain)
    (p, kx), (_, kd), (corpus, kh) = level(xs), level(ds), level(hosts)
    mx = {k: (s + kx * p) / (n + kx) for k, (n, s) in xs.items()}
    md = {k: (s + kd * mx[suffix(k)]) / (n + kd) for k, (n, s) in ds.items()}
    out = {}
    for h, (n, s) in hosts.items():
        m = (s + kh * md[domain(h)]) / (n + kh)
        out[h] = (m, m + z * (m * (1 - m) / (n + kh + 1)) ** 0.5)
    return out, corpus


def test_reputation_equals_plain_beta_binomial(spark):
    """Hosts that are blocked, and hosts of as bad a rate that few pages or a good domain save."""
    from plumbline.llm import url_filter as U

    hosts = {"bad.spam.com": (60, 12), "few.spam.com": (2, 0), "fine.good.com": (300, 297), "new.good.com": (2, 1), "a.plain.org": (80, 76), "b.plain.org": (50, 47), "none.plain.org": (0, 0), "c.other.net": (40, 39)}
    rows = [(h, int(i < s)) for h, (n, s) in hosts.items() for i in range(n)] + [("none.plain.org", None)] * 3
    got = {r["host"]: r for r in U.reputation(spark.createDataFrame(rows, "host string, good long")).collect()}
    want, corpus = plain_reputation(hosts)
    for h, (mean, bound) in want.items():
        assert got[h]["n"] == hosts[h][0] and abs(got[h]["mean"] - mean) < 2e-6 and abs(got[h]["bound"] - bound) < 2e-6 and got[h]["corpus"] == corpus
    blocked = {h for h in hosts if got[h]["bound"] < corpus}
    assert "bad.spam.com" in blocked and not blocked & {"new.good.com", "none.plain.org", "fine.good.com", "a.plain.org"}


def test_page_outcomes(spark):
    from pyspark.sql import functions as F

    from plumbline.llm import url_filter as U

    words = "word " * 30
    html = [f"<body>{words}</body>", f"<script>{words}</script><style>{words}</style><!-- {words} --><p title='{words}'>few", f"<nav>{words}</nav><article><p>few</article>", f"<nav>x</nav><ARTICLE class=a><p>{words}</ARTICLE>", "", None]
    d = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    assert [r["good"] for r in d.select("i", U.outcome(F.col("html")).alias("good")).orderBy("i").collect()] == [1, 0, 0, 1, 0, None]


def plain_fences(rows, least):
    """(lang, source) -> rate -> (lo, hi) from sorted values, for values below 128 (exact in the sketch)."""
    from plumbline.llm import quality_rules as Q

    def of(some):
        out = {}
        for r, (p, low) in Q.RATES.items():
            v = sorted(x[r] for x in some)
            at = lambda q: v[max(0, -(-q * len(v) // 100) - 1)]  # noqa: B023, E731
            lo, mid, hi = at(100 - p), at(50), at(p)
            out[r] = (lo - 3 * max(1, mid - lo) if low else None, hi + 3 * max(1, hi - mid))
        return out

    good = [r for r in rows if not r["base_failed"]]
    for g in {(r["lang"], r["source"]) for r in rows}:
        own, lang = [r for r in good if (r["lang"], r["source"]) == g], [r for r in good if r["lang"] == g[0]]
        if own:
            yield g, of(own if len(own) >= least else lang if len(lang) >= least else good)


def test_quality_fences_follow_their_group(spark):
    """Two sources of different spread get different fences, and the same text is kept in one and rejected in the other;
    repeated rows, ties, null groups."""
    from plumbline.llm import quality_rules as Q

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = lambda marks, n=60: " ".join(word(r.randint(4, 6)) + "#" * (i < marks) for i in range(n))
    data = [(i, text(0), "en", "plain") for i in range(60)] + [(100 + i, text(i % 30), "en", "code") for i in range(60)]
    data += [(200 + i, text(i % 2), None, None) for i in range(12)] + [(300, (t := text(12)), "en", "plain"), (301, t, "en", "code"), (301, t, "en", "code")]
    data += [(302, " ".join(word(16) for _ in range(40)), "en", "plain"), (303, "few words", "en", "plain")]
    c = Q.document_counts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    rows = [x.asDict() for x in c.collect()]
    want = dict(plain_fences(rows, 50))
    limits = {(x["lang"], x["source"]): x for x in Q.thresholds(c, least=50).collect()}
    assert set(limits) == set(want)
    for g, x in limits.items():
        for rate, (lo, hi) in want[g].items():
            assert x[f"{rate}_hi"] == hi and (lo is None or x[f"{rate}_lo"] == lo), (g, rate)
    assert limits["en", "plain"]["symbol_rate_hi"] < limits["en", "code"]["symbol_rate_hi"]
    kept = {x["doc_id"]: x["kept"] for x in Q.judge(c, Q.thresholds(c, least=50)).collect()}
    assert (kept[300], kept[301], kept[302], kept[303]) == (False, True, False, False)
    assert all(kept[i] for i in range(60)) and all(kept[i] for i in range(100, 160))


def labelled(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in ids}


def all_pairs(made):
    """Links of an all-pairs matcher over (id, points, bits)."""
    from plumbline.llm import image_copies as I

    return {(x[0], y[0]) for k, x in enumerate(made) for y in made[k + 1 :] if I.agreeing(x[1], x[2], y[1], y[2]) >= I.INLIERS}


def test_image_copies_equal_all_pairs_matcher(spark):
    """Copies of many pictures, and a group of many copies of one; classes by the operator and by matching all with all."""
    from plumbline.llm import image_copies as I

    rng = np.random.default_rng(14)
    pictures = [I.render(rng.normal(size=64)) for _ in range(150)]
    pictures += [I.edited(x, i) for i, x in enumerate(pictures[:40])] + [I.edited(pictures[7], 1000 + i) for i in range(60)]
    order = rng.permutation(len(pictures))
    media = [(int(order[i]), bytearray(I.pgm(x))) for i, x in enumerate(pictures)]
    made = sorted((i, *(x.astype(np.float32) if k == 0 else x for k, x in enumerate(I.corners(I.gray(bytes(m)))))) for i, m in media)
    want = labelled(all_pairs(made), [i for i, _ in media])
    got = {r[0]: r[2] for r in I.image_classes(spark.createDataFrame(media, "media_id long, media binary")).collect()}
    planted = [(int(order[i]), int(order[150 + i])) for i in range(40)] + [(int(order[7]), int(order[190 + i])) for i in range(60)]
    assert np.mean([want[a] == want[b] for a, b in planted]) > 0.97
    assert got == want


def strings(n, seed=8):
    """(id, points, bits) by hand: all pictures hold one mark of 4 strings, each at a place of its own; ids 4 and 5 are copies."""
    rng = np.random.default_rng(seed)
    mark, more, place = rng.integers(0, 256, (4, 32), np.uint8), rng.integers(0, 256, (8, 32), np.uint8), rng.uniform(0, 90, (8, 2))
    out = []
    for i in range(n):
        bits = np.concatenate([mark, rng.integers(0, 256, (20, 32), np.uint8), more if i in (4, 5) else rng.integers(0, 256, (8, 32), np.uint8)])
        xy = rng.uniform(0, 90, (32, 2))
        if i in (4, 5):
            xy[24:] = place + i
        out.append((i, np.c_[xy, np.ones(32), np.zeros(32)].astype(np.float32), bits))
    return out


@pytest.mark.parametrize("n, block", [(12, 256), (40, 8)])
def test_image_copies_with_a_mark_in_all_pictures(spark, monkeypatch, n, block):
    """A mark whose strings are equal in all pictures: no bit splits its buckets; copies in them are found by blocks."""
    from plumbline.llm import image_copies as I

    made = strings(n)
    made = [(i, p, np.concatenate([b[:24], made[4][2][24:]])) for i, p, b in made]  # all strings of the copies are in all the others too
    monkeypatch.setattr(I, "BLOCK", block)
    assert all_pairs(made) == {(4, 5)}
    k = spark.createDataFrame([(i, bytearray(p.tobytes()), bytearray(b.tobytes())) for i, p, b in made], "media_id long, points binary, bits binary")
    keys = spark.createDataFrame([(*map(int, x), i) for i, _, b in made for x in zip(*I.table_keys(b), strict=True)], "t int, k1 long, k2 long, id long")
    hot = I._meetings(keys).where("hot IS NOT NULL").selectExpr("hot AS key", "a AS id")
    assert hot.count() == n * 12 * I.TABLES
    none = spark.createDataFrame([], "id long, label long")
    assert {tuple(r) for r in I._residual(hot, none, k).collect()} == {(4, 5)}


def crowded(n, seed=21):
    """(id, points, bits) by hand: n pictures whose strings begin alike in all tables and differ beyond; 4 and 5, and 6 and
    n - 1, are copies with bits changed just beyond, so that the first split of a bucket parts them."""
    from plumbline.llm import image_copies as I

    rng = np.random.default_rng(seed)
    fixed = np.unique(I._ORDER[:, :32])
    common = rng.integers(0, 2, (12, 256))
    out = []
    for i in range(n):
        b = rng.integers(0, 2, (12, 256))
        b[:, fixed] = common[:, fixed]
        xy = rng.uniform(0, 90, (12, 2))
        if i in (5, n - 1):
            b, xy = out[4 if i == 5 else 6][2].copy(), out[4 if i == 5 else 6][1] + 3
            b[:, np.setdiff1d(I._ORDER[:, 32:40], fixed)] ^= 1
        out.append((i, xy, b))
    return [(i, np.c_[xy, np.ones(12), np.zeros(12)].astype(np.float32), np.packbits(b, axis=1)) for i, xy, b in out]


@pytest.mark.parametrize("n, sent, spelt", [(30, 8000, 2_000_000), (60, 7, 50)])
def test_image_copies_in_crowded_buckets(spark, monkeypatch, n, sent, spelt):
    """Copies that meet only in buckets of many strangers, where splitting parts them and the smallest id is a stranger: the
    pass over whole buckets finds them, whatever the size of its blocks, and each pair once."""
    from plumbline.llm import image_copies as I

    made = crowded(n)
    want = {(4, 5), (6, n - 1)}
    assert all_pairs(made) == want
    t, k1, k2, ids = (np.concatenate(x) for x in zip(*((*I.table_keys(b), np.full(len(b) * I.TABLES, i)) for i, _, b in made)))
    at = np.lexsort((ids, k2, k1, t))
    pairs, _, _ = I.bucket_pairs(t[at], k1[at], k2[at], ids[at])
    seen, times = np.unique(pairs, axis=0, return_counts=True)
    assert not want & {tuple(map(int, p)) for p in seen[times >= I.VOTES]}  # the split buckets alone lose them

    monkeypatch.setattr(I, "SENT", sent)
    monkeypatch.setattr(I, "SPELT", spelt)
    k = spark.createDataFrame([(i, len(p), bytearray(p.tobytes()), bytearray(b.tobytes())) for i, p, b in made], "media_id long, n_corners long, points binary, bits binary")
    none = spark.createDataFrame([], "id long, label long")
    assert sorted(tuple(r) for r in I._rest(none, k).collect()) == sorted(want)
    one = spark.createDataFrame([(4, 4), (5, 4)], "id long, label long")
    assert [tuple(r) for r in I._rest(one, k).collect()] == [(6, n - 1)]  # pairs of one component need no further link
    assert I._rest(none, k.where("false")).collect() == []


def test_meetings_of_whole_buckets_equal_plain_counts():
    """Pairs of different components by shared (table, 32 bits), counted by sets, for blocks with themselves and with others."""
    from plumbline.llm import image_copies as I

    rng = np.random.default_rng(5)

    def side(first, n):
        corners = rng.integers(1, 9, n)
        tags = rng.integers(0, 12, corners.sum() * I.TABLES).astype(np.uint32) << np.uint32(28)
        at = np.cumsum(corners)[:-1]
        zero = [bytes(k * w) for w in (16, 32) for k in corners]
        cols = {"id": np.arange(first, first + n), "comp": rng.integers(0, 40, n), "n_corners": corners, "points": zero[:n], "bits": zero[n:], "tags": [x.tobytes() for x in np.split(tags, at * I.TABLES)]}
        return I._images(pa.table(cols))

    def sets(x):
        t = np.tile(np.arange(I.TABLES), int(x["n"].sum()))
        own = zip(x["id"], x["comp"], np.split(x["bucket"], x["off"][1:-1] * I.TABLES), np.split(t, x["off"][1:-1] * I.TABLES), strict=True)
        return [(int(i), int(c), {(int(u), int(v)) for u, v in zip(w, b, strict=True)}) for i, c, b, w in own]

    x, y = side(0, 300), side(1000, 170)
    for a, b, own in ((x, y, False), (x, x, True)):
        block = I._indexed(b)
        got = [tuple(sorted((int(a["id"][p]), int(b["id"][q])))) for i, j in I.meeting(a, block, np.full(len(a["id"]), own)) for p, q in zip(i, j, strict=True)]
        want = {tuple(sorted((i, j))) for i, c, s in sets(a) for j, d, u in sets(b) if c != d and i != j and len(s & u) >= I.VOTES}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_buckets_do_not_depend_on_chunks(spark, monkeypatch):
    from plumbline.llm import image_copies as I

    rng = np.random.default_rng(3)
    rows = [(int(t), int(a), int(b), int(i)) for t, a, b, i in zip(rng.integers(0, 2, 6000), rng.integers(0, 3, 6000) << 40 | rng.integers(0, 40, 6000) << 14, rng.integers(0, 9, 6000) << 50, rng.integers(0, 500, 6000))]
    keys = spark.createDataFrame(rows, "t int, k1 long, k2 long, id long")
    of = lambda: sorted((tuple(r) for r in I._meetings(keys).where("hot IS NULL").groupBy("a", "b").count().collect()))
    hot = lambda: sorted(tuple(r) for r in I._meetings(keys).where("hot IS NOT NULL").select("hot", "a").distinct().collect())
    whole = hot()
    t, k1, k2, ids = (np.array(x) for x in zip(*sorted(set(rows))))
    pairs, at, _ = I.bucket_pairs(t, k1, k2, ids)
    assert len(at) == len(whole) and len(pairs) == sum(r[2] for r in of())
    monkeypatch.setattr(I, "CHUNK", 900)
    assert hot() == whole
