import random
from collections import Counter, defaultdict

import numpy as np

from . import helpers as H


def brute_near(rows, k=4):
    sets = []
    for r in rows:
        w = H.words(H.low(r[1]))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is None or b[0] is None or not sets[i] or not sets[j]:
                continue
            c = len(sets[i] & sets[j])
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                x, y = sorted((root(a[0]), root(b[0])))
                up[y] = x
    out = []
    for r, s in zip(rows, sets, strict=True):
        comp = None if r[0] is None else root(r[0])
        out.append((r[0], len(s), comp, comp == r[0]))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_near_duplicates_equal_brute_force(spark):
    from plumbline.llm.near_dedup import near_duplicates

    got = [tuple(r) for r in near_duplicates(H.table(spark), shingle=4).collect()]
    assert sorted(got, key=key) == sorted(brute_near(H.rows()), key=key)
    assert near_duplicates(H.table(spark, []), shingle=4).collect() == []


def test_near_duplicates_one_id_with_two_texts(spark):
    from plumbline.llm.near_dedup import near_duplicates

    a, b = "one text of words that is its own " * 3, "quite another text with other words in it " * 3
    data = [(i, t, None, None, 0, None, None, None) for i, t in ((9, a), (9, b), (3, a), (5, b), (7, "alone here with some words of mine"))]
    got = sorted((r[0], r[2]) for r in near_duplicates(H.table(spark, data), shingle=4).collect())
    assert got == [(3, 3), (5, 3), (7, 7), (9, 3), (9, 3)]


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """The paths for buckets beyond a task's size give the same classes."""
    from plumbline.llm import near_dedup as N

    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", 5)
    got = [tuple(r) for r in N.near_duplicates(H.table(spark), shingle=4).collect()]
    assert sorted(got, key=key) == sorted(brute_near(H.rows()), key=key)


def test_near_duplicates_chains_and_common_passage(spark):
    """Chains of edits, and texts that share most of a passage: many bucket mates that aren't near."""
    from plumbline.llm.near_dedup import near_duplicates

    r = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    data, base = [], [r.choice(vocab) for _ in range(120)]
    passage = [r.choice(vocab) for _ in range(60)]
    for i in range(260):
        if i < 130:
            base[r.randrange(120)] = r.choice(vocab)
            t = " ".join(base)
        else:
            t = " ".join(passage + [r.choice(vocab) for _ in range(r.randint(8, 40))])
        data.append((i, t, None, None, 0, None, None, None))
    got = [tuple(x) for x in near_duplicates(H.table(spark, data), shingle=4).collect()]
    assert sorted(got) == sorted(brute_near(data))


def test_registers_estimate_jaccard():
    from plumbline.llm import near_dedup as N

    rng = np.random.default_rng(0)
    for n in (3, 40, 400, 4000):
        u = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(u[: int(1.8 * n)]), np.sort(u[int(0.2 * n) :])
        j = len(np.intersect1d(a, b)) / len(u)
        ra, rb = N.registers([a, b])[0]
        got = np.mean(ra == rb)
        assert abs(got - j) < 0.2, (n, got, j)


def test_small_sets_share_a_band():
    """Nearly all pairs at similarity 0.8 meet, however few shingles they have."""
    from plumbline.llm import near_dedup as N

    rng = np.random.default_rng(1)
    for n in (5, 10, 50, 500):
        met = 0
        for _ in range(200):
            u = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            regs = N.registers([u, u[np.sort(rng.permutation(n)[: int(np.ceil(0.8 * n))])]])[0]
            k = N.band_keys(regs)
            met += bool((k[0] == k[1]).any())
        assert met >= 199, (n, met)


def brute_lines(rows):
    docs, last = defaultdict(set), {}
    ks = []
    for r in rows:
        k = [H.low(x.strip(H.WS)) for x in (r[1] or "").split("\n")]
        ks.append(k)
        for x in k:
            if len(x) >= 40 and r[0] is not None:
                docs[x].add(r[0])
    last = {x: max(v) for x, v in docs.items() if len(v) >= 5}
    out = []
    for r, k in zip(rows, ks, strict=True):
        lines = (r[1] or "").split("\n")
        kept = [t for t, x in zip(lines, k, strict=True) if not (x in last and last[x] != r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), H.sha("\n".join(kept))))
    return out


def digest_lines(d):
    from pyspark.sql import functions as F

    return [tuple(r) for r in d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()]


def test_line_dedup_equals_brute_force(spark):
    from plumbline.llm.line_dedup import dedup_lines

    d = H.table(spark)
    out = dedup_lines(d)
    assert out.columns == [*d.columns, "n_lines", "n_dropped"]
    want = brute_lines(H.rows())
    assert sorted(digest_lines(out), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 5
    assert dedup_lines(H.table(spark, [])).collect() == []


def test_line_index_is_reversible(spark):
    from plumbline.llm.line_dedup import LineIndex, without

    data = [r for r in H.rows() if r[0] is not None]
    a, b = data[:70], data[70:]
    d, first = H.table(spark, data), H.table(spark, a)
    index = LineIndex.build(first).insert(H.table(spark, b))
    assert sorted(digest_lines(without(d, index.drops(d)))) == sorted(brute_lines(data))
    in_b = {r[0] for r in b} - {r[0] for r in a}
    back = index.delete(spark.createDataFrame([(x,) for x in in_b], "doc_id long"))
    assert sorted(digest_lines(without(first, back.drops(first)))) == sorted(brute_lines(a))
    assert back.counts.where("n_docs > 0").count() == LineIndex.build(first).counts.count()
    none = back.delete(first.select("doc_id"))
    assert none.counts.count() == 0 and none.drops(first).count() == 0


def test_cuckoo_filter():
    from plumbline.llm.line_dedup import Cuckoo

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64) * np.uint64(2)
    f = Cuckoo.sized(1000)  # too small on purpose: the stash takes what finds no slot
    f.insert(keys[:2500])
    f = Cuckoo.load(f.dump())
    assert f.contains(keys[:2500]).all() and f.contains(keys[2500:]).mean() < 0.02
    f.delete(keys[:2400])
    assert f.contains(keys[2400:2500]).all() and f.contains(keys[:2400]).mean() < 0.05


def test_mix_targets_and_copies(spark):
    from plumbline.llm import mixing as M
    from pyspark.sql import functions as F

    data = H.rows(400, 2)
    d = H.table(spark, data)
    out = M.plan(d.select("doc_id", "source", M.n_words(F.col("text")).alias("size"))).collect()
    size = Counter()
    for r in data:
        size[r[3]] += len(H.words(r[1]))
    names = sorted((x for x in size if x is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            free.discard(s)
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    largest = max(r["size"] for r in out)
    assert len(out) == len(data) and all(abs(taken[s] - target[s]) <= largest for s in names)
    again = M.plan(d.repartition(7).select("doc_id", "source", M.n_words(F.col("text")).alias("size"))).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    mixed = M.mix(d)
    assert mixed.columns == d.columns
    copies = Counter({i: sum(r["copies"] for r in out if r["doc_id"] == i) for i in {r[0] for r in data}})
    once = {i for i, n in Counter(r[0] for r in data).items() if n == 1}
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert all(got[i] == copies[i] for i in once)
    assert M.plan(H.table(spark, []).select("doc_id", "source", F.lit(0).cast("long").alias("size"))).collect() == []


def test_mix_deals_copies_to_the_rows_of_an_id_in_turn(spark):
    from plumbline.llm import mixing as M

    data = [(i, f"w{i} " * 5, "en", "b", None, None, None, None) for i in (None, None, None, 7, 7, 7, 7, 8, 9)] + [(i, "x y", "en", "a", None, None, None, None) for i in range(20, 25)]
    d = H.table(spark, data)
    copies = {r[0]: r[1] for r in M.plan(d.select("doc_id", "source", M.n_words(d["text"]).alias("size"))).groupBy("doc_id").sum("copies").collect()}
    got = {r[0]: r[1] for r in M.mix(d).groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in copies.items() if n}
    assert any(copies[k] % sum(r[0] == k for r in data) for k in (None, 7))


def test_line_filters_grow_with_their_keys(spark):
    """Inserts of many times the keys that a filter was made for: it is built anew, and finds them all."""
    from plumbline.llm.line_dedup import FULL, LineIndex

    line = lambda k: f"a line of text that is long enough to be counted, {k}"
    docs = lambda ids, ks: spark.createDataFrame([(i, "\n".join(map(line, ks))) for i in ids], "doc_id long, text string")
    index = LineIndex.build(docs(range(6), range(3)), shards=2)
    index = index.insert(docs(range(10, 16), range(400)))
    assert all(r["load"] <= FULL for r in index.filters.collect())
    assert index.drops(docs([10], range(400))).count() == 400
    index = index.delete(docs(range(10, 16), []).select("doc_id"))
    assert index.drops(docs([10], range(400))).count() == 3


def test_clashing_columns_pass_through(spark):
    """Columns named as the operators might name theirs."""
    from plumbline.llm.line_dedup import dedup_lines
    from plumbline.llm.mixing import mix
    from plumbline.llm.substring_dedup import dedup_spans
    from pyspark.sql import functions as F

    names = ["_id", "_k", "_n", "_gone", "_lines", "_kept", "_copies", "_rows", "_row", "_copy", "_D8", "_joined"]
    d = H.table(spark).select("*", *[F.lit(n).alias(n) for n in names])
    for f in (dedup_lines, mix, dedup_spans):
        out = f(d)
        assert [c for c in out.columns if c not in ("n_lines", "n_dropped", "n_words", "n_removed")] == d.columns
        rows = out.select(*names).distinct().collect()
        assert [list(r) for r in rows] == [names]
