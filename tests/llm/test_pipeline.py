"""The pipeline against plain versions of its stages, each fed with what the plain stage before it kept."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from . import helpers as H
from .test_near_lines_mix import brute_near
from .test_tokens_licenses import tiktoken_encoding

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    docs = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            k = H.low(x.strip(H.WS))
            if len(k) >= 40:
                docs[k].add(r[0])
    last = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    return [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if last.get(H.low(x.strip(H.WS)), r[0]) == r[0]), *r[2:]) for r in rows]


def plain_mix(rows):
    size = {r[0]: len(H.words(r[1])) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    names = sorted(by)
    whole = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, total = {}, set(names), 1.5 * sum(whole.values())
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * whole[s]] or list(free)
        done = over == list(free) and all(share[s] <= 2 * whole[s] for s in over)
        for s in over:
            target[s] = share[s] if done else 2 * whole[s]
            free.discard(s)
    out = Counter()
    for s in names:
        u = int(hashlib.md5(f"plumbline/{s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / whole[s] if whole[s] else 0.0
        for k, i in enumerate(sorted(by[s], key=lambda i: (size[i], i)), 1):
            out[i] += int(np.floor(rate * k + u) - np.floor(rate * (k - 1) + u))
    return out


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as C
    from plumbline.llm import boosted_quality as B

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*C.COLUMNS).collect()]
    forest = B.train(spark.read.parquet(f"{SF}/documents.parquet"), B.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    good = forest.score(np.array([B.statistics(r[1]) for r in docs])) >= 0.5
    docs = plain_lines([r for r, g in zip(docs, good, strict=True) if g])
    kept = {r[0] for r in brute_near(docs, 5) if r[3]}
    docs = [r for r in docs if r[0] in kept]
    copies, enc = plain_mix(docs), tiktoken_encoding()
    want = Counter()
    for r in docs:
        ids = enc.encode_ordinary(r[1])
        if copies[r[0]]:
            want[(r[0], len(ids), H.sha(",".join(map(str, ids))), H.sha(r[1]))] = copies[r[0]]
    assert Counter(map(tuple, C.run(spark, SF).collect())) == want


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as C

    d = H.table(spark)
    for name, stage in C.STAGES[:-1]:
        if name != "quality classifier":
            assert tuple(stage(spark, d, SF).columns) == C.COLUMNS
            assert stage(spark, d.where("false"), SF).count() == 0
    assert {r["doc_id"] for r in C.STAGES[-1][1](spark, d, SF).collect()} == {r[0] for r in H.rows()}
