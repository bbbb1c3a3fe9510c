"""Substring dedup over a compacted, sparse de Bruijn graph of token k-mers.

Every window of ``WINDOW`` words chooses the k-mer of smallest hash in it, so equal windows
choose equal k-mers at equal places.  Chosen k-mers are the graph's edges; one that follows
another in a document is linked to it by a hash of all words from the first's start to the
second's end.

1. K-mers that are found in several documents, each with its only successor and its only
   predecessor, where all its occurrences have the same.
2. Compaction, by joins: where a k-mer's only successor has it as its only predecessor, the two
   lie on one path.  Each k-mer gets the head of its path and its distance from it, by pointers
   that double their reach each round.  (A document's first k-mer has no predecessor, so there is
   no cycle.)  All documents on a path run along its whole length.
3. A document's run along a path of ``WINDOW`` words or more is one span; windows that hold a
   repeated k-mer and reach over a path's end (branches, ends of passages) are spans of their own.
4. Verification: spans carry their coordinates (document and place) and a 128-bit digest of the
   words themselves, taken from the texts at both ends; a span is a repetition of the smallest
   coordinates of equal words, whatever the hashes of the graph said.
5. Words covered by spans whose source lies in a smaller document leave the text.

Null and empty texts have no words.  Texts shorter than a window lose nothing.  Rows that share
an id are one document (never smaller than itself); a null id is never a source and loses
nothing.  An empty table gives an empty result.  Input columns named like an output (``n_words``,
``n_removed``) are replaced in ``dedup_spans``; others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, read, release, slices
from .word_hashes import mix as _mix
from .word_hashes import words

WINDOW, K = 50, 8
#: Ids of documents with repeated k-mers are broadcast up to this many (16 MB), and shuffled beyond.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def chosen(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers of a run of word hashes, and for each window the place of the k-mer that it chooses: the
    leftmost of the smallest.  Runs of several documents may follow one another; windows over their ends mean nothing."""
    km = np.full(max(0, len(w) - K + 1), _M2, np.uint64)
    for i in range(K):
        km = (km ^ (km >> _U(29))) * _M1 + w[i : i + len(km)]
    km = _mix(km)
    span = WINDOW - K + 1
    at, reach = np.arange(len(km)), 1
    while reach < span and len(at):  # at: places of the smallest of the next ``reach`` k-mers
        step = min(reach, span - reach)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at, reach = np.where(km[left] <= km[right], left, right), reach + step
    return km, at


def _links(w: np.ndarray, pos: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each chosen place a hash of the words from its start to the next one's end; 0 for the ``last`` of a document."""
    out = np.zeros(len(pos), np.uint64)
    i = np.flatnonzero(~last)
    begin, n = pos[i], pos[np.minimum(i + 1, len(pos) - 1)] + K - pos[i]
    h = n.astype(np.uint64)
    for k in range(int(n.max()) if len(n) else 0):
        inside = np.flatnonzero(k < n)
        h[inside] = (h[inside] ^ (h[inside] >> _U(29))) * _M2 + w[begin[inside] + k]
    out[i] = _mix(h) | _U(1)
    return out


def _places(first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of all k-mers, the windows' choices, and for each document the distinct places chosen in it."""
    km, at = chosen(w)
    per = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        p = at[a : max(a, b - WINDOW + 1)]
        per.append(p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p)  # choices never go back
    return km, at, per


def edges(docs: DataFrame) -> DataFrame:
    """doc_id, d8 (row key), n_words, digest (of the words, one blank between), and chosen k-mers: places, hashes, links."""

    def run(batches):
        for part in slices(batches, "text"):
            first, _, _, w, _ = words(part.column("text"))
            km, _, per = _places(first, w)
            ends = np.cumsum([0, *map(len, per)])
            pos = np.concatenate(per)
            last = np.zeros(len(pos), bool)
            last[ends[1:][np.diff(ends) > 0] - 1] = True
            link = _links(w, pos, last)
            digest = [hashlib.sha256(b" ".join(_words(t))).digest() for t in part.column("text").to_pylist()]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64))) for x in (pos - np.repeat(first[:-1], np.diff(ends)), km[pos], link)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d8"), pa.array(np.diff(first), pa.int64()), pa.array(digest, pa.binary()), *lists], names=["doc_id", "d8", "n_words", "digest", "pos", "kmer", "link"])

    kind = "d8 long, n_words long, digest binary, pos array<long>, kmer array<long>, link array<long>"
    return docs.select("doc_id", "text", _row_key()).mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(kind).fields]))


def _row_key():
    """A hash of the text: with the id it names a row whose id may repeat."""
    return F.xxhash64("text").alias("d8")


def paths(kmers: DataFrame) -> DataFrame:
    """kmers(kmer, next, gap, link_out, link_in: null where there are several or none) -> kmer, head, off, for those that
    aren't heads themselves.  Each round all pointers that are not yet at a head jump to where their target points."""
    u = kmers.where("link_out IS NOT NULL").select(F.col("kmer").alias("ptr"), F.col("next").alias("kmer"), F.col("gap").alias("off"), "link_out")
    v = kmers.where("link_in IS NOT NULL").select("kmer", "link_in")
    todo = cut(u.join(v, "kmer").where("link_out = link_in").select("kmer", "ptr", "off"), "dbg-path")
    done, old = None, [todo]
    while not todo.isEmpty():
        all_ = todo if done is None else done.unionByName(todo)
        far = all_.toDF("ptr", "_ptr", "_off")
        step = cut(todo.join(far, "ptr", "left").select("kmer", F.coalesce("_ptr", "ptr").alias("ptr"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), F.col("_ptr").isNull().alias("_at")), "dbg-path")
        settled = step.where("_at").drop("_at")
        done, todo = settled if done is None else done.unionByName(settled), step.where("NOT _at").drop("_at")
        old.append(step)
    out = cut((todo if done is None else done).select("kmer", F.col("ptr").alias("head"), "off"), "dbg-paths")
    release(*old)
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """For each row with k-mers of several documents: doc_id, d8, and those k-mers as an array of
    (pos, first: smallest document, head, off: its path and place there)."""
    at = F.arrays_zip("pos", "kmer", "link")
    occ = rows.where(F.size("pos") > 0).select("doc_id", "d8", F.col("link").alias("_links"), F.col("kmer").alias("_kmers"), F.col("pos").alias("_at"), F.posexplode(at).alias("_i", "_e"))
    get = lambda c, i: F.coalesce(F.get(c, i), F.lit(0).cast("long"))
    here = F.col("_i")
    occ = occ.select("doc_id", "d8", F.col("_e.pos").alias("pos"), F.col("_e.kmer").alias("kmer"), F.col("_e.link").alias("link"), get("_links", here - 1).alias("prev"), get("_kmers", here + 1).alias("next"), (get("_at", here + 1) - F.col("_e.pos")).alias("gap"))
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c))
    stats = occ.groupBy("kmer").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), one("link").alias("link_out"), one("prev").alias("link_in"), F.min("next").alias("next"), F.min("gap").alias("gap")).where("first != last").drop("last")
    # written, so that the join has plain exchanges on both sides and adaptive execution can split a hot k-mer
    stats = cut(stats, "dbg-kmers")
    path = paths(stats)
    known = cut(stats.join(path, "kmer", "left").select("kmer", "first", F.coalesce("head", "kmer").alias("head"), F.coalesce("off", F.lit(0)).cast("int").alias("off")), "dbg-known", stats)
    out = cut(occ.select("doc_id", "d8", "pos", "kmer").join(known, "kmer").groupBy("doc_id", "d8").agg(F.collect_list(F.struct("pos", "first", "head", "off")).alias("hits")), "dbg-hits", path)
    release(known)
    return out


def spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows that have hits: doc_id, d8, text (null where the row is a source only), and its spans: at, n, digest."""

    def run(batches):
        for part in slices(batches, "text"):
            first, _, _, w, _ = words(part.column("text"))
            _, choice = chosen(w)
            ids, texts, out = part.column("doc_id").to_pylist(), part.column("text").to_pylist(), []
            for r, hit in enumerate(part.column("hits")):
                flat = hit.values
                p, order = np.unique(flat.field("pos").to_numpy(zero_copy_only=False), return_index=True)
                source, head, off = (flat.field(c).to_numpy(zero_copy_only=False)[order] for c in ("first", "head", "off"))
                place = choice[first[r] : max(first[r], first[r + 1] - WINDOW + 1)] - first[r]
                i = np.searchsorted(p, place)
                known = (i < len(p)) & (p[np.minimum(i, len(p) - 1)] == place)
                win, i = np.flatnonzero(known), i[known]
                new = np.concatenate([[True], (head[1:] != head[:-1]) | (off[1:] - off[:-1] != p[1:] - p[:-1])])
                run_of = np.cumsum(new) - 1
                begin, end = p[new], p[np.concatenate([new[1:], [True]])] + K
                begin_of, end_of = begin[run_of[i]], end[run_of[i]]
                inside = (win >= begin_of) & (win + WINDOW <= end_of)
                long = np.unique(run_of[i[inside]])
                at = np.concatenate([begin[long], win[~inside]])
                n = np.concatenate([end[long] - begin[long], np.full(len(at) - len(long), WINDOW)])
                own = _words(texts[r])
                text = b" ".join(own)
                place = np.cumsum([0, *(len(x) + 1 for x in own)])
                digest = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(place[at].tolist(), (place[at + n] - 1).tolist(), strict=True)]
                out.append((at, n, digest))
                if not (source < ids[r]).any():
                    texts[r] = None
            ends = pa.array(np.cumsum([0, *(len(a) for a, _, _ in out)]), pa.int32())
            at, n = (pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (at, n, pa.array([d for _, _, x in out for d in x], pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column("d8"), pa.array(texts, pa.string()), *lists], names=["doc_id", "d8", "text", "at", "n", "digest"])

    text = docs.select(F.col("doc_id").cast("long"), "text", _row_key())
    ids = hits.select("doc_id", "d8")
    if ids.count() <= BROADCAST_IDS:  # only texts that are needed are shuffled
        text = text.join(F.broadcast(ids), ["doc_id", "d8"], "left_semi")
    kind = "doc_id long, d8 long, text string, at array<long>, n array<long>, digest array<binary>"
    return text.join(hits, ["doc_id", "d8"]).select("doc_id", "d8", "text", "hits").mapInArrow(run, kind)


def _joined(text):
    """Words with one blank between them."""
    blanks = r"[\x20\x09-\x0D]+"
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), blanks, " "))


def remove(rows: DataFrame) -> DataFrame:
    """doc_id, d8, text, gone (array of at, n) -> doc_id, d8, kept (words, one blank between), n_removed."""

    def run(batches):
        for b in slices(batches, "text"):
            kept, n = [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone"), strict=True):
                own, flat = _words(text), gone.values
                at, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + size, -1)
                stay = np.cumsum(mark)[:-1] == 0
                n.append(int(len(own) - stay.sum()))
                kept.append(b" ".join([own[i] for i in np.flatnonzero(stay)]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("d8"), pa.array(kept, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "d8", "kept", "n_removed"])

    return rows.mapInArrow(run, "doc_id long, d8 long, kept string, n_removed long")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, d8, n_words, digest) of all documents, and changed(doc_id, d8, kept, n_removed) of those that lose words."""
    rows = cut(edges(docs), "dbg-edges")
    some = docs.where("doc_id IS NOT NULL")
    hits = repeated(rows.where("doc_id IS NOT NULL"))
    found = cut(spans(some, hits), "dbg-spans", hits)
    each = found.select("doc_id", "d8", F.explode(F.arrays_zip("at", "n", "digest")).alias("s")).select("doc_id", "d8", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.col("s.digest").alias("digest"))
    # the smallest coordinates at which these words stand
    source = each.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source != last").drop("last")
    source = cut(source, "dbg-sources")
    gone = each.join(source, "digest").where("source < doc_id").groupBy("doc_id", "d8").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    text = found.where("text IS NOT NULL").dropDuplicates(["doc_id", "d8"]).select("doc_id", "d8", "text")
    return rows.select("doc_id", "d8", "n_words", "digest"), remove(text.join(gone, ["doc_id", "d8"]))


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with repeated spans left out of text (words with one blank between where any left), n_words, n_removed."""
    rows, changed = removals(docs.select("doc_id", "text"))
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    joined, d8, id_, k, kept, n = fresh(docs.columns, "_joined", "_d8", "_id", "_k", "_kept", "_n")
    text = docs.select(*keep, _joined(F.col("text")).alias(joined), _row_key().alias(d8))
    j = text.join(changed.toDF(id_, k, kept, n), (F.col("doc_id") == F.col(id_)) & (F.col(d8) == F.col(k)), "left")
    size = F.when(F.col(joined) == "", F.lit(0)).otherwise(F.size(F.split(joined, " "))).cast("long")
    return j.select(*[F.coalesce(kept, "text").alias("text") if c == "text" else F.col(c) for c in keep], size.alias("n_words"), F.coalesce(n, F.lit(0).cast("long")).alias("n_removed"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows, changed = removals(read(spark, sf_dir, "documents").select("doc_id", "text"))
    c = changed.select(F.col("doc_id").alias("_id"), F.col("d8").alias("_k"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("_sha"))
    j = rows.join(c, (F.col("doc_id") == F.col("_id")) & (F.col("d8") == F.col("_k")), "left")
    return j.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_sha", F.lower(F.hex("digest"))).alias("kept_sha256"))


def op5_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM d WHERE len(ws) >= {WINDOW})),
g AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM w) WHERE first < doc_id),
c AS (SELECT DISTINCT rid, i + j AS p FROM g, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS j)),
u AS (SELECT rid, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM d),
k AS (SELECT u.rid, count(c.p) AS n, string_agg(word, ' ' ORDER BY u.p) FILTER (c.p IS NULL) AS kept FROM u LEFT JOIN c ON u.rid = c.rid AND u.p = c.p GROUP BY u.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid"""
