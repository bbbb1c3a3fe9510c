"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without space and U+0009..U+000D at both ends, A-Z lower-cased; keys
of at least ``MIN_CHARS`` code points are indexed under a 128-bit digest.  The index has

* postings (key, doc_id): exact, what makes deletions possible;
* counts (shard, key, n_docs, last_doc): exact reference counts;
* filters (shard, filter): one cuckoo filter a shard over the keys in ``MIN_DOCS`` documents
  or more.  ``insert`` adds keys that cross the threshold, ``delete`` takes out those that
  fall below it.

``drops`` probes lines shard by shard, salted by document so that a line in a third of all
documents is spread, and confirms what the filters let through against the counts.

Null or empty text is one empty line.  Rows that share a doc_id are one document.  A null
doc_id isn't counted, and loses every droppable line (it is never the largest).  Lines shorter
than the limit are never dropped.  An empty table gives empty results.  Input columns named
like an output (``n_lines``, ``n_dropped``) are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lower_ascii, read

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 16
STRIP = " \t\n\x0b\x0c\r"


class Cuckoo:
    """Cuckoo filter: 4 slots a bucket, 16-bit fingerprints, partial-key hashing, and a stash for what finds no slot."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None):
        self.m = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.stash = stash or []

    @classmethod
    def sized(cls, n: int) -> "Cuckoo":
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n) / 3)))))

    @classmethod
    def load(cls, raw: bytes) -> "Cuckoo":
        m, k = np.frombuffer(raw[:16], np.int64)
        stash = np.frombuffer(raw[16 : 16 + 16 * k], np.int64).reshape(-1, 2)
        return cls(int(m), np.frombuffer(raw[16 + 16 * k :], np.uint16).reshape(m, cls.SLOTS).copy(), [(int(a), int(b)) for a, b in stash])

    def dump(self) -> bytes:
        return np.array([self.m, len(self.stash)], np.int64).tobytes() + np.array(self.stash, np.int64).tobytes() + self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: n x 2 of uint64 -> fingerprints and both buckets."""
        fp = (keys[:, 1] >> np.uint64(48)).astype(np.int64)
        fp[fp == 0] = 1
        one = (keys[:, 0] & np.uint64(self.m - 1)).astype(np.int64)
        return fp, one, self.other(one, fp)

    def other(self, bucket, fp):
        return bucket ^ ((fp * 0x5BD1E995 >> 7) & (self.m - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        f = fp.astype(np.uint16)[:, None]
        found = (self.table[a] == f).any(1) | (self.table[b] == f).any(1)
        for f1, b1 in self.stash:
            found |= (fp == f1) & ((a == b1) | (b == b1))
        return found

    def insert(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(0)
        for f, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = f
                    break
            else:
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at = int(self.other(at, f))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = f
                        break
                else:
                    self.stash.append((f, at))

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for f, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            held = [x for x in self.stash if x[0] == f and x[1] in (a, b)]
            if held:
                self.stash.remove(held[0])
                continue
            for at in (a, b):
                slot = np.flatnonzero(self.table[at] == f)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break


def _as_pairs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 2)


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(STRIP)))


def digest(key):
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def _shard(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key): the distinct indexed keys of each row."""
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col("text"), "\n"), line_key), lambda k: F.length(k) >= MIN_CHARS))
    return docs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", digest(F.col("k")).alias("key"))


FILTER, FULL = "shard int, filter binary, load double", 0.85


def _tables(changes: DataFrame, filters: DataFrame | None) -> DataFrame:
    """Filters after changes(shard, key, add): cogrouped by shard; load: share of the slots in use, 1 if some key found none."""

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, add = _as_pairs(left["key"]), np.array(left["add"].to_pylist(), bool)
        f = Cuckoo.load(right["filter"][0].as_py()) if right.num_rows else Cuckoo.sized(int(add.sum()) * 2)
        f.delete(keys[~add])
        f.insert(keys[add])
        shard = (left if left.num_rows else right)["shard"][0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.dump()], pa.binary()), "load": pa.array([1.0 if f.stash else float((f.table > 0).mean())])})

    if filters is None:
        filters = changes.sparkSession.createDataFrame([], FILTER)
    return changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(update, FILTER)


@dataclass
class LineIndex:
    """State of the index; every operation returns a new one, so an earlier one can be kept.

    A change counts again only the keys that it touches, adds its postings as a table of their own and updates the
    filters of its shards; a filter whose load passes ``FULL`` is built anew, twice as large as its keys need."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def _counted(postings: DataFrame, shards: int) -> DataFrame:
        # null ids have no reference; a hot key is summed before it is shuffled
        c = postings.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return c.select(_shard(shards).alias("shard"), "key", "n_docs", "last_doc")

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, keep_postings: bool = True) -> "LineIndex":
        """``keep_postings=False`` leaves the postings as a plan over ``docs``, for an index that is used once."""
        shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        postings = line_keys(docs)
        if keep_postings:
            postings = cut(postings.where("doc_id IS NOT NULL").distinct(), "line-postings")
        counts = cut(cls._counted(postings, shards), "line-counts")
        return cls(postings, counts, cut(_tables(cls._live(counts).withColumn("add", F.lit(True)), None), "line-filters"), shards)

    @staticmethod
    def _live(counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= MIN_DOCS).select("shard", "key")

    def _changed(self, postings: DataFrame, touched: DataFrame) -> "LineIndex":
        """touched: the distinct keys whose postings changed."""
        before = self._live(self.counts.join(touched, "key", "left_semi"))
        again = cut(self._counted(postings.join(touched, "key", "left_semi"), self.shards), "line-counts")
        now = self._live(again)
        counts = cut(self.counts.join(touched, "key", "left_anti").unionByName(again), "line-counts")
        changes = now.join(before, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(before.join(now, "key", "left_anti").withColumn("add", F.lit(False)))
        filters = cut(_tables(changes, self.filters), "line-filters")
        full = filters.where(F.col("load") > FULL).select("shard")
        if not full.isEmpty():
            larger = _tables(self._live(counts).join(full, "shard", "left_semi").withColumn("add", F.lit(True)), None)
            filters = cut(filters.join(full, "shard", "left_anti").unionByName(larger), "line-filters", filters)
        return LineIndex(postings, counts, filters, self.shards)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Documents may be inserted again: postings are a set."""
        new = cut(line_keys(docs).where("doc_id IS NOT NULL").distinct().join(self.postings, ["doc_id", "key"], "left_anti"), "line-postings")
        return self._changed(self.postings.unionByName(new.select(*self.postings.columns)), new.select("key").distinct())

    def delete(self, ids: DataFrame) -> "LineIndex":
        """ids(doc_id): takes these documents out; ids that aren't in the index change nothing."""
        ids = ids.select("doc_id").distinct()
        touched = cut(self.postings.join(ids, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        return self._changed(cut(self.postings.join(ids, "doc_id", "left_anti"), "line-postings"), touched)

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key) of the lines that documents lose."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        lines = line_keys(docs).select(_shard(self.shards).alias("shard"), salt.alias("salt"), "doc_id", "key")
        salted = self.filters.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.select(["doc_id", "key"])
            if not right.num_rows or not left.num_rows:
                return left.slice(0, 0)
            return left.filter(pa.array(Cuckoo.load(right["filter"][0].as_py()).contains(_as_pairs(left["key"]))))

        schema = lines.select("doc_id", "key").schema
        maybe = lines.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(probe, schema)
        exact = self.counts.where(F.col("n_docs") >= MIN_DOCS).select("key", "last_doc")
        return maybe.join(exact, "key").where(F.coalesce(F.col("doc_id") != F.col("last_doc"), F.lit(True))).select("doc_id", "key")


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with the lines of ``drops`` left out of text, and n_lines (before), n_dropped."""
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    id_, gone, lines, kept = fresh(docs.columns, "_id", "_gone", "_lines", "_kept")
    lost = drops.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("key").alias(gone))
    # rows with null ids have their drops under a null key of their own
    j = docs.select(*keep, F.col("text"), F.split(F.coalesce("text", F.lit("")), "\n").alias(lines)).join(lost, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    stays = lambda x: (F.length(x) < MIN_CHARS) | ~F.array_contains(F.col(gone), digest(line_key(x)))
    j = j.withColumn(kept, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(F.filter(lines, stays)))
    out = j.select(*keep, F.array_join(kept, "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame) -> DataFrame:
    index = LineIndex.build(docs.select("doc_id", "text"), keep_postings=False)
    return without(docs, index.drops(docs.select("doc_id", "text")))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_sql() -> str:
    strip = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {strip}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last_doc AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY rid"""
