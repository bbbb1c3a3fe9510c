"""Near-duplicate classes with HyperMinHash registers.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased), hashed to 64
bits.  The top bits choose one of ``REGISTERS`` buckets; a bucket keeps its smallest hash as a
16-bit register: the count of leading zeros and ten mantissa bits.  Buckets that no shingle
fell into are filled from others, in a fixed random order for each bucket, then by a hash of
their own, so that two registers agree with the probability of the sets' Jaccard similarity.

1. Texts of one set collapse to a class (a set digest), its smallest id its representative.
2. ``BANDS`` bands of ``ROWS`` registers; representatives that share a band meet in a bucket.
   No two bands share a register: with registers that agree independently, a pair at similarity 0.8 shares no
   band with probability (1 - 0.8 ** 8) ** 64 = 8e-6; no later pass finds it.
3. Each representative is first compared with the smallest id that it shares a bucket with.
   Registers estimate the similarity, corrected for chance collisions; pairs five deviations
   below are dropped, the others are confirmed on the full sets.
4. Components of confirmed links, by label propagation.
5. Buckets that still hold several components: their members are compared across components by
   registers, inside tasks (small buckets by a join), and plausible pairs are confirmed.  Buckets
   larger than ``BLOCK`` are dealt into blocks of bounded size, every two of which meet in a task.
   Components of all links are the classes.

No limit on partners or bucket sizes: hot buckets shuffle as rows and adaptive joins split them.

Null and empty texts, and such without words, have an empty set and link with nothing.  Fewer
words than a shingle make one shingle.  Rows that share a doc_id are one node.  Rows with a
null id get a null component and are kept.  An empty table gives an empty result.  Only the
columns named are read; ``near_dedup`` passes the others through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, read, release, slices
from .components import connected
from .word_hashes import mix as _mix
from .word_hashes import words

REGISTERS, BANDS, ROWS, MANTISSA, PROBES = 512, 64, 8, 10, 6
#: Buckets up to SMALL are paired by a join, up to BLOCK in one task, beyond in blocks of it.
SMALL, BLOCK = 6, 2048
#: Ids of bucket mates are broadcast up to this many (16 MB), and shuffled beyond.
BROADCAST_IDS = 1_000_000
_BITS = REGISTERS.bit_length() - 1
#: Chance that two registers of different elements agree (ten mantissa bits, geometric exponent).
COLLISION = 1 / 3 / 2**MANTISSA
_U = np.uint64


_SALT = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PROBE = (_mix(np.arange(1, REGISTERS * PROBES + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) % _U(REGISTERS)).astype(np.int64).reshape(PROBES, REGISTERS)
#: The registers of each band; no two bands share one.
_COLUMNS = np.argsort(_mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)))[: BANDS * ROWS].reshape(BANDS, ROWS)
_WEIGHT = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)).reshape(BANDS, ROWS) | _U(1)
_BAND = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x8EBC6AF09C88C6E3))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    first, _, _, w, _ = words(texts, fold=True)
    n = np.diff(first)
    out = [np.zeros(0, np.uint64)] * len(n)
    h = np.zeros(len(w), np.uint64)
    for i in range(size):  # h: hashes of the i + 1 words from each place
        h = _mix(h[: len(w) - i] * _U(0x9E3779B97F4A7C15) + w[i:]) if i < len(w) else h[:0]
        for r in np.flatnonzero(n == i + 1) if i + 1 < size else np.flatnonzero(n >= size):
            s = np.sort(h[first[r] : first[r + 1] - i])
            out[r] = s[np.concatenate([[True], s[1:] != s[:-1]])]
    return out


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Registers of non-empty sets (rows x REGISTERS), and which buckets their own shingles fill."""
    rows, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    at = rows * REGISTERS + (flat >> _U(64 - _BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    full, least = np.zeros((len(sets), REGISTERS), bool), np.zeros((len(sets), REGISTERS), np.uint64)
    full.ravel()[at[first]] = True
    least.ravel()[at[first]] = flat[first] << _U(_BITS)
    todo = ~full
    for probe in _PROBE:
        r, b = np.nonzero(todo & full[:, probe])
        # what is borrowed is salted by the bucket it goes to
        least[r, b] = _mix(least[r, probe[b]] ^ _SALT[b])
        todo[r, b] = False
    for r in np.flatnonzero(todo.any(1)):
        missing = np.flatnonzero(todo[r])
        for k in range(0, len(missing), 64):
            part = missing[k : k + 64]
            least[r, part] = _mix(sets[r][None, :] ^ _SALT[part][:, None]).min(1)
    m, e = np.frexp((least >> _U(11)).astype(np.float64))  # 53 bits: exact
    code = np.where(least >> _U(11) > 0, ((53 - e) << MANTISSA) | ((m * 2 - 1) * 2**MANTISSA).astype(np.int64), 63 << MANTISSA)
    return code.astype(np.uint16), full


def band_keys(regs: np.ndarray) -> np.ndarray:
    """rows x registers -> rows x BANDS keys."""
    return _mix((_mix(regs[:, _COLUMNS].astype(np.uint64) + _BAND[:, None]) * _WEIGHT).sum(2, dtype=np.uint64) + _BAND).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), regs, full (bit set) of every row."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            regs, full = [None] * len(sets), [None] * len(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            for i, r, f in zip(some, *registers([sets[i] for i in some]), strict=True) if some else ():
                regs[i], full[i] = r.tobytes(), np.packbits(f).tobytes()
            digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, regs, full))], names=["doc_id", "n_shingles", "digest", "regs", "full"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_shingles long, digest binary, regs binary, full binary").fields]))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, set (sorted hashes as longs) of every row."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def _matrix(col: pa.Array, kind: type) -> np.ndarray:
    """A binary column of equal lengths as rows x values."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _members(reps: DataFrame) -> DataFrame:
    """(key, id) of all bands of all representatives."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = band_keys(_matrix(part.column("regs"), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("id").to_numpy(), BANDS))], names=["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key long, id long")


def _plausible(same: np.ndarray, union: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and registers allow a similarity of ``least``.

    Filled buckets of the union hold a sample, without replacement, of its elements: the estimate,
    freed of chance collisions, must not be five deviations of that sample below ``least``."""
    n = np.maximum(union, 1)
    jac = (same / n - COLLISION) / (1 - COLLISION)
    whole = np.maximum((na + nb) / (1 + least), n)  # the union can't be larger at that similarity
    off = 5 * np.sqrt(least * (1 - least) / n * (whole - n) / np.maximum(whole - 1, 1))
    return (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9) & (jac + off + 1e-3 >= least)


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) whose estimate allows a similarity of ``least``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                fa, fb = (np.unpackbits(_matrix(b.column(c), np.uint8), axis=1).astype(bool) for c in ("fa", "fb"))
                same = ((_matrix(b.column("ra"), np.uint16) == _matrix(b.column("rb"), np.uint16)) & fa & fb).sum(1)
                stay = _plausible(same, (fa | fb).sum(1), b.column("na").to_numpy(), b.column("nb").to_numpy(), least)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(stay))

    r = reps.select("id", "regs", "full", "n")
    j = pairs.join(r.toDF("a", "ra", "fa", "na"), "a").join(r.toDF("b", "rb", "fb", "nb"), "b")
    return j.mapInArrow(run, "a long, b long")


def _compared(groups: DataFrame, least: float) -> DataFrame:
    """groups(key, i, j, id, comp, regs, full, n) -> plausible pairs (a, b) of different components, compared inside
    the task: the members outside a group's largest component against all of it.

    A pair that agrees in an earlier band is left to the bucket of that band, so it is listed once."""

    def run(t: pa.Table) -> pa.Table:
        ids, comp, size = (t[c].to_numpy() for c in ("id", "comp", "n"))
        regs = _matrix(t["regs"], np.uint16)
        full = np.unpackbits(_matrix(t["full"], np.uint8), axis=1).astype(bool)
        names, n = np.unique(comp, return_counts=True)
        bands = band_keys(regs)
        earlier = bands[:, : np.flatnonzero(bands[0] == t["key"][0].as_py())[0]]
        out = []
        rest = np.flatnonzero(comp != names[n.argmax()])
        for at in range(0, len(rest), 8):
            k = rest[at : at + 8]
            same = ((regs[k][:, None, :] == regs[None]) & full[k][:, None, :] & full[None]).sum(2)
            union = (full[k][:, None, :] | full[None]).sum(2)
            x, y = np.nonzero(_plausible(same, union, size[k][:, None], size[None], least) & (comp[k][:, None] != comp[None]))
            for part in range(0, len(x), 4096):
                i, j = k[x[part : part + 4096]], y[part : part + 4096]
                once = ~(earlier[i] == earlier[j]).any(1)
                out.append(np.stack([ids[i], ids[j]], 1)[once])
        pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return groups.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, common, total: sizes of intersection and union of the full sets, a row at a time in the JVM."""
    j = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    return j.select("a", "b", F.col("common").cast("long"), (F.col("both") - F.col("common")).cast("long").alias("total"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members(key, id) of buckets that hold several components, with comp and the bucket's size n."""
    m = members.select("key", "id").join(labels.toDF("id", "_l"), "id", "left").select("key", "id", F.coalesce("_l", "id").alias("comp"))
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n")
    return m.join(mixed, "key")


def _residual(members: DataFrame, labels: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Plausible pairs across components that share a bucket."""
    open_ = cut(_mixed(members, labels), "near-open")
    small = open_.where(F.col("n") <= SMALL)
    x, y = small.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), small.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
    few = _estimated(x.join(y, "key").where("a < b AND ca != cb").select("a", "b").distinct(), reps, least)
    r = reps.select("id", "regs", "full", F.col("n").alias("_size"))
    large = open_.where(F.col("n") > SMALL)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    g = large.withColumn("_o", own).withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    g = g.select("key", F.least("_o", "_b").alias("i"), F.greatest("_o", "_b").alias("j"), "id", "comp").join(r, "id").withColumnRenamed("_size", "n")
    return few.unionByName(_compared(g, least)).distinct()


def _components(reps: DataFrame, docs: DataFrame, size: int, percent: int, same: DataFrame) -> DataFrame:
    """(id, label) of all representatives that are linked; ``same``: links known beforehand."""
    least = percent / 100
    members = _members(reps)
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").drop("last")
    members = cut(members.join(hubs, "key").select("key", "id", "hub"), "near-members")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    ids = members.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # texts that share no bucket are in no pair: their registers stay out of every join below
    shared = cut(reps.join(ids, "id", "left_semi"), "near-shared")
    sets = cut(full_sets(texts.join(ids, "id", "left_semi"), size), "near-sets")
    link = 100 * F.col("common") >= percent * F.col("total")
    # an id with several rows has several sets: each pair of them counts
    confirmed = lambda p: _confirmed(p, sets).where(link).select("a", "b").distinct()
    first = members.where("id != hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    links = cut(confirmed(_estimated(first, shared, least)).unionByName(same), "near-links")
    labels = connected(links)
    more = cut(confirmed(cut(_residual(members, labels, shared, least), "near-pairs")), "near-links")
    if more.isEmpty():
        release(members, shared, sets, links, more)
        return labels
    out = connected(links.unionByName(more))
    release(members, shared, sets, links, more)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; Jaccard similarity of ``percent`` in 100 or more links."""
    d = docs.select("doc_id", "text")
    rows = cut(sketches(d, shingle), "near-rows")
    some = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one row a class: copies are combined before the shuffle
    reps = some.groupBy("digest").agg(F.min(F.struct("doc_id", "regs", "full", F.col("n_shingles").alias("n"))).alias("r"))
    reps = cut(reps.select("digest", F.col("r.doc_id").alias("id"), "r.regs", "r.full", "r.n"), "near-reps")
    classes = reps.select("digest", "id")
    # rows of one id are one node: the classes of its sets are linked
    several = some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("doc_id")
    its = some.join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "id").distinct()
    ends = its.groupBy("doc_id").agg(F.min("id").alias("a"))
    same = cut(its.join(ends, "doc_id").select("a", F.col("id").alias("b")).where("a != b"), "near-same")
    labels = _components(reps, d, shingle, percent, same)
    j = rows.join(classes, "digest", "left").join(labels.toDF("id", "_label"), "id", "left")
    comp = F.coalesce("_label", "id", "doc_id")
    comp = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), comp).otherwise(F.col("doc_id"))
    return j.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that another document of their class stands for."""
    gone = near_duplicates(docs, shingle, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4)
