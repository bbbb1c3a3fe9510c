"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone.  Each is cut into at most ``BINS`` quantile bins; trees
are grown level by level from gradient histograms (logistic loss, leaf-wise Newton steps) and
flattened into arrays of feature, threshold and leaf value, a complete binary tree each, so a
batch of documents walks all levels with numpy indexing.

Training uses at most ``SAMPLE`` labelled rows, those of smallest hash of their id, so the
sample doesn't depend on partitioning; the bound is what the driver holds, while every document is scored.

Null and empty texts have all statistics 0 and are scored like any other.  Every row is scored
by itself; repeated rows repeat.  Ids labelled twice with different labels count as both; null
labels and ids train nothing.  Without labelled rows of both classes every score is the share
of label 1 (1 with no labels: nothing is known against a text).  Only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, slices

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST, L2, SEED = 20_000, 64, 60, 4, 0.15, 20, 1.0, 7
FEATURES = [
    "log_words", "log_chars", "word_len", "long_words", "upper", "digit", "punct", "symbol", "mark", "non_ascii", "pipe", "angle",
    "distinct_words", "top_word", "top3_words", "one_char", "lines", "line_len", "dup_lines", "short_lines", "end_mark", "all_caps",
    "lower_start", "urls", "entropy", "repeat4", "longest_word", "brackets",
]
_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "punct": np.isin(_BYTES, [*b".,;:'\"-?()"]),
    "symbol": np.isin(_BYTES, [*b"#*$%&|<>@^~=_+\\/"]),
    "mark": np.isin(_BYTES, [*b"!"]),
    "non_ascii": _BYTES >= 128,
    "pipe": np.isin(_BYTES, [*b"|"]),
    "angle": np.isin(_BYTES, [*b"<>"]),
    "brackets": np.isin(_BYTES, [*b"[]{}"]),
}
_URL = re.compile(rb"https?://|www\.")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {k: float(count[m].sum()) / size for k, m in _CLASS.items()}
    lens = np.fromiter(map(len, words), np.int64, n)
    freq: dict[bytes, int] = {}
    for w in words:
        freq[w] = freq.get(w, 0) + 1
    top = sorted(freq.values(), reverse=True)[:3]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = count[count > 0] / size
    caps = sum(w.isupper() for w in words)
    fours = set(zip(words, words[1:], words[2:], words[3:]))
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    return [
        np.log1p(n), np.log1p(size), lens.mean(), float((lens > 14).mean()), share["upper"], share["digit"], share["punct"], share["symbol"], share["mark"],
        share["non_ascii"], share["pipe"], share["angle"], len(freq) / n, top[0] / n, sum(top) / n, float((lens == 1).mean()), len(lines) / n,
        size / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), ends / len(lines), caps / n,
        sum(97 <= x.lstrip()[0] <= 122 for x in lines) / len(lines), len(_URL.findall(raw)) / n, float(-(p * np.log2(p)).sum()), 1 - len(fours) / (n - 3) if n > 3 else 0.0,
        float(np.log1p(lens.max())), share["brackets"],
    ]


@dataclass
class Forest:
    """Complete trees of equal depth: arrays of trees x inner nodes, and trees x leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(f).bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = y.mean() if len(y) else 1.0
    base = float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6))))
    none = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not 0 < rate < 1:
        return none
    n, k = x.shape
    edges = _edges(x)
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > t  <=>  x > edge t
    flat = b + np.arange(k) * BINS
    raw = np.full(n, base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (k * BINS) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, k), width * k * BINS).reshape(width, k, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gt, ht, nt = (v[:, :1, -1:] for v in hist)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i, j in enumerate(best):
                f, t = divmod(int(j), BINS)
                if gain[i, f, t] > 1e-6 and t < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][t]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw = raw + value[leaf]
        trees.append((feature, threshold, value))
    return Forest(base, *(np.stack(v) for v in zip(*trees, strict=True)))


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``stats`` array<double>."""

    def run(batches):
        for b in slices(batches, "_text"):
            stats = [statistics(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    d = docs.select(*keep, F.col("text").alias("_text"))
    return d.mapInArrow(run, T.StructType([*(d.schema[c] for c in keep), T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """labels(doc_id, label 0/1).  The sample's ids (``sample`` at most) are broadcast to the texts."""
    rows = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "label").limit(sample)
    picked = rows.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    got = with_statistics(texts, ("doc_id", "_label")).toPandas().sort_values(["doc_id", "_label"], kind="stable")
    x = np.array(got["stats"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["_label"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row; a text that is kept goes to the workers once."""
    cols, again = [c for c in keep if c != "text"], "text" in keep

    def run(batches):
        for part in slices(batches, "_text", 1 << 20):
            x = np.array([statistics(t) for t in part.column("_text").to_pylist()]).reshape(-1, len(FEATURES))
            own = [part.column(c) for c in cols] + [part.column("_text")] * again
            yield pa.RecordBatch.from_arrays([*own, pa.array(forest.score(x))], names=[*cols, *["text"] * again, "score"])

    d = docs.select(*cols, F.col("text").alias("_text"))
    text = [T.StructField("text", T.StringType())] * again
    return d.mapInArrow(run, T.StructType([*(d.schema[c] for c in cols), *text, T.StructField("score", T.DoubleType())]))


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("quality").alias("label"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, training_labels(read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
