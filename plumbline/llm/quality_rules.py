"""Quality rules with adaptive thresholds (DataFrame functions only).

Each text gives integer counts and four integer rates.  A mergeable quantile sketch (a
histogram over log-linear integer bins: exact below 128, 1/64 relative error above) is kept
per language, source and rate; sketches of a language, and of the corpus, are sums of those
below them.  A rate has a level p (a percentile): with Q(p) from the sketch of a text's own group,
it is an outlier above Q(p) + ``reach`` * (Q(p) - Q(50)), and for rates of which low values count
too, below Q(100 - p) - ``reach`` * (Q(50) - Q(100 - p)).  Differences count as 1, the sketch's
unit, at least; nothing else is fixed.  So a source in which symbols or repeated lines are usual
has a wide fence and one in which they never occur a narrow one.  Groups with fewer than ``least``
texts use their language's sketch, then the corpus's.

Nulls: a null text counts as empty; null languages and sources form groups of their own.
Empty texts fail the base rule (fewer than 20 words).  Repeated rows are judged one by one
and each counts in the sketches; an empty table gives an empty result.  Columns of the input
other than those named are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: rate name -> (level, whether low values count as outliers too).  Symbols and letters a word are a matter of a source's
#: style, so its upper tenth is measured; repetition occurs in a few texts of any source, so its upper hundredth is.
RATES = {"symbol_rate": (90, False), "dup_line_rate": (99, False), "repeat_rate": (99, False), "word_len": (90, True)}
LEAST, REACH = 200, 3


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns, counts and rates of every whole text; no shuffle, no Python.

    The result is written: a filter on a count that was pushed into the plan below would compute
    the arrays again for each of their elements."""
    d = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        *keep,
        F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
        F.length(F.regexp_replace("_t", SYMBOLS[:-1] + "]", "")).alias("_rest"),
        F.length("_t").alias("_len"),
        lines.alias("_lines"),
    )
    d = d.select(
        *keep, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.col("_len") - F.col("_rest")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    empty = F.array().cast("array<bigint>")
    d = d.select(*kept, F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.lit(WINDOW))))).otherwise(empty).alias("_h"))
    # most texts repeat no window: only the others are sorted
    d = d.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["h"] == x["h"], F.lit(False))
    d = d.select(*kept, F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p.cast("long"))).alias("n"), (p.cast("long") + WINDOW).alias("end"))
    d = d.select(*kept, F.coalesce(F.aggregate("_p", start, step)["n"], F.lit(0).cast("long")).alias("n_repeat_words"))
    per = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    d = d.select(
        "*",
        per("n_symbols", "word_chars", 1000).alias("symbol_rate"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_line_rate"),
        per("n_repeat_words", "n_words", 1000).alias("repeat_rate"),
        per("word_chars", "n_words", 10).alias("word_len"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    return cut(d, "quality-counts")


def sketch(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row for each group, rate and bin: n.  Sketches merge by adding n."""
    bits = "length(bin(v))"
    bin_ = F.expr(f"CASE WHEN v < 128 THEN v ELSE shiftleft(shiftright(v, {bits} - 7), {bits} - 7) END")
    pairs = ", ".join(f"'{r}', {r}" for r in RATES)
    return counts.select(*by, F.expr(f"stack({len(RATES)}, {pairs}) AS (rate, v)")).groupBy(*by, "rate", bin_.alias("bin")).agg(F.count("*").alias("n"))


def _quantiles(sk: DataFrame, by: tuple[str, ...], suffix: str) -> DataFrame:
    """n, and the quantiles lo (at 100 less the rate's level), mid and hi of each group and rate, from its bins (a few
    hundred a group)."""
    w = Window.partitionBy(*by, "rate")
    c = sk.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    level = F.create_map(*[F.lit(x) for r, (p, _) in RATES.items() for x in (r, p)])[F.col("rate")]
    at = lambda q: F.min(F.when(100 * F.col("cum") >= q * F.col("total"), F.col("bin")))
    return c.groupBy(*by, "rate").agg(F.max("total").alias(f"n{suffix}"), at(100 - level).alias(f"lo{suffix}"), at(F.lit(50)).alias(f"mid{suffix}"), at(level).alias(f"hi{suffix}"))


def thresholds(counts: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """lang, source and, for each rate, <rate>_lo and <rate>_hi; sketches hold texts that pass the base rule."""
    fine = sketch(counts.where(~F.col("base_failed")), ("lang", "source"))
    lang = fine.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n"))
    whole = lang.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
    a = _quantiles(fine, ("lang", "source"), "0")
    b = _quantiles(lang, ("lang",), "1").withColumnsRenamed({"lang": "_l", "rate": "_r"})
    c = _quantiles(whole, (), "2").withColumnRenamed("rate", "_r2")
    j = a.join(b, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rate") == F.col("_r"))).join(c, F.col("rate") == F.col("_r2"))
    pick = lambda q: F.when(F.col("n0") >= least, F.col(f"{q}0")).when(F.col("n1") >= least, F.col(f"{q}1")).otherwise(F.col(f"{q}2"))
    j = j.select("lang", "source", "rate", *[pick(q).alias(q) for q in ("lo", "mid", "hi")])
    out = []
    for r, (_, low) in RATES.items():
        is_r = F.col("rate") == r
        out.append(F.max(F.when(is_r, F.col("hi") + reach * F.greatest(F.col("hi") - F.col("mid"), F.lit(1)))).alias(f"{r}_hi"))
        if low:
            out.append(F.max(F.when(is_r, F.col("lo") - reach * F.greatest(F.col("mid") - F.col("lo"), F.lit(1)))).alias(f"{r}_lo"))
    return j.groupBy("lang", "source").agg(*out)


def judge(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts and ``kept``: joined with its group's thresholds; a group with none keeps what passes the base rule."""
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = counts.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    bad: Column = F.col("base_failed")
    for r, (_, low) in RATES.items():
        bad = bad | F.coalesce(F.col(r) > F.col(f"{r}_hi"), F.lit(False))
        if low:
            bad = bad | F.coalesce(F.col(r) < F.col(f"{r}_lo"), F.lit(False))
    return j.withColumn("kept", ~bad).drop("_lang", "_source")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    counts = document_counts(read(spark, sf_dir, "documents"))
    out = judge(counts, thresholds(counts))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bin(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN {v} ELSE ({v} >> (length(bin({v})) - 7)) << (length(bin({v})) - 7) END"


def op8_sql() -> str:
    rates = {"symbol_rate": "1000 * n_symbols // greatest(word_chars, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_len": "10 * word_chars // greatest(n_words, 1)"}
    union = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {_bin(r)} AS bin FROM m WHERE NOT base_failed" for r in RATES)
    level = "CASE rate " + " ".join(f"WHEN '{r}' THEN {p}" for r, (p, _) in RATES.items()) + " END"

    def q(by, name):
        by = f"{by}, " if by else ""
        at = lambda p: f"min(bin) FILTER (100 * cum >= ({p}) * total)"
        return f"SELECT {by}rate, max(total) AS n, {at(f'100 - {level}')} AS lo, {at('50')} AS mid, {at(level)} AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY {by}rate ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {by}rate) AS total FROM {name}) GROUP BY {by}rate"

    lim = ", ".join(f"max(CASE WHEN rate = '{r}' THEN hi + {REACH} * greatest(hi - mid, 1) END) AS {r}_hi, max(CASE WHEN rate = '{r}' THEN lo - {REACH} * greatest(mid - lo, 1) END) AS {r}_lo" for r in RATES)
    pick = ", ".join(f"CASE WHEN q0.n >= {LEAST} THEN q0.{x} WHEN q1.n >= {LEAST} THEN q1.{x} ELSE q2.{x} END AS {x}" for x in ("lo", "mid", "hi"))
    bad = " OR ".join([f"coalesce({r} > {r}_hi, false)" for r in RATES] + [f"coalesce({r} < {r}_lo, false)" for r, (_, low) in RATES.items() if low])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY rid),
k AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, {", ".join(f"{e} AS {r}" for r, e in rates.items())}, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM k),
s0 AS (SELECT lang, source, rate, bin, count(*) AS n FROM ({union}) GROUP BY ALL),
s1 AS (SELECT lang, rate, bin, sum(n) AS n FROM s0 GROUP BY ALL), s2 AS (SELECT rate, bin, sum(n) AS n FROM s1 GROUP BY ALL),
q0 AS ({q("lang, source", "s0")}), q1 AS ({q("lang", "s1")}), q2 AS ({q("", "s2")}),
p AS (SELECT q0.lang, q0.source, q0.rate, {pick}
 FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.rate = q1.rate JOIN q2 ON q0.rate = q2.rate),
lim AS (SELECT lang, source, {lim} FROM p GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {bad}) AS kept
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source"""
