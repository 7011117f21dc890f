"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose share (of symbols, capitals, repeated words, echoed words, repeated lines) exceeds a
cut-off. For each stratum (language) and rule the cut-offs of LEVELS are tried from the loosest to the strictest on
labelled holdouts, the good documents that pass the base rules: a cut-off is certified if the exact binomial tail shows
that it falsely rejects at most RISK / rules of the stratum's good documents. Trying them in a fixed order and stopping
at the first failure needs no correction within a rule; ERROR is divided by strata times rules (Bonferroni). So with
probability 1 - ERROR at once in all strata at most RISK of good documents are rejected. Of the certified cut-offs the one
that catches most low-quality documents, net of PENALTY times the good ones it costs, is used (the loosest of equals); a
stratum without enough labels gets none and keeps what passes the base rules.

Only counts leave the executors: per stratum, rule and level. Metrics are integers and compared as such.

Defined results: a null text has no words, so it fails the base; null language is a stratum of its own; labels of rows
that are absent, null or neither 0 nor 1 are not used; a document labelled several times counts once per label; repeated
rows are judged alike; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import bounded_batches, stored, text_or_empty
from tarnspark.llm.folds import held_out

RISK, ERROR, PENALTY = 0.05, 0.05, 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Cut-offs in percent, from the loosest to the strictest.
LEVELS = {
    "symbols": (60, 45, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4),
    "capitals": (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15),
    "repeats": (48, 45, 42, 38, 34, 30, 26, 22, 18, 14, 10, 7),
    "echoes": (60, 50, 40, 35, 30, 25, 20, 15, 12, 10, 7, 5),
    "lines": (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15),
}
#: Of each rule the counted and the whole.
PARTS = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "echoes": ("n_echo_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
#: Strata up to which their cut-offs (some 100 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_STRATA = 100_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_echo_words", "n_lines")

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")


def metrics_of(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    again = {w for w, n in Counter(windows).items() if n > 1}
    repeated, until = 0, 0  # words before until are counted
    if again:
        for k, w in enumerate(windows):
            if w in again:
                repeated += k + 3 - max(k, until)
                until = k + 3
    return (
        len(words), len(text) - len(_SPACE.findall(text)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(_CAPITAL.findall(text)), sum(map(str.__eq__, words, words[1:])), len(lines),
    )


def _metric_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [metrics_of(t) for t in b.column(2).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(METRICS)
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "stratum", *METRICS])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, metrics, base_failed) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), text_or_empty().alias("text"))
    rows = rows.mapInArrow(_metric_rows, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in METRICS))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _over(rule: str, percent: int | Column) -> Column:
    part, whole = PARTS[rule]
    return 100 * F.col(part) > (F.lit(percent) if isinstance(percent, int) else percent) * F.col(whole)


def tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of n trials with chance p."""
    if x >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(x + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(v - top) for v in log))


def least_trials(p: float, error: float) -> int:
    """Fewest holdouts that can certify anything."""
    return math.ceil(math.log(error) / math.log1p(-p))


def chosen(good: list[int], bad: list[int], n_good: int, n_bad: int, error: float) -> int | None:
    """Index of the cut-off for one rule in one stratum; good[k], bad[k]: rejected at level k. The tail is not summed
    where more than RISK / rules of the holdouts are rejected: it cannot be below one half there."""
    p, best, at = RISK / len(LEVELS), 0, None
    for k, (g, b) in enumerate(zip(good, bad, strict=True)):
        if g > p * n_good or tail(g, n_good, p) > error:
            break
        gain = b * n_good - PENALTY * g * n_bad
        if gain > best:
            best, at = gain, k
    return at


def thresholds(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """measured() rows and (doc_id, quality) -> one row a stratum: its cut-offs in percent, null where a rule is unused."""
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    marked = rows.filter(~F.col("base_failed")).join(usable, "doc_id")
    one = lambda q, c: F.count_if((F.col("quality") == q) & c).alias
    counts = [one(q, _over(r, p))(f"{r}_{q}_{k}") for r, levels in LEVELS.items() for q in (0, 1) for k, p in enumerate(levels)]
    counts = marked.groupBy("stratum").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), *counts)
    counts = stored(counts, "rule-counts")
    error = ERROR / (max(1, counts.count()) * len(LEVELS))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {"stratum": f["stratum"]}
            for r, levels in LEVELS.items():
                picks = []
                for row in f.to_dict("records"):
                    k = chosen([row[f"{r}_1_{k}"] for k in range(len(levels))], [row[f"{r}_0_{k}"] for k in range(len(levels))], row["good"], row["bad"], error)
                    picks.append(None if k is None else levels[k])
                out[r] = pd.array(picks, "Int64")
            yield pd.DataFrame(out)

    return counts.mapInPandas(choose, "stratum string, " + ", ".join(f"{r} long" for r in LEVELS))


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured() rows with kept, and reasons: the rules that reject it."""
    cuts = stored(cuts.withColumnRenamed("stratum", "_stratum"), "rule-cuts")
    few = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = rows.join(F.broadcast(cuts) if few else cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    reasons = F.filter(F.array(F.when(F.col("base_failed"), F.lit("base")), *[F.when(_over(r, F.col(r)), F.lit(r)) for r in LEVELS]), lambda x: x.isNotNull())
    return joined.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0).drop("_stratum", *LEVELS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "metrics")
    out = judged(rows, thresholds(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The fold needs crc32, which the SQL engine lacks: it is unrolled over the bits of a row's digits."""
    p = RISK / len(LEVELS)
    levels = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS k, {v}::BIGINT AS pct" for r, ls in LEVELS.items() for k, v in enumerate(ls))
    share = " ".join(f"WHEN '{r}' THEN 100 * {a} > pct * {b}" for r, (a, b) in PARTS.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
v AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM u) WHERE n > 1),
x AS (SELECT rid, count(DISTINCT i + j)::BIGINT AS n FROM v, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
e AS (SELECT rid, count(*) FILTER (a = b)::BIGINT AS n FROM (SELECT rid, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM t) GROUP BY rid),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(x.n, 0)::BIGINT AS n_repeat_words, coalesce(e.n, 0)::BIGINT AS n_echo_words,
             len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]'))::BIGINT AS n_capitals
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t) s
      LEFT JOIN x USING (rid) LEFT JOIN e USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
z AS (SELECT i::BIGINT AS i, {_crc_step()} AS c FROM range(256) r(i)),
q AS (SELECT list(c ORDER BY i) AS tab FROM z),
f AS (SELECT doc_id, quality FROM labels, q
      WHERE quality IN (0, 1) AND doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, s: xor(tab[(xor(a, s) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 5 <> 0),
h AS (SELECT b.*, quality FROM b JOIN f USING (doc_id) WHERE NOT base_failed),
levels AS ({levels}),
c AS (SELECT lang, rule, k, pct, sum((quality = 1)::INT)::BIGINT AS n1, sum((quality = 0)::INT)::BIGINT AS n0,
             sum((quality = 1 AND o)::INT)::BIGINT AS g, sum((quality = 0 AND o)::INT)::BIGINT AS d
      FROM (SELECT *, CASE rule {share} END AS o FROM h, levels) GROUP BY lang, rule, k, pct),
p AS (SELECT *, g <= {p!r}::DOUBLE * n1 AND (g >= n1) = false AND
             list_sum(list_transform(range(0, CASE WHEN g <= {p!r}::DOUBLE * n1 THEN g + 1 ELSE 1 END), lambda i: exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1)
               + i * ln({p!r}::DOUBLE) + (n1 - i) * ln(1 - {p!r}::DOUBLE)))) <= {ERROR!r}::DOUBLE / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM h) * {len(LEVELS)}) AS ok FROM c),
s AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY k) AS certified, d * n1 - {PENALTY} * g * n0 AS gain FROM p),
a AS (SELECT lang, rule, pct FROM s WHERE certified AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, k) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM a WHERE a.lang IS NOT DISTINCT FROM b.lang AND CASE a.rule {share.replace("pct", "a.pct")} END) AS kept
FROM b
"""


def _crc_step() -> str:
    """The table entry of i, by eight shifts with the reversed polynomial."""
    c = "i"
    for _ in range(8):
        c = f"(SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM (SELECT {c} AS v))"
    return c


ORACLE = _oracle()
