"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to token budgets, whole epochs first.

Every document draws an exponential key -ln(u) / weight (u from its doc_id, weight from its quality): the smaller the key,
the sooner it is taken, and heavier documents come sooner. A source takes floor(target / size) complete epochs and then
documents in key order until the rest of its budget is used; the document at the budget's edge is taken in part.

Keys are cut into BUCKETS by a monotone function, sums are kept per source and bucket, and only the one bucket in which a
source's budget ends is sorted: a hot source never sits in one task. What is left per source is one cut-off, joined back.
DataFrame functions only.

Defined results: a null text has size 0; null is a source of its own, last; a null doc_id draws the key of an empty
string; rows that agree in doc_id, size and key at the edge share its words equally, rounded down; sources without words
and empty tables have target 0 and take nothing, so `mixed_documents` leaves documents without words out. Extra columns
pass through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.llm.common import renamed, restored, stored

WEIGHTS = (5, 2, 1)
LIMIT = 3
BUCKETS = 1024
#: Sources up to which the table of cut-offs (under 150 bytes a source) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that count against a document's quality.
SYMBOLS = "#*$%&|<>!"


def quality(text: Column) -> Column:
    """Weight in [0.1, 1]: falls with the share of symbols."""
    text = F.coalesce(text, F.lit(""))
    share = F.when(text == "", F.lit(1.0)).otherwise(F.length(F.translate(text, SYMBOLS, "")).cast("double") / F.length(text).cast("double"))
    return F.lit(0.1) + F.lit(0.9) * share * share


def prepared(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with _size, _id, _key and _bucket."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    key = -F.log((draw.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / (quality(F.col("text")) if weight is None else weight)
    return (
        docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
        .withColumn("_key", key)
        .withColumn("_bucket", F.floor(F.lit(float(BUCKETS)) * (F.lit(1.0) - F.exp(-F.col("_key")))).cast("int"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, none above limit times its size, the excess reshared.

    Sources sorted by size over weight reach their limit first, so the limited ones are a prefix of that order: a running
    sum replaces the rounds of resharing. Works on one row a source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn % len(weights) + 1).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "source", "source_size", "w",
        F.sum("source_size").over(every).alias("all"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
    )
    s = s.withColumn("limited", (F.col("all") - limit * F.col("s0")) * F.col("w") > limit * F.col("source_size") * (F.col("all_w") - F.col("w0")))
    s = s.withColumn("used", F.coalesce(F.sum(F.when(F.col("limited"), limit * F.col("source_size"))).over(every), F.lit(0))).withColumn("used_w", F.coalesce(F.sum(F.when(F.col("limited"), F.col("w"))).over(every), F.lit(0)))
    share = F.col("w").cast("double") * ((F.col("all") - F.col("used")).cast("double") / (F.col("all_w") - F.col("used_w")).cast("double"))
    return s.select("source", "source_size", F.when(F.col("limited"), (limit * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def cut_offs(narrow: DataFrame) -> DataFrame:
    """One row a source: source_size, target, whole epochs, and the key, id and size up to which its documents are taken
    once more, with the words each document at the edge gives."""
    sums = narrow.groupBy("source", "_bucket").agg(F.sum("_size").alias("words"))
    sums = stored(sums, "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(LIMIT))).otherwise(0).cast("long")
    goal = stored(goal.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")), "mix-goals")
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plain = goal.select(F.col("source").alias("s"), "rest")
    edge = sums.join(plain, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    edge = edge.select("s", F.col("_bucket").alias("b"), "before", "rest")
    last = narrow.join(F.broadcast(edge) if _few(goal) else edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b")))
    last = last.groupBy("s", "before", "rest", "_key", "_id", "_size").agg(F.count("*").alias("equal"))
    order = Window.partitionBy("s").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("equal")).over(order), F.lit(0)))
    last = last.filter((F.col("at") < F.col("rest")) & (F.col("rest") <= F.col("at") + F.col("_size") * F.col("equal")))
    last = last.select("s", F.struct("_key", "_id", "_size").alias("cut"), F.floor((F.col("rest") - F.col("at")) / F.col("equal")).cast("long").alias("part"))
    return goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "cut", "part")


def _few(per_source: DataFrame) -> bool:
    return per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def assign(rows: DataFrame) -> DataFrame:
    """prepared() rows with source_size, target and taken; every other column as it was."""
    narrow = stored(rows.select("source", "_id", "_size", "_key", "_bucket"), "mix-keys")
    cuts = stored(cut_offs(narrow), "mix-cuts")
    place = F.struct("_key", "_id", "_size")
    more = F.when(F.col("cut").isNull() | (place > F.col("cut")), F.lit(0)).when(place < F.col("cut"), F.col("_size")).otherwise(F.col("part"))
    return (
        rows.join(F.broadcast(cuts) if _few(cuts) else cuts, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("taken", (F.col("epochs") * F.col("_size") + more).cast("long"))
        .drop("_source", "epochs", "cut", "part")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its taken words hold it, the edge document if half of it is taken;
    columns as in docs."""
    wide, own = renamed(docs)
    for c in ("doc_id", "source", "text"):
        wide = wide.withColumn(c, F.col(own[c]))
    copies = F.when(F.col("_size") > 0, F.round(F.col("taken") / F.col("_size"))).otherwise(0).cast("int")
    return restored(assign(prepared(wide)).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))), own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = stored(prepared(docs).drop("text"), "mix-rows")
    return assign(rows).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id, -9223372036854775808) AS id,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         CASE WHEN coalesce(text, '') = '' THEN 1::DOUBLE
              ELSE length(translate(text, '{SYMBOLS}', ''))::DOUBLE / length(text)::DOUBLE END AS q,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (0.1::DOUBLE + 0.9::DOUBLE * q * q) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
r AS (SELECT *, (sum(ss) OVER ())::BIGINT AS a, (sum(w) OVER ())::BIGINT AS aw,
             coalesce(sum(ss) OVER o, 0)::BIGINT AS s0, coalesce(sum(w) OVER o, 0)::BIGINT AS w0
      FROM w WINDOW o AS (ORDER BY ss::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (a - 3 * s0) * w > 3 * ss * (aw - w0) AS capped FROM r),
f AS (SELECT *, coalesce(sum(CASE WHEN capped THEN 3 * ss END) OVER (), 0)::BIGINT AS used,
             coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)::BIGINT AS used_w FROM c),
t AS (SELECT source, ss, CASE WHEN capped THEN (3 * ss)::DOUBLE
             ELSE w::DOUBLE * ((a - used)::DOUBLE / (aw - used_w)::DOUBLE) END AS target FROM f),
e AS (SELECT *, CASE WHEN ss > 0 THEN least(floor(target / ss::DOUBLE), 3)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT *, floor(target - (epochs * ss)::DOUBLE + 0.5::DOUBLE)::BIGINT AS rest FROM e),
p AS (SELECT source, key, id, size, count(*) AS equal,
             coalesce(sum(size * count(*)) OVER (PARTITION BY source ORDER BY key, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at
      FROM k GROUP BY source, key, id, size)
SELECT k.doc_id, k.size, g.ss AS source_size, g.target,
       (g.epochs * k.size + CASE WHEN p.at >= g.rest THEN 0 WHEN p.at + p.size * p.equal < g.rest THEN p.size
             ELSE least(p.size, (g.rest - p.at) // p.equal) END)::BIGINT AS taken
FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
       JOIN p ON p.source IS NOT DISTINCT FROM k.source AND p.key = k.key AND p.id = k.id AND p.size = k.size
"""
