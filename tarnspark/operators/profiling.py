"""Latency and work statistics: percentiles by rank without interpolation, and latency against search work.

A rank is found in two steps. Values are counted by bucket, with partial aggregation: a bucket holds the values that agree
in their sign, size and first ten bits, so a key has a bounded number of buckets whatever its rows. Only the values of the
buckets in which a wanted rank lies are then counted one by one and put in order. No group of raw rows is ever sorted in
one task. Values are whole numbers; nulls are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Bits of a value that its bucket keeps.
BITS = 10


def bucket(value: Column) -> Column:
    """The value with all but its first bits cleared: rises with it."""
    size, shifted = F.abs(value.cast("long")), lambda x, n: F.call_function("shiftright", x, n)
    guess = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")  # one off at most, as doubles round
    top = guess + (shifted(size, guess + 1) > 0).cast("int") - (shifted(size, guess) == 0).cast("int")
    drop = F.greatest(top - BITS, F.lit(0))
    return F.call_function("shiftleft", shifted(value.cast("long"), drop), drop)


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n, max_value, and for each name the element at that index (a column over n) of the ascending values, null if
    there is none, and how many values are below it (name_before)."""
    if not keys:
        one = at_ranks(rows.withColumn("_all", F.lit(0)), ["_all"], value, ranks)
        return one.agg(*[F.max(c).alias(c) for c in one.columns if c != "_all"])
    plain = [f"k{i}" for i in range(len(keys))]
    some = rows.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(p) for k, p in zip(keys, plain, strict=True)], F.col(value).alias("v")).withColumn("b", bucket(F.col("v")))
    sums = some.groupBy(*plain, "b").agg(F.count("*").alias("c"), F.max("v").alias("top"))
    part = Window.partitionBy(*plain)  # over buckets: a bounded number a key
    placed = sums.select(*plain, "b", "c", "top", (F.sum("c").over(part.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(part).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()]))
    wanted = placed.withColumn("w", each).select(*plain, "b", "before", "c", F.col("w.name").alias("name"), F.col("w.rank").alias("rank"))
    wanted = wanted.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).drop("c")
    hit = wanted.select(*[F.col(p).alias(f"w_{p}") for p in plain], F.col("b").alias("w_b"), "before", "name", "rank")
    single = some.groupBy(*plain, "b", "v").agg(F.count("*").alias("m"))
    same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"w_{p}")) for p in plain], F.col("b") == F.col("w_b"))
    inside = single.join(hit, same).withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy(*plain, "name").orderBy("v")))
    found = inside.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("m") <= F.col("rank")))
    pick = lambda n, c: F.max(F.when(F.col("name") == n, c))
    out = [x for n in ranks for x in (pick(n, F.col("v")).alias(n), pick(n, F.col("upto") - F.col("m")).alias(f"{n}_before"))]
    values = found.groupBy(*plain).agg(*out)
    totals = placed.groupBy(*plain).agg(F.max("n").alias("n"), F.max("top").alias("max_value"))
    named = values.select(*[F.col(p).alias(f"w_{p}") for p in plain], *[c for n in ranks for c in (n, f"{n}_before")])
    joined = totals.join(named, reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"w_{p}")) for p in plain]), "left")
    return joined.select(*[F.col(p).alias(k) for k, p in zip(keys, plain, strict=True)], "n", "max_value", *[c for n in ranks for c in (n, f"{n}_before")])


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, p50 ... p999, max_value: the element at index floor(n * p) of the ascending values."""
    return at_ranks(rows, keys, value, {name: F.floor(F.col("n") * F.lit(p)) for name, p in PERCENTILES.items()}).select(*keys, "n", *PERCENTILES, "max_value")


def work_percentiles(rows: DataFrame, visits: str = "visits", checks: str = "checks") -> DataFrame:
    """Percentiles of the search work, a row a `stage`: visits; and checks and their sum, if any check was counted (the
    greatest is not negative)."""
    counted = rows.agg(F.max(checks)).first()[0]
    stages = {"visits": F.col(visits)} | ({"checks": F.col(checks), "work": F.col(visits) + F.col(checks)} if counted is not None and counted >= 0 else {})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), x.cast("long").alias("x")) for n, x in stages.items()]))
    return percentiles(rows.select(each.alias("e")).select("e.*"), ["stage"], "x")


def count_windows(rows: DataFrame, seq: str, every: int, value: str) -> DataFrame:
    """Percentiles of each run of `every` consecutive sequence numbers."""
    return percentiles(rows.withColumn("window", F.floor(F.col(seq) / every)), ["window"], value)


def latency_against_work(rows: DataFrame, duration: str, work: str, tie: str, fast: float = 0.5, slow: float = 0.99) -> DataFrame:
    """One row: count, mean and upper median of work among the fastest half and the slowest hundredth. The boundary durations
    come by rank; among the rows at a boundary the tie column (whole numbers) decides, by rank again."""
    some = rows.filter(F.col(duration).isNotNull())
    edges = at_ranks(some, [], duration, {"fast": F.floor(F.col("n") * fast), "slow": F.floor(F.col("n") * slow)}).first()

    def below(name: str) -> Column:
        if edges[name] is None:
            return F.lit(True)
        at, among = edges[name], edges[f"{name}_before"]
        index = {"fast": int(edges["n"] * fast), "slow": int(edges["n"] * slow)}[name] - among
        first = at_ranks(some.filter(F.col(duration) == at), [], tie, {"tie": F.lit(index)}).first()["tie"]
        return (F.col(duration) < at) | ((F.col(duration) == at) & (F.col(tie) < first))

    sided = some.withColumn("side", F.when(below("fast"), "fast").when(~below("slow"), "slow")).filter(F.col("side").isNotNull())
    middle = at_ranks(sided, ["side"], work, {"median": F.floor(F.col("n") / 2)})
    per = sided.groupBy("side").agg(F.count("*").alias("n"), F.sum(work).alias("total")).join(middle.select(F.col("side").alias("s"), "median"), F.col("side") == F.col("s"), "left")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return per.agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("fast", "slow") for c in ("n", "total", "median")])


def payload_sizes(bodies: DataFrame, body: str = "body") -> DataFrame:
    size = F.octet_length(body)
    return bodies.agg(F.count("*").alias("n"), F.min(size).cast("long").alias("min_bytes"), F.max(size).cast("long").alias("max_bytes"), F.sum(size).cast("long").alias("total_bytes"))
