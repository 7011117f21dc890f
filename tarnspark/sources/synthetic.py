"""Synthetic requests: a mixture of three profiles, drawn from hashes of the row number, so every run and every
partitioning gives the same rows without a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions.scalars import formatted_time, merchant_id, round2, uniform
from tarnspark.schema import MCC_RISK, SCALE
from tarnspark.storage import numbered

# Fixed values of the generator: shares and, per profile (legit, fraud, borderline), ranges.
LEGIT_SHARE = 0.53
FRAUD_SHARE = 0.423
NULL_LAST = 0.20
SECONDS_BACK = 10 * 365 * 24 * 3600
LEGIT_MCC = ("5411", "5812", "5912", "5311")
FRAUD_MCC = ("7995", "7801", "7802")
ALL_MCC = tuple(MCC_RISK)
AMOUNT = ((10, 500), (2000, 10000), (400, 3000))
INSTALLMENTS = ((1, 4), (6, 13), (3, 8))
HOUR = ((8, 21), (0, 7), (6, 23))
CUSTOMER_AVERAGE = (None, (50, 300), (100, 500))
TX_COUNT = ((1, 6), (8, 21), (4, 12))
MERCHANT_AVERAGE = ((30, 500), (20, 100), (50, 300))
ONLINE = (0.3, 0.8, 0.5)
KM_HOME = ((0, 50), (200, 1000), (30, 400))
KM_LAST = ((0, 20), (200, 1000), (20, 300))


def profile(u: Column) -> Column:
    return F.when(u < LEGIT_SHARE, "legit").when(u < LEGIT_SHARE + FRAUD_SHARE, "fraud").otherwise("borderline")


def _by_profile(legit: Column, fraud: Column, borderline: Column) -> Column:
    return F.when(F.col("profile") == "legit", legit).when(F.col("profile") == "fraud", fraud).otherwise(borderline)


def requests(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, profile, body): n rendered requests."""
    if n <= 0:
        raise ValueError("n must be positive")
    draw = lambda salt: uniform(F.col("id"), f"{seed}-{salt}")
    real = lambda salt, lo, hi: F.lit(float(lo)) + draw(salt) * float(hi - lo)
    whole = lambda salt, lo, hi: F.lit(lo) + F.floor(draw(salt) * (hi - lo)).cast("int")
    spread = lambda f, salt, table: _by_profile(*[f(salt, *t) for t in table])
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), whole(salt, 1, len(values) + 1))
    d = spark.range(n).withColumn("profile", profile(draw("profile")))
    d = d.withColumn("amount", round2(spread(real, "amount", AMOUNT))).withColumn("known_n", whole("known", 2, 6))
    year = whole("year", 2026, 2031)
    month = F.when(year == 2026, whole("month", 3, 13)).otherwise(whole("month", 1, 13))
    d = d.withColumn("at", F.make_timestamp(year, month, whole("day", 1, 29), spread(whole, "hour", HOUR), whole("minute", 0, 60), whole("second", 0, 60).cast("decimal(8,6)")))
    d = d.withColumn("known", F.slice(F.array(*[merchant_id(whole(f"known{k}", 1, 20)) for k in range(5)]), F.lit(1), F.col("known_n")))
    own = F.element_at("known", F.floor(draw("own") * F.col("known_n")).cast("int") + 1)
    d = d.withColumn("online", draw("online") < _by_profile(*map(F.lit, ONLINE)))
    body = F.struct(
        F.format_string("tx-%d", F.lit(1_000_000_000) + F.floor(draw("id") * (2**31 - 1)).cast("long")).alias("id"),
        F.struct("amount", spread(whole, "installments", INSTALLMENTS).alias("installments"), formatted_time(F.col("at")).alias("requested_at")).alias("transaction"),
        F.struct(round2(_by_profile(F.col("amount") * 2.0, real("average", *CUSTOMER_AVERAGE[1]), real("average", *CUSTOMER_AVERAGE[2]))).alias("avg_amount"), spread(whole, "count", TX_COUNT).alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(
            _by_profile(own, merchant_id(whole("merchant", 50, 100)), F.when(draw("known?") < 0.5, own).otherwise(merchant_id(whole("merchant", 30, 60)))).alias("id"),
            _by_profile(pick("mcc", LEGIT_MCC), pick("mcc", FRAUD_MCC), pick("mcc", ALL_MCC)).alias("mcc"), round2(spread(real, "merchant_average", MERCHANT_AVERAGE)).alias("avg_amount"),
        ).alias("merchant"),
        F.struct(F.col("online").alias("is_online"), (~F.col("online") & (draw("card") < 0.9)).alias("card_present"), spread(real, "home", KM_HOME).alias("km_from_home")).alias("terminal"),
        F.when(draw("last") >= NULL_LAST, F.struct(formatted_time(F.timestamp_seconds(F.unix_timestamp("at") - 60 - F.floor(draw("back") * SECONDS_BACK))).alias("timestamp"), spread(real, "current", KM_LAST).alias("km_from_current"))).alias("last_transaction"),
    )
    return d.select("id", "profile", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def perturbed_queries(references: DataFrame, n: int, seed: int = 42, far_every: int = 16) -> DataFrame:
    """(id, vec): reference vectors moved by small steps, every far_every-th one uniform instead."""
    rows, total = numbered(references.select("ref_id", "vec"), "ref_id", "_pick")
    q = references.sparkSession.range(n).withColumn("_pick", F.floor(uniform(F.col("id"), f"{seed}-pick") * total).cast("long"))
    step = lambda x, k: x + F.floor((uniform(F.concat_ws("-", "id", k.cast("string")), f"{seed}-step") * 256 - 128) * 0.0002 * SCALE).cast("int")
    far = lambda x, k: F.floor(uniform(F.concat_ws("-", "id", k.cast("string")), f"{seed}-far") * SCALE).cast("int")
    return q.join(rows, "_pick").select("id", F.when(F.col("id") % far_every == 0, F.transform("vec", far)).otherwise(F.transform("vec", step)).alias("vec"))
