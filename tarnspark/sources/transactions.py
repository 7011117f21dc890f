"""Transaction-shaped data derived from the order tables: the requests and labelled references of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.functions.vectors import quantised_features
from tarnspark.schema import MCC_RISK

UNLISTED_MCC = "9999"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mcc_of(part: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MCC_RISK], F.lit(UNLISTED_MCC)), (part % (len(MCC_RISK) + 1)).cast("int") + 1)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order that has lines, with a customer's and supplier's history."""
    lines = read(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("installments"), F.min("l_suppkey").alias("supp"), F.min("l_partkey").alias("part"))
    per_supplier = lines.groupBy("l_suppkey").agg(F.sum(F.floor("l_extendedprice")).alias("supp_sum"), F.count("*").alias("supp_n"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), "s_nationkey")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    t = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, "o_custkey").join(suppliers, "supp").join(per_supplier, F.col("supp") == F.col("l_suppkey"))
    key = F.col("o_orderkey")
    t = t.select(
        key.alias("tx_id"), F.col("o_custkey").alias("cust"), (F.col("o_orderstatus") == "F").alias("is_fraud"), F.floor(F.col("o_totalprice") * 2).cast("long").alias("cents"), "installments",
        F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("day"), (key % 24).cast("int").alias("hour"), ((key * 7) % 60).cast("int").alias("minute_of_hour"), ((key * 13) % 60).cast("int").alias("second"),
        F.weekday("o_orderdate").alias("weekday"), "supp", mcc_of(F.col("part")).alias("mcc"), (F.col("supp_sum").cast("double") / F.col("supp_n").cast("double") / 10.0).alias("merchant_average"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_online"), "s_nationkey", F.abs(F.col("s_nationkey") - F.col("c_nationkey")).alias("home_steps"),
    )
    t = t.withColumn("minute", F.col("day") * 1440 + F.col("hour") * 60 + F.col("minute_of_hour"))
    order = Window.partitionBy("cust").orderBy("minute", "tx_id")
    past, day = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("cust").orderBy("minute").rangeBetween(-1440, 0)
    seen = Window.partitionBy("cust", "supp").orderBy("minute", "tx_id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", F.sum("cents").over(past).alias("past_cents"), F.count("*").over(past).alias("past_n"), (F.count("*").over(day) - 1).cast("int").alias("tx_count_24h"), F.lag("minute").over(order).alias("last_minute"), F.lag("second").over(order).alias("last_second"), F.lag("s_nationkey").over(order).alias("last_nation"), F.count("*").over(seen).alias("seen"))
    return t.select(
        "tx_id", "is_fraud", (F.col("cents") / 100.0).alias("amount"), "installments", F.when(F.col("past_n") > 0, F.col("past_cents").cast("double") / 100.0 / F.col("past_n").cast("double")).otherwise(F.lit(0.0)).alias("customer_average"),
        "day", "hour", "minute_of_hour", "second", "weekday", "minute", "last_minute", "last_second", (F.abs(F.col("s_nationkey") - F.col("last_nation")) * 40).cast("double").alias("last_km"), (F.col("home_steps") * 40).cast("double").alias("km_from_home"), "tx_count_24h",
        "is_online", (~F.col("is_online") & (F.col("tx_id") % 10 != 0)).alias("card_present"), F.concat(F.lit("MERC-"), F.col("supp").cast("string")).alias("merchant_id"), (F.col("seen") == 0).alias("unknown_merchant"), "mcc", "merchant_average",
    )


_INPUTS = ("amount", "installments", "customer_average", "hour", "weekday", "minute", "last_minute", "last_km", "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc", "merchant_average")


def vectors(t: DataFrame) -> DataFrame:
    """(ref_id, vec, is_fraud) of transactions."""
    return t.select(F.col("tx_id").alias("ref_id"), F.array(*quantised_features(*[F.col(c) for c in _INPUTS])).alias("vec"), "is_fraud")


def bodies(t: DataFrame) -> DataFrame:
    """(tx_id, body): transactions rendered as request JSON."""
    at = lambda m, s: F.date_format(F.timestamp_seconds(F.col(m) * 60 + F.col(s)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(
        F.concat(F.lit("tx-"), F.col("tx_id").cast("string")).alias("id"),
        F.struct("amount", "installments", at("minute", "second").alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_average").alias("avg_amount"), "tx_count_24h", F.when(F.col("unknown_merchant"), F.array().cast("array<string>")).otherwise(F.array("merchant_id")).alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_average").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        F.when(F.col("last_minute").isNotNull(), F.struct(at("last_minute", "last_second").alias("timestamp"), F.col("last_km").alias("km_from_current"))).alias("last_transaction"),
    )
    return t.select("tx_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, vec, label) of the embedding table, quantised."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ref_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("int")).alias("vec"), "label")


def stated_queries(rows: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100, against all rows."""
    return rows.filter(F.col("ref_id") % every == 0).select(F.col("ref_id").alias("id"), "vec")
