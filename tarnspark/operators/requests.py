"""Parsing of request bodies by schema, with one fail-safe for whatever cannot be scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.functions.scalars import epoch_minute, parsed_time, unknown_merchant
from tarnspark.functions.vectors import features
from tarnspark.schema import MAX_REQUEST_BYTES, REQUEST

_CORRUPT = "_corrupt_record"
#: Fields without which a request has no vector.
REQUIRED = (
    "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
    "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online",
    "terminal.card_present", "terminal.km_from_home",
)


def parsed(df: DataFrame, body: str = "body", max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """df with the parsed request `j` and `ok`: false for oversize or malformed bodies, missing fields and bad times."""
    schema = T.StructType([*REQUEST.fields, T.StructField(_CORRUPT, T.StringType())])
    out = df.withColumn("j", F.from_json(F.col(body), schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    whole = F.col("j").isNotNull() & F.col(f"j.{_CORRUPT}").isNull() & (F.octet_length(body) <= max_bytes)
    for field in REQUIRED:
        whole = whole & F.col(f"j.{field}").isNotNull()
    last = F.col("j.last_transaction")
    whole = whole & parsed_time(F.col("j.transaction.requested_at")).isNotNull()
    whole = whole & (last.isNull() | (parsed_time(last["timestamp"]).isNotNull() & last["km_from_current"].isNotNull()))
    return out.withColumn("ok", F.coalesce(whole, F.lit(False)))


def request_features(j: Column | str = "j") -> list[Column]:
    """f0..f13 of a parsed request."""
    c = lambda f: F.col(f"{j}.{f}")
    at, last = parsed_time(c("transaction.requested_at")), parsed_time(c("last_transaction.timestamp"))
    return features(
        c("transaction.amount"), c("transaction.installments"), c("customer.avg_amount"), F.hour(at), F.weekday(at), epoch_minute(at),
        epoch_minute(last), c("last_transaction.km_from_current"), c("terminal.km_from_home"), c("customer.tx_count_24h"), c("terminal.is_online"),
        c("terminal.card_present"), unknown_merchant(c("customer.known_merchants"), c("merchant.id")), c("merchant.mcc"), c("merchant.avg_amount"),
    )
