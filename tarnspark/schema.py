"""Types and fixed values of the scoring model."""

from __future__ import annotations

from pyspark.sql import types as T

DIMS = 14
SCALE = 10_000
NEIGHBOURS = 5
APPROVE_BELOW = 0.6
#: Frauds assumed for a request that cannot be scored: false approvals cost three times false denials.
FALLBACK_FRAUDS = 3
FALSE_POSITIVE_COST, FALSE_NEGATIVE_COST = 1, 3
MAX_REQUEST_BYTES = 4096

FEATURES = (
    "amount", "installments", "amount_vs_average", "hour", "weekday", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_average",
)

# Fixed values of the scoring model.
MAX_AMOUNT = 10_000.0
MAX_INSTALLMENTS = 12.0
MAX_AMOUNT_RATIO = 10.0
MAX_HOUR = 23.0
MAX_WEEKDAY = 6.0
MAX_MINUTES = 1_440.0
MAX_KM = 1_000.0
MAX_TX_COUNT = 20.0
MAX_MERCHANT_AVERAGE = 10_000.0
DEFAULT_RISK = 0.5
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}

REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("transaction", T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("installments", T.IntegerType()), T.StructField("requested_at", T.StringType())])),
    T.StructField("customer", T.StructType([T.StructField("avg_amount", T.DoubleType()), T.StructField("tx_count_24h", T.IntegerType()), T.StructField("known_merchants", T.ArrayType(T.StringType()))])),
    T.StructField("merchant", T.StructType([T.StructField("id", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("avg_amount", T.DoubleType())])),
    T.StructField("terminal", T.StructType([T.StructField("is_online", T.BooleanType()), T.StructField("card_present", T.BooleanType()), T.StructField("km_from_home", T.DoubleType())])),
    T.StructField("last_transaction", T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("km_from_current", T.DoubleType())])),
])

REFERENCE = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
