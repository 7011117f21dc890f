"""Features against an independent formula in exact and double arithmetic, rounding and parsing."""

import datetime as dt
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from tarnspark import schema as S
from tarnspark.functions import scalars, vectors
from tarnspark.operators.requests import parsed, request_features
from tarnspark.sources import synthetic


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def r4(x):
    return f32(math.trunc(x * 10000.0 + 0.5) * (1 / 10000.0))


def expected(body):
    """The model's features from a request, in plain Python."""
    q = json.loads(body)
    clamp = lambda x: r4(min(1.0, max(0.0, x)))
    at = dt.datetime.strptime(q["transaction"]["requested_at"], "%Y-%m-%dT%H:%M:%SZ")
    minute = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=1)
    amount, average, last = q["transaction"]["amount"], q["customer"]["avg_amount"], q["last_transaction"]
    out = [clamp(amount * (1 / 10000)), clamp(q["transaction"]["installments"] * (1 / 12)), clamp(amount * (1 / 10) / average if average > 0 else 0.0), r4(at.hour * (1 / 23)), r4(at.weekday() * (1 / 6))]
    if last is None:
        out += [-1.0, -1.0]
    else:
        out += [clamp((minute(at) - minute(dt.datetime.strptime(last["timestamp"], "%Y-%m-%dT%H:%M:%SZ"))) * (1 / 1440)), clamp(last["km_from_current"] * (1 / 1000))]
    t, m = q["terminal"], q["merchant"]
    return [*out, clamp(t["km_from_home"] * (1 / 1000)), clamp(q["customer"]["tx_count_24h"] * (1 / 20)), float(t["is_online"]), float(t["card_present"]), float(m["id"] not in q["customer"]["known_merchants"]), r4(S.MCC_RISK.get(m["mcc"], 0.5)), clamp(m["avg_amount"] * (1 / 10000))]


def request(**changes):
    q = {
        "id": "tx-1", "transaction": {"amount": 123.45, "installments": 3, "requested_at": "2027-02-28T23:59:59Z"},
        "customer": {"avg_amount": 100.0, "tx_count_24h": 2, "known_merchants": ["MERC-001", "MERC-002"]}, "merchant": {"id": "MERC-002", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 12.5}, "last_transaction": {"timestamp": "2027-02-28T23:58:00Z", "km_from_current": 3.3},
    }
    for path, value in changes.items():
        at = q
        *head, leaf = path.split("__")
        for k in head:
            at = at[k]
        at[leaf] = value
    return json.dumps(q)


def scored(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    return [list(r)[1:] for r in parsed(df).filter("ok").select("id", *request_features()).orderBy("id").collect()]


def test_features_of_edge_requests(spark):
    bodies = [
        request(), request(last_transaction=None), request(customer__known_merchants=[]), request(merchant__mcc="0001"), request(customer__avg_amount=0.0), request(transaction__amount=25_000.0),
        request(last_transaction__timestamp="2027-03-01T08:00:00Z"), request(transaction__amount=1234.50), request(transaction__amount=0.5), request(terminal__km_from_home=4000.0),
        request(transaction__requested_at="2028-02-29T00:00:00Z", last_transaction__timestamp="2028-02-28T23:59:59Z"), request(transaction__requested_at="2026-03-01T12:00:00Z", last_transaction__timestamp="2016-03-01T12:00:00Z"),
        request(customer__tx_count_24h=400, transaction__installments=12, merchant__avg_amount=9999.999),
    ]
    assert scored(spark, bodies) == [expected(b) for b in bodies]


def test_features_of_synthetic_requests(spark):
    bodies = [r["body"] for r in synthetic.requests(spark, 300).orderBy("id").collect()]
    assert scored(spark, bodies) == [expected(b) for b in bodies]
    assert sum(json.loads(b)["last_transaction"] is None for b in bodies) in range(30, 95)
    assert bodies == [r["body"] for r in synthetic.requests(spark, 300).repartition(3).orderBy("id").collect()]


def test_profiles(spark):
    shares = {r["profile"]: r["count"] for r in synthetic.requests(spark, 4000).groupBy("profile").count().collect()}
    assert abs(shares["legit"] - 2120) < 150 and abs(shares["fraud"] - 1692) < 150 and abs(shares["borderline"] - 188) < 60


def test_unscorable_requests(spark):
    bad = ["", "{", "null", "[]", request()[:90], request().replace('"customer"', '"consumer"'), request() + " " * 5000, request(transaction__requested_at="yesterday"), request(terminal__is_online="maybe"), request(transaction__installments=3.7), request(last_transaction__km_from_current=None), None]
    df = spark.createDataFrame(list(enumerate([*bad, request()])), "id long, body string")
    got = {r["id"]: r["ok"] for r in parsed(df).select("id", "ok").collect()}
    assert got == {**dict.fromkeys(range(len(bad)), False), len(bad): True}


def test_fields_in_any_order_and_unknown_ones(spark):
    q = json.loads(request())
    other = json.dumps({"extra": {"deep": [1, {"x": None}]}, **dict(reversed(q.items()))})
    assert scored(spark, [other]) == [expected(request())]


def test_rounding_of_every_amount_step(spark):
    cents = spark.range(0, 1_000_001, 37).select((F.col("id") / 100.0).alias("x"))
    got = cents.select("x", scalars.clamped(F.col("x"), S.MAX_AMOUNT).alias("y")).collect()
    assert all(r["y"] == r4(min(1.0, r["x"] * (1 / 10000))) for r in got)


def test_scalars(spark):
    row = spark.sql("SELECT array('a', null) AS known, 'b' AS m, 'a' AS a, CAST(null AS array<string>) AS none, array(1.0D, 2.0D) AS v, 1.005D AS x, CAST(88172645463325252 AS bigint) AS s").select(
        scalars.unknown_merchant(F.col("known"), F.col("m")).alias("u1"), scalars.unknown_merchant(F.col("known"), F.col("a")).alias("u2"), scalars.unknown_merchant(F.col("none"), F.col("a")).alias("u3"),
        scalars.padded(F.col("v"), 4).alias("p"), scalars.round2(F.col("x")).alias("r"), scalars.merchant_id(F.lit(7)).alias("id"), scalars.mcc_risk(F.lit("7995")).alias("k"), scalars.mcc_risk(F.lit(None).cast("string")).alias("k0"),
        scalars.xorshift64(F.col("s")).alias("xs"), scalars.parsed_time(F.lit("2027-13-01T00:00:00Z")).alias("t"), scalars.epoch_minute(F.to_timestamp(F.lit("1970-01-01 00:01:59"))).alias("em"), scalars.epoch_minute(F.to_timestamp(F.lit("1969-12-31 23:59:59"))).alias("en"),
    ).first()
    assert (row["u1"], row["u2"], row["u3"]) == (True, False, True) and row["p"] == [1.0, 2.0, 0.0, 0.0] and row["r"] == 1.0 and row["id"] == "MERC-007"
    assert (row["k"], row["k0"], row["t"], row["em"], row["en"]) == (0.85, 0.5, None, 1, -1)
    x = 88172645463325252
    x ^= x << 13 & (2**64 - 1)
    x ^= x >> 7
    x ^= x << 17 & (2**64 - 1)
    assert row["xs"] % 2**64 == x


@pytest.mark.parametrize("value,want", [(-1.0, -10000), (0.12345, 1235), (1.0, 10000), (0.0, 0), (3.0, 10000), (-5.0, -10000)])
def test_quantisation(spark, value, want):
    q = spark.range(1).select(vectors.quantised(F.lit(value)).alias("q")).first()["q"]
    assert q == want
    if abs(value) <= 1:
        back = spark.range(1).select(vectors.quantised(vectors.dequantised(F.lit(q))).alias("b")).first()["b"]
        assert back == q


def test_distance_kernels_agree(spark):
    df = spark.createDataFrame([([1, -10000, 3], [10000, 10000, 0]), ([5, 5, 5], [5, 5, 5])], "a array<int>, b array<int>")
    wide = vectors.squared_l2_wide([F.col("a")[k] for k in range(3)], [F.col("b")[k] for k in range(3)])
    rows = df.select(wide.alias("w"), vectors.squared_l2_array(F.col("a"), F.col("b")).alias("x"), vectors.box_bound(F.col("a"), F.array(*[F.lit(0)] * 3), F.array(*[F.lit(2)] * 3)).alias("lb")).collect()
    assert [(r["w"], r["x"], r["lb"]) for r in rows] == [(9999**2 + 20000**2 + 9, 9999**2 + 20000**2 + 9, 10000**2 + 1), (0, 0, 27)]


def test_quantised_features_are_those_of_the_floats(spark):
    """Without a way through floats, on every step of the grid and its edges, for nulls, NaN and values out of range."""
    odd = [None, float("nan"), float("inf"), -float("inf"), -5.0, 0.0, 1e300]
    rows = [((k + o) * 1e-4 * 10_000, (k + o) / 100.0 if k % 3 else 0.0, k % 24, k % 7, k % 5, k % 11) for k in range(10_001) for o in (0.0, 0.5, -0.5)]
    rows += [(x, y, 3, 4, k % 5, 2) for k, x in enumerate(odd) for y in odd]
    df = spark.createDataFrame(rows, "a double, b double, h int, w int, n int, m int")
    last, mcc = F.when(F.col("n") > 0, F.col("h") * 700), F.element_at(F.array(*[F.lit(m) for m in S.MCC_RISK], F.lit("9999")), F.col("m") + 1)
    inputs = [F.col("a"), F.col("n"), F.col("b"), F.col("h"), F.col("w"), F.lit(9000), last, F.col("b"), F.col("b") * 7, F.col("h"), F.col("n") == 1, F.col("n") == 2, F.col("n") == 3, mcc, F.col("a") * 3]
    floats = df.select(*vectors.features(*inputs), *vectors.quantised_features(*inputs))
    same = floats.select(*[vectors.quantised(F.col(f"f{k}")).eqNullSafe(F.col(f"q{k}")).alias(f"s{k}") for k in range(S.DIMS)])
    assert same.filter(" AND ".join(f"s{k}" for k in range(S.DIMS))).count() == len(rows)


def test_the_vectoriser_is_compiled(spark, tmp_path):
    """The JVM leaves generated methods of 8000 bytes and more to its interpreter."""
    import re

    from tarnspark.sources import transactions as TX

    kinds = "tx_id long, is_fraud boolean, amount double, installments int, customer_average double, hour int, weekday int, minute long, last_minute long, last_km double, km_from_home double, tx_count_24h int, is_online boolean, card_present boolean, unknown_merchant boolean, mcc string, merchant_average double"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/t")
    plan = TX.vectors(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan()
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
