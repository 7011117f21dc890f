"""Scalar building blocks, all JVM-side. Scaling multiplies by a reciprocal and rounding truncates after adding one half:
dividing, or F.round, would change features in the last place and with them neighbours at rank k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnspark.schema import DEFAULT_RISK, MCC_RISK, SCALE


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def grid_step(x: Column) -> Column:
    """The step of the four-decimal grid that round4 rounds to."""
    return (x * F.lit(float(SCALE)) + F.lit(0.5)).cast("bigint")


def round4(x: Column) -> Column:
    return (grid_step(x) * F.lit(1.0 / SCALE)).cast("float")


def scaled(x: Column, maximum: float) -> Column:
    return x.cast("double") * F.lit(1.0 / maximum)


def clamped(x: Column, maximum: float) -> Column:
    return round4(clamp01(scaled(x, maximum)))


def guarded_ratio(amount: Column, average: Column, maximum: float) -> Column:
    return F.when(average > 0, scaled(amount, maximum) / average).otherwise(F.lit(0.0))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def epoch_minute(ts: Column) -> Column:
    """Minutes since the epoch; seconds are cut off before any subtraction."""
    return F.floor(F.unix_timestamp(ts) / 60).cast("long")


def parsed_time(text: Column) -> Column:
    """ISO-8601 UTC text of second precision; null if malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def formatted_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MCC_RISK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(DEFAULT_RISK))


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """A null list, or one without a match (nulls in it notwithstanding), makes the merchant unknown."""
    return ~F.coalesce(F.array_contains(known, merchant), F.lit(False))


def merchant_id(n: Column) -> Column:
    return F.format_string("MERC-%03d", n)


def padded(vector: Column, dims: int) -> Column:
    """The first dims elements, zeros where there are fewer."""
    head = F.slice(vector, 1, dims)
    return F.concat(head, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dims - F.size(head))))


def uniform(key: Column, salt: str) -> Column:
    """Uniform in [0, 1) from a key, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def xorshift64(x: Column) -> Column:
    """One step of the 13, 7, 17 generator on a long."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))
