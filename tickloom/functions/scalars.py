"""Scalar functions as Column builders. All stay inside Catalyst; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import MONEY, PRICE

# Bar resolutions (token, ISO-8601 text, seconds).
RESOLUTIONS = (
    ("1m", "PT1M", 60),
    ("5m", "PT5M", 300),
    ("15m", "PT15M", 900),
    ("30m", "PT30M", 1_800),
    ("1h", "PT1H", 3_600),
    ("4h", "PT4H", 14_400),
    ("1d", "P1D", 86_400),
)

UUID_NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def price(value: Column | str) -> Column:
    """A double price as decimal(18,8). Spark converts doubles through their shortest text form, as the prices require."""
    return _c(value).cast(PRICE)


def quantize_money(value: Column | str) -> Column:
    """HALF_EVEN to 8 places as decimal(24,8); NULL when it does not fit."""
    return F.bround(_c(value), 8).try_cast(MONEY)


def quantize_quantity(value: Column | str, fractional: Column | bool) -> Column:
    """8 places for fractional-eligible instruments, whole shares otherwise (HALF_EVEN)."""
    flag = F.lit(fractional) if isinstance(fractional, bool) else fractional
    return F.when(flag, F.bround(_c(value), 8).try_cast(PRICE)).otherwise(F.bround(_c(value), 0).try_cast(PRICE))


def apply_rate(base: Column | str, rate: Column) -> Column:
    """``base * rate`` with one rounding, on the product. ``rate`` should be decimal(9,8) or narrower."""
    return F.bround(_c(base) * rate, 8).try_cast(MONEY)


def floor_to_quantum(value: Column | str, quantum: Column) -> Column:
    """Round down to a multiple of ``quantum``; zero or less gives zero."""
    raw = F.floor(_c(value) / quantum) * quantum
    return F.greatest(raw, raw * F.lit(0)).try_cast(PRICE)


def units(value: Column) -> Column:
    """A value with at most 8 places as a whole number of 1e-8 units."""
    return (value.cast(PRICE) * F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(18,0)")


def from_units(value: Column) -> Column:
    return (value.cast("decimal(20,0)") / F.lit(100_000_000).cast("decimal(9,0)")).cast(PRICE)


def floor_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded down to 8 places, in whole-number arithmetic."""
    top = units(numerator) * F.lit(100_000_000).cast("decimal(9,0)")
    return from_units(F.call_function("div", top, units(denominator)))


def prorate(amount: Column, part: Column, whole: Column) -> Column:
    """amount * part / whole, rounded HALF_EVEN to 8 places exactly.

    Decimal division would first round to 9 places here and a second rounding would turn those into false ties.
    """
    top, bottom = units(amount) * units(part), units(whole)
    return rounded_quotient(F.call_function("div", top, bottom), top % bottom, bottom)


def rounded_quotient(quotient: Column, rest: Column, bottom: Column) -> Column:
    """The last step of ``prorate``: the whole quotient in units, rounded HALF_EVEN by what is left."""
    twice = rest * F.lit(2).cast("decimal(1,0)")
    up = (twice > bottom) | ((twice == bottom) & (quotient % 2 == 1))
    return from_units(quotient + F.when(up, 1).otherwise(0))


def format_money(value: Column | str) -> Column:
    """Fixed text with 8 places (the canonical form used inside digests)."""
    return _c(value).cast(MONEY).cast("string")


def percent(numerator: Column, denominator: Column) -> Column:
    """``numerator * 100 / denominator``; NULL for a zero denominator."""
    return F.try_divide(numerator * F.lit(100), denominator)


def plain_text(value: Column | str) -> Column:
    """Decimal text without trailing zeros."""
    text = _c(value).cast("string")
    return F.when(
        text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    ).otherwise(text)


def sha256(value: Column | str) -> Column:
    return F.sha2(_c(value).cast("binary"), 256)


def with_hash_prefix(digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest)


def strip_hash_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^sha256:", "")


def is_sha256(text: Column | str) -> Column:
    return _c(text).rlike(r"^[0-9a-f]{64}$")


def is_uuid(text: Column | str) -> Column:
    return _c(text).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def uuid5(name: Column | str, namespace: str = UUID_NAMESPACE_URL) -> Column:
    """RFC 4122 name-based UUID, version 5."""
    hexed = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), _c(name).cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws(
        "-",
        F.substring(hexed, 1, 8),
        F.substring(hexed, 9, 4),
        F.concat(F.lit("5"), F.substring(hexed, 14, 3)),
        F.concat(variant, F.substring(hexed, 18, 3)),
        F.substring(hexed, 21, 12),
    )


def canonical_json(columns: Mapping[str, Column | str]) -> Column:
    """JSON object with sorted keys and no spaces. Decimals must be passed as text: JSON writes 0E-8 for zero."""
    fields = [_c(columns[name]).alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def utc_text(ts: Column | str) -> Column:
    """ISO text with ``Z``; microseconds only when there are any."""
    stamp = _c(ts)
    whole = stamp == F.date_trunc("second", stamp)
    return F.when(whole, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def _lookup(value: Column, pairs: Sequence[tuple]) -> Column:
    return reduce(lambda acc, p: acc.when(value == F.lit(p[0]), F.lit(p[1])), pairs, F.when(F.lit(False), F.lit(None)))


def token_to_seconds(token: Column | str) -> Column:
    return _lookup(_c(token), [(t, s) for t, _, s in RESOLUTIONS])


def token_to_iso(token: Column | str) -> Column:
    return _lookup(_c(token), [(t, i) for t, i, _ in RESOLUTIONS])


def iso_to_token(text: Column | str) -> Column:
    return _lookup(_c(text), [(i, t) for t, i, _ in RESOLUTIONS])


def resolution_seconds(token: str) -> int:
    return {t: s for t, _, s in RESOLUTIONS}[token]


def plus_seconds(ts: Column | str, seconds: Column | int) -> Column:
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(_c(ts)) + amount.cast("long") * F.lit(1_000_000))


def input_fingerprint(columns: Mapping[str, Column | str]) -> Column:
    """SHA-256 over sorted ``name=value`` lines; NULL when any input is missing."""
    names = sorted(columns)
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{n}="), _c(columns[n]).cast("string")) for n in names])
    missing = reduce(lambda a, b: a | b, [_c(columns[n]).isNull() for n in names])
    return F.when(~missing, F.sha2(text.cast("binary"), 256))


def week_overlaps_month(week_start: Column, month: Column) -> Column:
    """Does the Monday week touch the ``YYYY-MM`` month?"""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return (week_start <= F.last_day(first)) & (F.date_add(week_start, 6) >= first)


def sorted_unique(array: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_c(array)))


# Comparison operators by name, always on numbers, never on text.
COMPARATORS = {
    "LT": lambda a, b: a < b,
    "LTE": lambda a, b: a <= b,
    "GT": lambda a, b: a > b,
    "GTE": lambda a, b: a >= b,
    "EQ": lambda a, b: a == b,
    "NEQ": lambda a, b: a != b,
}


def compare(operator: Column, left: Column, right: Column) -> Column:
    """Comparison whose operator is itself a column."""
    return reduce(
        lambda acc, item: acc.when(operator == F.lit(item[0]), item[1](left, right)),
        COMPARATORS.items(),
        F.when(F.lit(False), F.lit(None).cast("boolean")),
    )
