"""Scalar column helpers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_HEX_DIGITS = 12


def at(as_of: str | date | datetime | Column) -> Column:
    """``as_of`` as a zone-free timestamp literal.

    Zone-free on purpose: compared with a zone-free column it needs no cast, and
    compared with a zoned column the literal is the side that is cast, so the
    filter still reaches the Parquet scan.
    """
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def ago(as_of: str | date | datetime | Column, span: str) -> Column:
    """``as_of`` minus a labelled duration such as ``"1 month"`` or ``"60 minutes"``."""
    return at(as_of) - F.expr(f"INTERVAL {span}")


def div(numerator: Column, divisor: Column) -> Column:
    """Integer quotient cut toward zero; null when the divisor is 0."""
    return F.call_function("div", numerator, F.nullif(divisor, F.lit(0)))


def trunc_decimal(value: Column, precision: int, scale: int) -> Column:
    """Decimal with surplus digits cut off, where a plain cast would round."""
    cut = F.when(value >= 0, F.floor(value, scale)).otherwise(F.ceil(value, scale))
    return cut.cast(f"decimal({precision},{scale})")


def ratio_cut(numerator: Column, divisor: Column, precision: int, scale: int) -> Column:
    """numerator / divisor of whole numbers, cut to ``scale`` digits without rounding."""
    scaled = numerator.cast("decimal(25,0)") * F.lit(10**scale).cast("decimal(13,0)")
    units = div(scaled, divisor.cast("decimal(25,0)"))
    return from_units(units, precision, scale)


def from_units(units: Column, precision: int, scale: int) -> Column:
    """Whole number of 10^-scale units as a decimal; exact, no division."""
    unit = F.lit(f"{10**-scale:.{scale}f}").cast(f"decimal({scale + 1},{scale})")
    return (units.cast("decimal(19,0)") * unit).cast(f"decimal({precision},{scale})")


def exact_avg(value: Column, digits: int, precision: int = 18) -> Column:
    """Average rounded half up, summed as decimal so that row order cannot change it."""
    return F.round(F.avg(value.cast("decimal(24,6)")), digits).cast(f"decimal({precision},{digits})")


def clock_label(stamp: Column) -> Column:
    """``H:MM``: the hour as is, the minute padded to two digits."""
    return F.concat(
        F.hour(stamp).cast("string"),
        F.lit(":"),
        F.lpad(F.minute(stamp).cast("string"), 2, "0"),
    )


def time_of_day(stamp: Column) -> Column:
    """``HH:MM:SS``, from the fields so that no time zone comes into it."""
    fields = [F.lpad(part(stamp).cast("string"), 2, "0") for part in (F.hour, F.minute, F.second)]
    return F.concat(fields[0], F.lit(":"), fields[1], F.lit(":"), fields[2])


def whole_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two times, again without a time zone: a clock change
    in the session's zone does not count."""
    return div(_micros(end) - _micros(start), F.lit(60_000_000))


def _micros(stamp: Column) -> Column:
    minutes = (F.unix_date(F.to_date(stamp)) * F.lit(24) + F.hour(stamp)).cast("bigint") * 60 + F.minute(stamp)
    seconds = F.extract(F.lit("SECOND"), stamp)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def parse_stamp12(text: Column) -> Column:
    """``yyMMddHHmmss`` text as a timestamp."""
    return F.to_timestamp_ntz(text, F.lit("yyMMddHHmmss"))


def job_id(number: Column, user: Column, name: Column) -> Column:
    """``number/user/name``; null when any part is null."""
    return F.concat(F.trim(number), F.lit("/"), F.trim(user), F.lit("/"), F.trim(name))


def draw(key: Column, seed: int | str, bound: int) -> Column:
    """Repeatable pseudo-random whole number in [0, bound) from a row key.

    A digest of key and seed, so a retried task draws the same values again.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, DRAW_HEX_DIGITS), 16, 10).cast("bigint") % F.lit(bound)


def spell_digits(number: Column, alphabet: str) -> Column:
    """Decimal digits of a number spelled with ten letters (for 1..9, then 0)."""
    return F.translate(number.cast("string"), "1234567890", alphabet)
