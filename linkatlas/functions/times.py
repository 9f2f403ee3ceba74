"""Time expressions. Micros since 1970 are taken without a zone, so the session zone never matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds from 1601-01-01 to 1970-01-01; first and last microsecond of years 1 to 9999 since 1970.
EPOCH_1601_GAP = 11_644_473_600_000_000
FIRST_MICRO = -62_135_596_800_000_000
LAST_MICRO = 253_402_300_799_999_999
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def from_1601(text: Column) -> Column:
    """Decimal text of microseconds since 1601 as a timestamp; anything else, or a year outside 1 to 9999, is NULL."""
    micros = text.cast("string").try_cast("bigint")
    known = micros.between(FIRST_MICRO + EPOCH_1601_GAP, LAST_MICRO + EPOCH_1601_GAP)
    return F.when(known, F.timestamp_micros(micros - F.lit(EPOCH_1601_GAP)))


def from_1601_legacy(text: Column) -> Column:
    """The wrong offset and divisor some ledgers were written with, a hundred thousand units a second; for reading those only."""
    units, gap = text.cast("string").try_cast("bigint"), 1_164_447_360_000
    known = units.between(gap - 62_135_596_800 * 100_000, gap + 253_402_300_799 * 100_000)
    return F.when(known, F.timestamp_micros((units - gap) * 10))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_PATTERN)


def format_duration(seconds: Column, units: tuple[str, str, str] = ("сек", "мин", "час")) -> Column:
    """One decimal in seconds, minutes or hours, rounded half-even on the exact binary value."""
    def shown(value: Column, unit: str) -> Column:
        return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit(f" {unit}"))

    return (
        F.when(seconds < 60, shown(seconds, units[0]))
        .when(seconds < 3600, shown(seconds / F.lit(60.0), units[1]))
        .otherwise(shown(seconds / F.lit(3600.0), units[2]))
    )
