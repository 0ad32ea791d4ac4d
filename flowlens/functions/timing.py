"""Instants, differences and their texts. Nothing here reads the clock; callers pass `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-like text to a timestamp (session zone UTC), null when unparseable."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX")),
    )


def micros_between(a: Column, b: Column) -> Column:
    """Whole microseconds from `a` to `b`, exact."""
    return F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(1e6)


def rounded_seconds(a: Column, b: Column) -> Column:
    """Whole seconds, halves to even."""
    exact = micros_between(a, b).cast("decimal(28,0)") / F.lit(1000000).cast("decimal(8,0)")
    return F.bround(exact.cast("decimal(28,6)"), 0).cast("bigint")


def duration_text(secs: Column) -> Column:
    """`1d:02h:03m:04s`; leading units only when reached; null prints N/A."""
    s = secs.cast("bigint")

    def unit(size: int, mod: int | None) -> Column:
        whole = F.floor(s / size) if mod is None else F.floor(s / size) % mod
        return whole.cast("bigint").cast("string")

    def two(size: int, mod: int) -> Column:
        return F.lpad(unit(size, mod), 2, "0")

    return (
        F.when(s.isNull(), "N/A")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(unit(60, None), F.lit("m:"), two(1, 60), F.lit("s")))
        .when(
            s < 86400,
            F.concat(unit(3600, None), F.lit("h:"), two(60, 60), F.lit("m:"), two(1, 60), F.lit("s")),
        )
        .otherwise(
            F.concat(
                unit(86400, None), F.lit("d:"), two(3600, 24), F.lit("h:"),
                two(60, 60), F.lit("m:"), two(1, 60), F.lit("s"),
            )
        )
    )


def age_text(at: Column, as_of: Column) -> Column:
    """`x ago`, `Just now` up to two seconds, `Unknown` when there is no instant."""
    secs = F.floor(micros_between(at, as_of) / 1000000).cast("bigint")
    return (
        F.when(at.isNull(), "Unknown")
        .when(secs > 2, F.concat(duration_text(secs), F.lit(" ago")))
        .otherwise("Just now")
    )
