"""Scalar functions for labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """Minutes and two-digit seconds of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def duration_label(seconds: Column) -> Column:
    """`x.x hrs` from an hour on, else `x.x min`: tenths, rounded half up in whole numbers."""

    def tenths(size: int) -> Column:
        n = F.floor((F.floor(seconds) * 20 + size) / (2 * size)).cast("long")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    return F.when(seconds >= 3600, F.concat(tenths(3600), F.lit(" hrs"))).otherwise(F.concat(tenths(60), F.lit(" min")))


def camera_of(path: Column, known: list[str]) -> Column:
    """'ch' and digits in the lower-cased base name, if a known camera, else null."""
    base = F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))
    found = F.regexp_extract(base, r"(ch\d+)", 1)
    return F.when(found.isin(known), found)


def bucket_size(duration: Column) -> Column:
    """Seconds of a report's bucket: 5 minutes below two hours, 15 below six, else 30."""
    return F.when(duration < 7200, 300).when(duration < 21600, 900).otherwise(1800)


def axis_step(duration: Column) -> Column:
    """Seconds between the marks of an axis, by the length of what it shows."""
    return F.when(duration <= 30, 5).when(duration <= 3600, 300).when(duration <= 14400, 900).when(duration <= 28800, 1800).otherwise(3600)


def marker_step(count: Column) -> Column:
    """Every how many events one is numbered, by how many there are."""
    return F.when(count > 100, 50).when(count > 50, 25).otherwise(10)
