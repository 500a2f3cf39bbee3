"""What a page shows of a row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds below which a follower is live, and behind.
LIVE, BEHIND = 60, 300
EXPLORER = "https://etherscan.io/address/"


def age(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("string")
    hours = F.floor(seconds / 3600).cast("string")
    return (
        F.when(seconds.isNull(), "n/a")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s")))
        .when(seconds < 3600, F.concat(minutes, F.lit(" min")))
        .otherwise(F.concat(hours, F.lit(" h")))
    )


def status(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unknown").when(seconds < LIVE, "live").when(seconds < BEHIND, "behind").otherwise("stalled")


def score(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.format_string("%.4f", value))


def short_address(address: Column) -> Column:
    return F.when(F.length(address) <= 12, address).otherwise(F.concat(F.left(address, F.lit(6)), F.lit("\u2026"), F.right(address, F.lit(4))))


def explorer_url(address: Column) -> Column:
    return F.concat(F.lit(EXPLORER), F.lower(address))


def time_of(at: Column) -> Column:
    """The time of day of a UTC time stamp, or what was given if it is none."""
    found = F.regexp_extract(at, "^[0-9]{4}-[0-9]{2}-[0-9]{2}T([0-9]{2}:[0-9]{2}:[0-9]{2})Z$", 1)
    return F.when(found != "", found).otherwise(at)
