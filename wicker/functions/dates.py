"""Date predicates on strings. All metadata times stay strings; the reference time is always an argument."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def explicit_zone_epoch(c: Column) -> Column:
    """Seconds since 1970 of a date-time with Z or a numeric offset; null where it is not one."""
    parts = F.struct(*[F.regexp_extract(c, STAMP, k).alias(f"p{k}") for k in (1, 2, 3, 4, 6)])
    return F.transform(
        F.array(F.when(c.rlike(STAMP), parts)),
        lambda p: F.call_function(
            "if",
            (p["p2"] <= "23") & (p["p3"] <= "59") & (p["p4"] <= "59") & ((p["p6"] == "Z") | (p["p6"].substr(2, 2) <= "23") & (F.right(p["p6"], F.lit(2)) <= "59")),
            F.unix_seconds(F.try_to_timestamp(F.concat(p["p1"], F.lit("T"), p["p2"], F.lit(":"), p["p3"], F.lit(":"), p["p4"], F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
            - F.when(p["p6"] == "Z", 0).otherwise(F.concat(F.substring(p["p6"], 1, 1), F.lit("1")).cast("int") * (p["p6"].substr(2, 2).cast("int") * 3600 + F.right(p["p6"], F.lit(2)).cast("int") * 60)),
            F.lit(None).cast("long"),
        ),
    )[0]


def is_usage_window(start: Column, end: Column) -> Column:
    return is_iso_date(start) & is_iso_date(end) & F.coalesce(start <= end, F.lit(False))


#: A reference time: a date, or a date and time to the minute at least, with Z, an offset, or neither (which is UTC).
REFERENCE = re.compile(r"(\d{4}-\d{2}-\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")


def reference_time(value: str) -> tuple[int, str]:
    """Seconds since 1970 and the UTC date of the time that rules compare with; 24:00 is the next day's start. Anything else is a ValueError."""
    m = REFERENCE.fullmatch(value)
    if not m:
        raise ValueError("the reference time must be an ISO date or date-time")
    hour, minute, second = int(m[2] or 0), int(m[3] or 0), int(m[4] or 0)
    if hour > 24 or minute > 59 or second > 59 or (hour == 24 and (minute or second or (m[5] or "").strip(".0"))):
        raise ValueError("the reference time has no such hour, minute or second")
    zone = (m[6] or "Z").replace(":", "")
    away = 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[3:5]) * 60)
    if zone != "Z" and (int(zone[1:3]) > 23 or int(zone[3:5]) > 59):
        raise ValueError("the reference time has no such offset")
    day = datetime.strptime(m[1], "%Y-%m-%d").replace(tzinfo=UTC)
    at = int(day.timestamp()) + hour * 3600 + minute * 60 + second - away
    return at, datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%d")
