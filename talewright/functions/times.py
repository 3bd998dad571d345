"""Time stamps as nanoseconds since 1970, in whole-number column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?(Z|z|[+-]\d{2}(?::?\d{2})?)$"
NANOS = 1_000_000_000


def _group(text: Column, k: int) -> Column:
    return F.regexp_extract(text, _RFC, k)


def _int(text: Column) -> Column:
    return text.try_cast("bigint")


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds of a time with an explicit offset; null for any other text, a day that
    doesn't exist or a time that doesn't fit. A 61st second is accepted as the next minute."""
    s = F.trim(text)
    year, month, day = (_int(_group(s, k)) for k in (1, 2, 3))
    hour, minute, second = (_int(_group(s, k)) for k in (4, 5, 6))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    fine = month.between(1, 12) & (day >= 1) & (day <= days) & (hour <= 23) & (minute <= 59) & (second <= 60) & (year >= 1)
    zone = F.regexp_replace(_group(s, 8), ":", "")
    zone_hours, zone_minutes = _int(F.substring(zone, 2, 2)), F.coalesce(_int(F.nullif(F.substring(zone, 4, 2), F.lit(""))), F.lit(0))
    offset = F.when(F.upper(zone) == "Z", F.lit(0)).otherwise((zone_hours * 3600 + zone_minutes * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    fine = fine & ((F.upper(zone) == "Z") | ((zone_hours <= 23) & (zone_minutes <= 59)))
    # days from the civil calendar, with years that start in March
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400).cast("bigint")
    yoe = y - era * 400
    doy = F.floor((F.lit(153) * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5).cast("bigint") + day - 1
    doe = yoe * 365 + F.floor(yoe / 4).cast("bigint") - F.floor(yoe / 100).cast("bigint") + doy
    seconds = (era * 146_097 + doe - 719_468) * 86_400 + hour * 3600 + minute * 60 + second - offset
    fraction = _int(F.rpad(F.substring(F.coalesce(F.nullif(_group(s, 7), F.lit("")), F.lit("0")), 1, 9), 9, "0"))
    nanos = F.try_add(F.try_multiply(seconds, F.lit(NANOS).cast("bigint")), fraction)
    return F.when(s.rlike(_RFC) & fine, nanos)


def parse_epoch(number: Column) -> Column:
    """Nanoseconds of a whole number of seconds, milli-, micro- or nanoseconds, told apart by size; null up to 0."""
    n = number.cast("bigint")
    unit = F.when(n < 10_000_000_000, F.lit(NANOS)).when(n < 10_000_000_000_000, F.lit(1_000_000)).when(n < 10_000_000_000_000_000, F.lit(1000)).otherwise(F.lit(1))
    return F.when(n > 0, F.try_multiply(n, unit.cast("bigint")))


def to_rfc3339(nanos: Column, *, fixed: bool = False) -> Column:
    """Text of the time in UTC: without a fraction where it is 0 (unless `fixed`), else with nine digits."""
    seconds = ((nanos - F.pmod(nanos, F.lit(NANOS).cast("bigint"))) / F.lit(NANOS).cast("decimal(19,0)")).cast("bigint")
    rest = F.pmod(nanos, F.lit(NANOS).cast("bigint"))
    head = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.concat(F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
    return F.concat(head, tail if fixed else F.when(rest == 0, "").otherwise(tail), F.lit("Z"))


CONFIDENCE = tuple("exact provider_derived database_derived filesystem_derived sequence_only unknown".split())


def confidence_rank(confidence: Column) -> Column:
    """0 (exact) to 5 (unknown)."""
    rank = F.lit(5)
    for k, name in enumerate(CONFIDENCE[:-1]):
        rank = F.when(confidence == name, k).otherwise(rank)
    return rank
