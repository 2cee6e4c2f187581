"""Deadline text to Unix seconds and back, at a fixed zone, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of every deadline.
ZONE = "Asia/Ho_Chi_Minh"
#: Words for the day and for the part of the day.
TODAY, TOMORROW = ("hôm nay",), ("mai", "ngày mai")
MORNING, LATER = "sáng", ("chiều", "tối")


def local_day_start(reference: Column, days: int = 0) -> Column:
    """Unix seconds of local midnight, `days` after the day that holds the reference (a timestamp)."""
    midnight = F.date_trunc("day", F.from_utc_timestamp(reference, ZONE)) + F.expr(f"INTERVAL {days} DAYS")
    return F.unix_seconds(F.to_utc_timestamp(midnight, ZONE))


def format_deadline(due_at: Column) -> Column:
    """dd/MM/yyyy HH:mm in the zone; null stays null."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(due_at), ZONE), "dd/MM/yyyy HH:mm")


def clock_24(hour: Column, period: Column) -> Column:
    """Hour of the day: as it is without a period; with one, 12 is 0 in the morning and 12 later. Out of range is null."""
    plain = F.when(hour.between(0, 23), hour)
    morning = F.when(hour == 12, 0).otherwise(hour)
    later = F.when(hour == 12, 12).otherwise(hour + 12)
    with_period = F.when(hour.between(1, 12), F.when(period == MORNING, morning).when(period.isin(*LATER), later))
    return F.when(period == "", plain).otherwise(with_period)


def parse_deadline(text: Column, reference: Column) -> Column:
    """Unix seconds of a deadline text, null where it is outside the grammar or not a real date.

    Forms: d/M/yyyy H:mm; H:mm with a day word and a date; H:mm and a relative day; an hour in words, with optional
    minutes, a part of the day and a relative day. One line, white space collapsed, final . ? ! ignored."""
    line = F.when(~text.rlike(r"[\n\r]"), text)
    value = F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    value = F.lower(F.regexp_replace(F.regexp_replace(value, r"[.?!]+$", ""), r"(?U)\s+$", ""))
    days = f"(?<day>{'|'.join(TODAY + TOMORROW)})"
    part = f"({MORNING}|{'|'.join(LATER)})"

    def pick(pattern: str, group: int) -> Column:
        return F.regexp_extract(value, pattern, group)

    date_first, time_first = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2})$", r"^([0-9]{1,2}):([0-9]{2}) ngày ([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    colon, words = rf"^([0-9]{{1,2}}):([0-9]{{2}}) {days}$", rf"^([0-9]{{1,2}}) giờ(?: ([0-9]{{1,2}}) phút)? {part} {days}$"

    def moment(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
        whole = F.try_make_timestamp(year, month, day, hour, F.when(minute <= 59, minute), F.lit(0))
        return F.unix_seconds(F.to_utc_timestamp(whole, ZONE))

    def number(pattern: str, group: int) -> Column:
        return F.nullif(pick(pattern, group), F.lit("")).try_cast("int")

    def relative(pattern: str, group: int, hour: Column, minute: Column) -> Column:
        local = F.from_utc_timestamp(reference, ZONE)
        on = F.date_add(F.to_date(local), F.when(pick(pattern, group).isin(*TODAY), 0).otherwise(1))
        return moment(F.year(on), F.month(on), F.day(on), hour, minute)

    none = F.lit("")
    absolute1 = moment(number(date_first, 3), number(date_first, 2), number(date_first, 1), clock_24(number(date_first, 4), none), number(date_first, 5))
    absolute2 = moment(number(time_first, 5), number(time_first, 4), number(time_first, 3), clock_24(number(time_first, 1), none), number(time_first, 2))
    relative1 = relative(colon, 3, clock_24(number(colon, 1), none), number(colon, 2))
    relative2 = relative(words, 4, clock_24(number(words, 1), pick(words, 3)), F.coalesce(number(words, 2), F.lit(0)))
    return (
        F.when(value.rlike(date_first), absolute1).when(value.rlike(time_first), absolute2)
        .when(value.rlike(colon), relative1).when(value.rlike(words), relative2)
    )
