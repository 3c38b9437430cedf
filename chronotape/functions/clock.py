"""Time on the tape: moments are whole microseconds, local time is a fixed offset."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR
LOCAL_OFFSET = 5 * HOUR


def local_day(t: Column) -> Column:
    """Number of the local calendar day, counted from 1970-01-01."""
    return F.floor((t + F.lit(LOCAL_OFFSET)) / F.lit(DAY)).cast("bigint")


def local_timestamp(t: Column) -> Column:
    """Wall clock of the local offset, as a timestamp of a UTC session."""
    return F.timestamp_micros(t + F.lit(LOCAL_OFFSET))


def local_date(t: Column) -> Column:
    return local_timestamp(t).cast("date")


def end_of_day(day: Column) -> Column:
    """The local midnight after a day number, in UTC microseconds."""
    return (day + 1) * F.lit(DAY) - F.lit(LOCAL_OFFSET)


def monday(day: Column) -> Column:
    """Day number of the ISO Monday of the week that holds the day (1970-01-01 was a Thursday)."""
    return day - F.pmod(day + 3, F.lit(7))


def month_number(t: Column) -> Column:
    """Months since year 0 of the local date: neighbours differ by one."""
    date = local_date(t)
    return F.year(date) * 12 + F.month(date) - 1


def full_years(born: Column, day: Column) -> Column:
    """Whole years between two dates; a birthday counts on its day."""
    passed = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(born), F.dayofmonth(born))
    return F.year(day) - F.year(born) - passed.cast("int")


def full_months(start: Column, day: Column) -> Column:
    """Whole months by day of month, with no exception for month ends."""
    months = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    return months - (F.dayofmonth(day) < F.dayofmonth(start)).cast("int")


def tenure_label(months: Column) -> Column:
    """Half-year label such as 36-41."""
    low = (F.floor(months / 6) * 6).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + 5).cast("string"))


def calendar_channel(t: Column) -> list[Column]:
    """Sine and cosine of the local hour, weekday (Monday 0) and day of month."""
    moment = local_timestamp(t)
    hour = F.pmod(t + F.lit(LOCAL_OFFSET), F.lit(DAY)) / F.lit(float(HOUR))
    phases = {
        "hour": hour / 24,
        "weekday": F.weekday(moment) / 7,
        "month_day": (F.dayofmonth(moment) - 1) / 31,
    }
    out = []
    for name, phase in phases.items():
        angle = phase * F.lit(2.0) * F.pi()
        out.append(F.sin(angle).alias(f"{name}_sin"))
        out.append(F.cos(angle).alias(f"{name}_cos"))
    return out


def log_time(delta_seconds: Column) -> Column:
    """8 * log1p(seconds / 8); the caller checks that the distance is not negative."""
    return F.lit(8.0) * F.log1p(delta_seconds / F.lit(8.0))


def linear_time(log_value: Column) -> Column:
    return F.lit(8.0) * F.expm1(log_value / F.lit(8.0))
