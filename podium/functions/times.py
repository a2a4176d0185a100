"""Event times: epoch milliseconds, ISO texts, weeks. None depends on the session's time zone unless said so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY = 86_400_000


def event_ms(c: Column, kind: T.DataType) -> Column:
    """Epoch milliseconds, cut down, of a timestamp; one without a zone counts as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    second = F.extract(F.lit("SECOND"), c)
    return days * _DAY + F.hour(c) * 3_600_000 + F.minute(c) * 60_000 + F.floor(second * 1000).cast("long")


def iso_ms(text: Column) -> Column:
    """Epoch milliseconds of ISO-8601 text with an offset or Z; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def iso_text(ms: Column) -> Column:
    """ISO-8601 text in UTC, to the millisecond."""
    rest = F.pmod(ms, F.lit(_DAY))
    return F.concat(
        day_of(ms).cast("string"),
        F.lit("T"),
        F.format_string("%02d:%02d:%02d.%03d", F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000),
        F.lit("Z"),
    )


def day_of(ms: Column) -> Column:
    """The UTC date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / _DAY).cast("int"))


def week_number(day: Column) -> Column:
    """Weeks start on Sunday; week 1 has the 1st of January. A year's last days may be in week 1."""
    return F.ceil(F.dayofyear(F.date_add(day, 7 - F.dayofweek(day))) / 7).cast("int")


def week_start(day: Column) -> Column:
    """The Sunday that the date's week starts on."""
    return F.date_sub(day, F.dayofweek(day) - 1)
