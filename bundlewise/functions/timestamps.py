"""ISO-8601 text to UTC instants, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# the shape nearly all logs have: parsed without any rewriting
_PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
# the other accepted shapes: any separator, compact date / time / offset, comma fraction; time and offset each keep to
# one style, with colons or without
_SECONDS = r"\d{2}([.,]\d+)?"
_TIME = rf"(\d{{2}}(:\d{{2}}(:{_SECONDS})?)?|\d{{2}}\d{{2}}({_SECONDS})?)"
_OFFSET = r"(Z|[+-]\d{2}(:\d{2}(:\d{2})?|\d{2}(\d{2})?)?)"
_LOOSE = rf"^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(.{_TIME}{_OFFSET}?)?$"


# fixed values: rewrites of the other shapes to date, T, full time, offset with minutes
_REWRITES = (
    (r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3"),
    (r"^(.{10}).(\d{2})", "$1T$2"),
    (r"^(.{13})(?=$|[Z+-])", "$1:00:00"),
    (r"^(.{13}):?(\d{2})(?=$|[Z+-])", "$1:$2:00"),
    (r"^(.{13}):?(\d{2}):?(\d{2})", "$1:$2:$3"),
    (r",", "."),
    (r"^(.{19}[^+-]*[+-]\d{2}):?(\d{2}):?(\d{2})$", "$1:$2:$3"),
    (r"^(.{19}.*[+-]\d{2}):?(\d{2})$", "$1:$2"),
    (r"^(.{19}.*[+-]\d{2})$", "$1:00"),
)


def _canonical(text: Column) -> Column:
    for pattern, replacement in _REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def parse_ts(text: Column) -> Column:
    """Timestamp of ISO-8601 text; no offset means UTC; NULL where the text is not a full date.

    `try_to_timestamp` alone is too generous (a bare year, a bare time, zone names), hence the shape check.
    """
    trimmed = F.trim(text, F.lit(_BLANKS))
    return F.when(trimmed.rlike(_PLAIN), F.try_to_timestamp(trimmed)).when(
        trimmed.rlike(_LOOSE), F.try_to_timestamp(_canonical(trimmed))
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def iso_utc(ts: Column) -> Column:
    """ISO rendering of an instant with microseconds and a UTC offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def floor_bucket(name: str, width: int) -> Column:
    """Exact integer floor(name / width), also for negative values."""
    return F.expr(f"({name} - pmod({name}, {width}L)) div {width}L")
