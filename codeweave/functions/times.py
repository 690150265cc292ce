"""Time values: elapsed times, dates in several formats, and units of time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}
_ALIASES = {"seconds": "secs", "sec": "secs", "second": "secs", "minutes": "mins", "min": "mins", "minute": "mins"}

# The accepted date formats, in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yy HH:mm", "dd/MM/yy HH:mm", "MM/dd/yyyy HH:mm")
# One-digit hours, days and months, which get a leading zero; elapsed times as MM:SS and HH:MM:SS.
PADDED = ((r" (\d):", " 0$1:"), (r"^(\d)([/-])", "0$1$2"), (r"(?<=[/-])(\d)(?=[/-])", "0$1"))
ELAPSED = (r"^(\d{1,2}):(\d{2})$", r"^(\d{1,3}):(\d{2}):(\d{2})$")


def seconds_per_unit(unit: str | None) -> int | None:
    """Seconds of a time unit; None for lines."""
    name = (unit or "").strip().strip("'\"").lower()
    if name in ("", "lines", "auto"):
        return None
    name = _ALIASES.get(name, name)
    name = name if name.endswith("s") else name + "s"
    if name not in UNIT_SECONDS:
        raise ValueError(f"unknown time unit {unit!r}")
    return UNIT_SECONDS[name]


def _padded(text: Column) -> Column:
    """One-digit hours, days and months get a leading zero."""
    text = F.trim(text)
    for pattern, put in PADDED:
        text = F.regexp_replace(text, pattern, put)
    return text


def parse_seconds(value: Column) -> Column:
    """Seconds of an elapsed time (MM:SS, HH:MM:SS) or a date (since 1970, UTC); null if it is neither.

    Two-digit years up to 68 are of this century.
    """
    text = _padded(value.cast("string"))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).cast("double")
    short, long = ELAPSED
    tried = [
        F.when(text.rlike(short), part(short, 1) * 60 + part(short, 2)),
        F.when(text.rlike(long), part(long, 1) * 3600 + part(long, 2) * 60 + part(long, 3)),
    ]
    for fmt in DATE_FORMATS:
        pattern = "^" + fmt.replace("yyyy", r"(\d{4})").replace("yy", r"(\d{2})").replace("MM", r"(\d{2})").replace("dd", r"(\d{2})").replace("HH", r"(\d{2})").replace("mm", r"(\d{2})").replace("ss", r"(\d{2})") + "$"
        fields = [f for f in fmt.replace("/", " ").replace("-", " ").replace(":", " ").split()]
        got = {f: F.regexp_extract(text, pattern, k + 1).cast("int") for k, f in enumerate(fields)}
        year = got["yyyy"] if "yyyy" in got else F.when(got["yy"] <= 68, 2000 + got["yy"]).otherwise(1900 + got["yy"])
        month, day = got["MM"], got["dd"]
        hour, minute, second = (got.get(f, F.lit(0)) for f in ("HH", "mm", "ss"))
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31)
        real = text.rlike(pattern) & month.between(1, 12) & (day >= 1) & (day <= last) & (hour <= 23) & (minute <= 59) & (second <= 61)
        # Days since 1970 by the civil calendar, so that no session time zone takes part.
        shifted = F.when(month <= 2, year - 1).otherwise(year)
        era = F.floor(shifted / 400)
        of_era = shifted - era * 400
        of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
        days = era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468
        tried.append(F.when(real, (days * 86400 + hour * 3600 + minute * 60 + second).cast("double")))
    return F.coalesce(*tried)


def time_seconds(value: Column, numeric: bool) -> Column:
    return value.cast("double") if numeric else parse_seconds(value)
