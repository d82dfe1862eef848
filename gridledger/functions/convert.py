"""Text to typed values and back. Bad input becomes NULL, it never fails a job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def to_number(col: Column, thousands: bool = False) -> Column:
    """German or English decimal text to double.

    ``1.234,56`` is NULL unless ``thousands`` says that dots before a comma group digits.
    """
    text = F.trim(col)
    if thousands:
        text = F.when(text.contains(","), F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    text = F.replace(text, F.lit(","), F.lit("."))
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double"))


def to_iso_date(col: Column) -> Column:
    """``YYYY-MM-DD`` with or without a time part to date; anything else is NULL."""
    day = F.substring(col, 1, 10)
    return F.when(day.rlike(_ISO_DAY), day.try_cast("date"))


def norm_plz(col: Column) -> Column:
    """Postcode text, short codes padded to five digits. Longer text is no postcode, but stays apart as it is."""
    text = col.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def code_text(col: Column) -> Column:
    """A catalogue code as text, whether it was stored as text or as a number (802.0 -> '802')."""
    number = col.try_cast("double")
    return F.when(
        number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")
    ).otherwise(col.cast("string"))


def fmt_de(col: Column, digits: int = 0, suffix: str = "") -> Column:
    """German number format: dot groups thousands, comma marks decimals; missing is a dash."""
    text = F.translate(F.format_number(col, digits), ",.", ".,")
    return F.coalesce(F.concat(text, F.lit(suffix)), F.lit("—"))


def fmt_percent_de(ratio: Column, digits: int = 2) -> Column:
    return fmt_de(ratio * 100, digits, "%")


def log_time(col: Column) -> Column:
    """Access-log time stamp as UTC wall-clock time; a stamp without zone counts as UTC."""
    zoned = F.try_to_timestamp(col, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    plain = F.try_to_timestamp(F.concat(col, F.lit(" +0000")), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return utc_clock(F.coalesce(zoned, plain))


def local_clock(instant: Column, tz: str) -> Column:
    """Wall-clock time of an instant in a zone, independent of the session time zone."""
    return F.convert_timezone(None, F.lit(tz), instant)


def utc_clock(instant: Column) -> Column:
    return local_clock(instant, "UTC")


def utc_instant(clock: Column) -> Column:
    """The instant a UTC wall-clock time stands for, as needed for event-time watermarks."""
    shifted = F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock.cast("timestamp_ntz"))
    return shifted.cast("timestamp")


def clock(moment: dt.datetime) -> Column:
    """A wall-clock literal. A plain datetime literal would be an instant in the driver's zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_to_local(seconds: Column, tz: str) -> Column:
    return local_clock(F.timestamp_seconds(seconds), tz)


def request_method(request: Column) -> Column:
    return F.nullif(F.regexp_extract(request, r"^([A-Z]+) ([^ ]+)", 1), F.lit(""))


def request_path(request: Column) -> Column:
    return F.nullif(F.regexp_extract(request, r"^([A-Z]+) ([^ ]+)", 2), F.lit(""))
