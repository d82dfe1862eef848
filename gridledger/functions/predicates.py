"""Boolean columns for filters. Date filters are plain ranges so they reach the Parquet reader."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import (
    ACTIVE_STATUS,
    ASSET_PATH_PARTS,
    ASSET_SUFFIXES,
    BATTERY_CHEMISTRY_CODES,
    BATTERY_TECHNOLOGY_CODES,
    BATTERY_WORDS,
    MONTHS_ABBR,
    NOT_BATTERY_WORDS,
    STATES,
)
from gridledger.functions.labels import any_of


def in_list(col: Column, values: Sequence) -> Column:
    """Membership; an empty list matches nothing."""
    return col.isin(list(values)) if values else F.lit(False)


def in_list_or_all(col: Column, values: Sequence | None) -> Column:
    """Membership as a dashboard filter means it: nothing chosen is no filter."""
    return col.isin(list(values)) if values else F.lit(True)


def year_between(day: Column, first: int, last: int) -> Column:
    return (day >= F.lit(dt.date(first, 1, 1))) & (day < F.lit(dt.date(last + 1, 1, 1)))


def kw_between(kw: Column, low_mw: float, high_mw: float) -> Column:
    return kw.between(F.lit(low_mw * 1000.0), F.lit(high_mw * 1000.0))


def kw_band(kw: Column, low: float | None = None, high: float | None = None) -> Column:
    """Half-open capacity band [low, high)."""
    test = kw.isNotNull()
    if low is not None:
        test = test & (kw >= low)
    if high is not None:
        test = test & (kw < high)
    return test


def is_active(df: DataFrame) -> Column:
    """In operation, whether the table carries the status as a code or as text."""
    have = {name.lower(): name for name in df.columns}
    name = have.get("einheitbetriebsstatus") or have["betriebsstatus"]
    return F.col(name).cast("string").isin(list(ACTIVE_STATUS))


def is_onshore(df: DataFrame) -> Column:
    """Not at sea, in either encoding of the location. A missing location counts as onshore."""
    tests = [F.lit(True)]
    have = {name.lower(): name for name in df.columns}
    for name, sea in (("lage", "WindAufSee"), ("windanlandoderaufsee", "889")):
        if name in have:
            col = F.col(have[name]).cast("string")
            tests.append(col.isNull() | (col != sea))
    combined = tests[0]
    for test in tests[1:]:
        combined = combined & test
    return combined


def is_offshore(df: DataFrame) -> Column:
    have = {name.lower(): name for name in df.columns}
    tests = []
    if "lage" in have:
        tests.append(F.coalesce(F.col(have["lage"]) == "WindAufSee", F.lit(False)))
    if "seelage" in have:
        tests.append(F.col(have["seelage"]).isNotNull())
    return any_of(tests)


def is_battery(
    df: DataFrame,
    technology_codes: Sequence[str] = BATTERY_TECHNOLOGY_CODES,
    chemistry_codes: Sequence[str] = BATTERY_CHEMISTRY_CODES,
    excluded_codes: Sequence[str] = (),
) -> Column:
    """Battery storage by wording or code, with pumped and hydrogen storage ruled out."""
    have = {name.lower(): name for name in df.columns}
    technology = F.trim(F.coalesce(F.col(have["technologie"]).cast("string"), F.lit("")))
    wording = F.lower(technology)
    wanted = wording.rlike("|".join(BATTERY_WORDS)) | in_list(technology, technology_codes)
    if "batterietechnologie" in have:
        chemistry = F.trim(F.coalesce(F.col(have["batterietechnologie"]).cast("string"), F.lit("")))
        wanted = wanted | in_list(chemistry, chemistry_codes)
    return wanted & ~wording.rlike("|".join(NOT_BATTERY_WORDS)) & ~in_list(technology, excluded_codes)


def state_codes(names: Sequence[str]) -> list[str]:
    """Codes of the named federal states, for filters on the raw code column."""
    return [code for code, name in STATES.items() if name in set(names)]


def in_states(code: Column, names: Sequence[str] | None) -> Column:
    """State filter by name on the code column: no name is no filter, unknown names match nothing."""
    return in_list(code, state_codes(names)) if names else F.lit(True)


def business_hour(local: Column, first: int = 7, last: int = 18) -> Column:
    return F.hour(local).between(first, last)


def in_season(season: Column, month: Column) -> Column:
    """``Jun-Aug`` style ranges; ``Nov-Feb`` wraps around the year; anything else is false."""
    names = F.array(*[F.lit(name) for name in MONTHS_ABBR])
    parts = F.split(season, "-")
    start = F.array_position(names, F.get(parts, 0))
    end = F.array_position(names, F.get(parts, 1))
    valid = (F.size(parts) == 2) & (start > 0) & (end > 0)
    inside = F.when(start <= end, (month >= start) & (month <= end)).otherwise(
        (month >= start) | (month <= end)
    )
    return F.coalesce(valid & inside, F.lit(False))


def search_text(text: Column, pattern: str | None) -> Column:
    """Case-insensitive pattern search; a blank pattern is no filter."""
    if not pattern or not pattern.strip():
        return F.lit(True)
    return text.rlike(f"(?i){pattern}")


def is_entry_page(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\?.*$", "")
    return F.coalesce(bare.rlike(r"^/+$") | bare.rlike(r"^/[^/]+/?$"), F.lit(False))


def is_asset(path: Column) -> Column:
    """Anything that is not an entry page, plus sockets, libraries and static files."""
    parts = path.rlike("(?i)(" + "|".join(map(re.escape, ASSET_PATH_PARTS)) + ")")
    files = path.rlike(r"(?i)\.(" + "|".join(ASSET_SUFFIXES) + r")(\?|$)")
    return ~is_entry_page(path) | F.coalesce(parts | files, F.lit(True))


def ytd(day: Column, as_of: dt.date, all_years: bool = False) -> Column:
    """Months up to the current one, of this year or of every year."""
    months = F.month(day) <= as_of.month
    return months if all_years else months & year_between(day, as_of.year, as_of.year)


def since_months(day: Column, as_of: dt.date, months: int) -> Column:
    """From the first of the month that lies ``months`` back."""
    back = as_of.year * 12 + as_of.month - 1 - months
    return day >= F.lit(dt.date(back // 12, back % 12 + 1, 1))


def local_day(instant: Column, tz: str, day: dt.date) -> Column:
    return F.to_date(F.convert_timezone(None, F.lit(tz), instant)) == F.lit(day)
