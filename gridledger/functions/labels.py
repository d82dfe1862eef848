"""Classes, bands and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.catalog import (
    DEVICE_WORDS,
    MONTHS_DE,
    SECTOR_PREFIXES,
    SEGMENTS_3,
    SIZE_BUCKETS_17,
    SIZE_CLASSES_6,
)

Bounds = Sequence[tuple[str, float | None]]


def ladder(
    col: Column, bounds: Bounds, inclusive: bool, null_label: str | None = None, ordinal: bool = False
) -> Column:
    """First class whose upper bound holds. A NULL value lands in the open last class, as in a
    CASE ladder, unless ``null_label`` names a class of its own (ordinal 0)."""
    steps = [(i, label, upper) for i, (label, upper) in enumerate(bounds, 1)]
    last_i, last_label, _ = steps[-1]
    chain = None
    if null_label is not None:
        chain = F.when(col.isNull(), F.lit(0 if ordinal else null_label))
    for i, label, upper in steps[:-1]:
        test = (col <= upper) if inclusive else (col < upper)
        value = F.lit(i if ordinal else label)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(F.lit(last_i if ordinal else last_label))


def label_at(ordinal: Column, bounds: Bounds) -> Column:
    """Label of a class by its ordinal. Grouping on the ordinal and labelling the result rows spares
    a text key per input row."""
    return F.element_at(F.array(*[F.lit(label) for label, _ in bounds]), ordinal)


def size_class6(kw: Column, null_class: str | None = None) -> Column:
    return ladder(kw, SIZE_CLASSES_6, inclusive=False, null_label=null_class)


def size_bucket17(kw: Column, null_class: str | None = None) -> Column:
    return ladder(kw, SIZE_BUCKETS_17, inclusive=True, null_label=null_class)


def size_bucket17_ord(kw: Column) -> Column:
    return ladder(kw, SIZE_BUCKETS_17, inclusive=True, ordinal=True)


def segment3(kw: Column, null_class: str | None = None) -> Column:
    return ladder(kw, SEGMENTS_3, inclusive=False, null_label=null_class)


def price_band(price: Column) -> Column:
    return (
        F.when(price.isNull(), "missing").when(price < 0, "negative").when(price < 50, "low")
        .when(price < 100, "medium").otherwise("high")
    )


def rad_band(watts: Column) -> Column:
    return (
        F.when(watts.isNull(), "missing").when(watts < 50, "dark").when(watts < 200, "dim")
        .when(watts < 500, "bright").otherwise("strong")
    )


def label_or_unknown(*cols: Column, label: str = "(unbekannt)") -> Column:
    return F.coalesce(*cols, F.lit(label))


def label_or_dash(col: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")), F.lit("—"))


def enum_label(code: Column, labels: Mapping[str, str], prefix: str = "Code ") -> Column:
    """Label of a code; an unknown code keeps its number behind ``prefix``."""
    text = F.trim(code.cast("string"))
    table = F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])
    return F.coalesce(F.try_element_at(table, text), F.concat(F.lit(prefix), text))


def sector(key: Column) -> Column:
    rules = [F.when(key.startswith(letter), F.lit(name)) for letter, name in SECTOR_PREFIXES]
    return F.coalesce(*rules, F.lit("Other"))


def known_or_null(col: Column, known: Sequence[str]) -> Column:
    return F.when(col.isin(list(known)), col)


def device(agent: Column) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    rules = [F.when(ua.rlike("|".join(words)), F.lit(kind)) for kind, words in DEVICE_WORDS]
    return F.coalesce(*rules, F.lit("Desktop"))


def page_slug(path: Column) -> Column:
    """First path segment without query string; the root is ``hub``."""
    first = F.regexp_extract(F.regexp_replace(path, r"\?.*$", ""), r"^/*([^/]*)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("hub"))


def month_name_de(day: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTHS_DE])
    return F.element_at(names, F.month(day))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def year_quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit(" "), quarter_label(day))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
