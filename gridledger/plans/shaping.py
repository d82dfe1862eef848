"""Small helpers the query modules share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the checking side, written out once more so that a wrong constant of the catalogue shows
CHECKED_BUCKETS_17 = (
    ("<= 1 kW", 1), ("<= 3 kW", 3), ("<= 5 kW", 5), ("<= 10 kW", 10), ("<= 15 kW", 15), ("<= 25 kW", 25),
    ("<= 50 kW", 50), ("<= 100 kW", 100), ("<= 125 kW", 125), ("<= 150 kW", 150), ("<= 250 kW", 250),
    ("<= 500 kW", 500), ("<= 1000 kW", 1000), ("<= 2500 kW", 2500), ("<= 5000 kW", 5000), ("<= 10000 kW", 10000),
    ("> 10000 kW", None),
)
CHECKED_DELAYS = (
    ("<-900", -900), ("-900", -600), ("-600", -300), ("-300", -60), ("-60", -30), ("-30", -14), ("-14", 0), ("0", 7),
    ("7", 14), ("14", 30), ("30", 60), ("60", 90), ("90", 180), ("180", 365), ("365", 730), ("730+", None),
)
SQL_STATES = """(VALUES
    ('1400', 'Brandenburg'), ('1401', 'Berlin'), ('1402', 'Baden-Württemberg'), ('1403', 'Bayern'), ('1404', 'Bremen'),
    ('1405', 'Hessen'), ('1406', 'Hamburg'), ('1407', 'Mecklenburg-Vorpommern'), ('1408', 'Niedersachsen'),
    ('1409', 'Nordrhein-Westfalen'), ('1410', 'Rheinland-Pfalz'), ('1411', 'Schleswig-Holstein'), ('1412', 'Saarland'),
    ('1413', 'Sachsen'), ('1414', 'Sachsen-Anhalt'), ('1415', 'Thüringen'), ('1416', 'Ausschließliche Wirtschaftszone')
    ) AS t(code, name)"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round named doubles, where the order of a float sum could show in the last digits."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def mw(col: str) -> Column:
    return F.sum(col) / 1000


def units_and_mw(kw: str = "bruttoleistung_kw") -> list[Column]:
    return [F.count("*").alias("units"), mw(kw).alias("mw")]


def sql_ladder(col: str, bounds: Sequence[tuple[str, float | None]], op: str) -> str:
    """The CASE ladder as SQL text for the checking side."""
    arms = " ".join(f"WHEN {col} {op} {upper} THEN '{label}'"
                    for label, upper in bounds if upper is not None)
    return f"CASE {arms} ELSE '{bounds[-1][0]}' END"


def sql_ladder_ord(col: str, bounds: Sequence[tuple[str, float | None]], op: str) -> str:
    arms = " ".join(f"WHEN {col} {op} {upper} THEN {i}"
                    for i, (_, upper) in enumerate(bounds, 1) if upper is not None)
    return f"CASE {arms} ELSE {len(bounds)} END"


def sql_bucket17(col: str) -> str:
    return sql_ladder(col, CHECKED_BUCKETS_17, "<=")


def sql_class6(col: str) -> str:
    return (f"CASE WHEN {col} < 10 THEN '0–10 kW' WHEN {col} < 30 THEN '10–30 kW' WHEN {col} < 100 THEN '30–100 kW'"
            f" WHEN {col} < 750 THEN '100–750 kW' WHEN {col} < 10000 THEN '0.75–10 MW' ELSE '>10 MW' END")


def sql_segment3(col: str) -> str:
    return f"CASE WHEN {col} < 10 THEN 'Home' WHEN {col} < 1000 THEN 'C&I' ELSE 'Large Scale' END"


SQL_RENEWABLE = ("('SolareStrahlungsenergie', 'Wind', 'Biomasse', 'Wasser',"
                 " 'GeothermieGrubenKlaerschlamm')")
