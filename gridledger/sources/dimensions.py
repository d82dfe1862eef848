"""Small CSV dimensions with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions.convert import norm_plz
from gridledger.functions.labels import sector


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, read by a declared schema; quoted fields may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"',
                                         encoding="UTF-8", enforceSchema=True)


def read_dim(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A dimension; a postcode key is brought to five digits."""
    df = read_csv(spark, path, schema)
    return df.withColumn(key, norm_plz(F.col(key))) if key else df


def elections(raw: DataFrame, places: DataFrame) -> DataFrame:
    """Renamed, typed election areas with their position."""
    votes = raw.select(
        F.col("Electoral Area").alias("casa"),
        F.col("Local votes").try_cast("int").alias("local_votes"),
        F.col("Expat votes").try_cast("int").alias("expat_votes"),
        F.col("Candidates").try_cast("int").alias("candidates"),
    )
    return votes.join(places, "casa", "left")


def read_elections(spark: SparkSession, votes_path: str, places_path: str) -> DataFrame:
    raw = read_csv(spark, votes_path, "`Electoral Area` string, `Local votes` string,"
                                      " `Expat votes` string, Candidates string")
    return elections(raw, read_csv(spark, places_path, "casa string, lat double, lon double"))


def organisations(raw: DataFrame, lat: str = "latitude", lon: str = "longitude",
                  key: str = "schluessel") -> DataFrame:
    """Organisations that have a position, with their sector."""
    return raw.dropna(subset=[lat, lon]).withColumn("sector", sector(F.col(key)))


def read_orgs(spark: SparkSession, path: str) -> DataFrame:
    schema = ("Institutions string, Latitude double, Longitude double, Location string,"
              " Email string, Website string, Abschnitte string, Abteilungen double,"
              " Gruppen double, Klassen double, Unterklassen double, `Schlüssel` string")
    return organisations(read_csv(spark, path, schema), "Latitude", "Longitude", "Schlüssel")
