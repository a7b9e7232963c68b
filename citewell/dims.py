"""Fixed dimensions: macro-regions and Latin American country codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Macro-region, and its ISO 3166 alpha-2 country codes.
REGIONS = {
    "China": "CN HK",
    "Asia Emergente": "IN ID MY PH TH VN PK BD",
    "Latinoamérica y Caribe": "AR BO BR CL CO CR CU DO EC SV GT HN MX NI PA PY PE PR UY VE JM TT",
    "África Subsahariana": "ZA NG KE ET GH TZ UG SN CM CI ZW",
    "MENA": "DZ EG IR IQ JO KW LB LY MA OM PS QA SA SY TN AE YE",
    "Norteamérica Anglosajona": "US CA GB IE AU NZ",
    "Europa Central/Occidental": "AT BE CH DE DK ES FI FR GR IT LU NL NO PT SE IS IL",
    "Europa del Este": "PL CZ HU RO BG SK HR EE LV LT UA RU",
    "Asia-Pacífico Desarrollado": "JP KR SG TW",
}
#: Country codes of the collection, and the wider list for the snapshot.
LATAM_CODES = "MX BR AR CL CO PE VE EC CU UY CR BO DO GT PY SV HN NI PA PR".split()
LATAM_CODES_WIDE = "MX GT SV HN NI CR PA CU DO HT PR CO VE EC PE BO CL AR PY UY BR BZ JM TT BB BS GY SR GF".split()
OTHER = "Other"


def country_codes() -> list[str]:
    """All country codes of all regions, flat."""
    return [code for codes in REGIONS.values() for code in codes.split()]


def region_for(code: str | None) -> str:
    return next((region for region, codes in REGIONS.items() if code in codes.split()), OTHER)


def regions(spark: SparkSession) -> DataFrame:
    """``country_code, region``: about a hundred rows, safe to broadcast at any input size."""
    return spark.createDataFrame([(c, r) for r, codes in REGIONS.items() for c in codes.split()], "country_code string, region string")


def with_region(df: DataFrame, country_col: str = "country_code", out: str = "region") -> DataFrame:
    """Adds the region of a country code; unknown and null codes are ``Other``."""
    dim = regions(df.sparkSession).select(F.col("country_code").alias(country_col), F.col("region").alias(out))
    return df.join(F.broadcast(dim), country_col, "left").withColumn(out, F.coalesce(out, F.lit(OTHER)))


def mapped(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped value, or the value itself where the map has none."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)
