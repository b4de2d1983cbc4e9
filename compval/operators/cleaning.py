"""Plausibility filters, recoding, and rewrites of county names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compval.functions import scalars as S


def prefilter() -> Column:
    """What the store filters before plausibility: location, price, area, no leasehold."""
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("marktwert").between(2e4, 2e6) & F.col("wohnflaeche").between(20, 2000) & ~F.coalesce(F.col("erbbaurecht"), F.lit(False))


def realistic(price=(2e4, 2e6), area=(20.0, 2000.0), sqm=(100.0, 20000.0), built=(1500, 2025), years=(2007, 2021)) -> Column:
    """All in range, inclusive; only the date may be missing."""
    year = F.year("wertermittlungsstichtag")
    return F.col("marktwert").between(*price) & F.col("wohnflaeche").between(*area) & S.sqm_price().between(*sqm) & F.col("baujahr").between(*built) & (year.isNull() | year.between(*years))


def necessary() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("wohnflaeche") > 0) & (F.col("marktwert") > 0)


def expert_valid() -> Column:
    """Can be let, used and used by others (unknown counts as yes), no leasehold, no multi-family house."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    return yes("vermietbarkeit") & yes("verwertbarkeit") & yes("drittverwendungsfaehigkeit") & ~F.coalesce(F.col("erbbaurecht"), F.lit(False)) & ~F.coalesce(F.col("objektunterart") == "Mehrfamilienhaus", F.lit(False))


def region_box(x: tuple[float, float], y: tuple[float, float], names: dict[str, list[str]]) -> Column:
    """One of the names in one of the columns, within the box."""
    named = F.lit(False)
    for column, values in names.items():
        named = named | F.col(column).isin(*values)
    return named & F.col("x").between(*x) & F.col("y").between(*y)


#: Fixed values: (town, counties that mean it or null, county to set).
TOWN_FIXES = [
    ("Berlin", ["Berlin", ""], "Berlin, Stadt"),
    ("München", ["München", "München, Stadt", "Berlin, Stadt", "Müchen, Landeshauptstadt"], "München, Landeshauptstadt"),
    ("Würzburg", ["Würzburg", "Würzburg Land"], "Würzburg Stadt"),
]


def load_rewrites(path: str) -> list[tuple[str, str]]:
    """The ordered rewrites of a JSON file: a list of [old, new]."""
    with open(path, encoding="utf-8") as f:
        return [(old, new) for old, new in json.load(f)]


def composed(rewrites: list[tuple[str, str]]) -> dict[str, str]:
    """What each name becomes when the rewrites apply one after the other to a whole table."""
    out: dict[str, str] = {}
    for old, new in rewrites:
        for k, v in out.items():
            if v == old:
                out[k] = new
        out.setdefault(old, new)
    return out


def county_names(df: DataFrame, rewrites: list[tuple[str, str]], county: str = "kreis", town: str = "ort", fixes=TOWN_FIXES) -> DataFrame:
    """Fixes by town first, then the ordered rewrites, composed on the driver into one lookup. The list of rewrites is
    a parameter, of a size that a broadcast holds by its nature."""
    c = F.col(county)
    for name, counties, new in fixes:
        c = F.when((F.col(town) == name) & (c.isNull() | c.isin(*counties)), new).otherwise(c)
    df = df.withColumn(county, c)
    table = composed(rewrites)
    if not table:
        return df
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(county, F.coalesce(F.try_element_at(names, F.col(county)), F.col(county)))


def recoded_sales(raw: DataFrame) -> DataFrame:
    """Raw monthly sales to listings: price and area filters, empty strings to null, dates and years parsed."""
    blank = lambda c: F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c))
    fine = (F.col("money_combo").try_cast("double") >= 2.6e6) & (F.col("house_area").try_cast("double") >= 1)
    return raw.where(fine).select(
        "*",
        F.try_to_timestamp(F.col("end_date"), F.lit("yyyy-MM-dd")).cast("date").alias("wertermittlungsstichtag"),
        blank("money_combo").try_cast("double").alias("marktwert"),
        blank("house_area").try_cast("double").alias("wohnflaeche"),
        blank("land_area_all").try_cast("double").alias("grundstuecksgroesse"),
        (blank("kenchiku_date").try_cast("double") / 100).cast("int").alias("baujahr"),
        F.col("madori_number_all").alias("anzahl_zimmer"),
    )


def parsed_offers(raw: DataFrame) -> DataFrame:
    """Rows of an offer file: unknown kinds and unreadable areas or prices go; dates stand at 23:00 UTC."""
    kind = S.lookup(F.col("nachfrageart"), {"kauf": "Sell", "miete": "Rent"})
    furnishing = S.lookup(F.col("aus_klassen_empirica"), S.OFFER_FURNISHING)
    out = raw.select(
        "angebot_id",
        kind.alias("offertype"),
        F.when(F.col("oadr_strasse") != "", F.concat("oadr_strasse", F.lit(", "), "oadr_plz", F.lit(" "), "oadr_ort")).alias("address"),
        S.decimal_comma(F.col("flaeche")).alias("wohnflaeche"),
        S.decimal_comma(F.col("kosten")).alias("marktwert"),
        (F.try_to_timestamp(F.col("enddate"), F.lit("yyyy-MM-dd")) + F.expr("INTERVAL 23 HOURS")).alias("wertermittlungsstichtag"),
        furnishing.alias("ausstattung"),
        S.furnishing_grade(furnishing).alias("ausstattung_note"),
        F.col("baujahr").try_cast("int").alias("baujahr"),
        F.col("anz_zimmer").try_cast("double").alias("anzahl_zimmer"),
        S.lookup(F.col("zust_klassen_empirica"), S.OFFER_CONDITION).alias("zustand"),
        S.offer_object(F.col("objekttyp_fein")).alias("objektunterart"),
        F.col("oadr_kreis").alias("kreis"),
        F.col("oadr_ort").alias("ort"),
        F.col("oadr_plz").alias("plz"),
        (~F.contains("kstn_ausreisser", F.lit("1"))).alias("realistic_costs"),
    )
    return out.where(F.col("offertype").isNotNull() & F.col("wohnflaeche").isNotNull() & F.col("marktwert").isNotNull())


def relevant_offers(offers: DataFrame) -> DataFrame:
    return offers.where((F.col("offertype") == "Sell") & F.col("address").isNotNull() & (F.length("plz") == 5))


def located(offers: DataFrame, places: DataFrame) -> DataFrame:
    """Offers with the coordinates of their address (a table address, x, y); those without a place go."""
    return offers.join(places.dropDuplicates(["address"]), "address")
