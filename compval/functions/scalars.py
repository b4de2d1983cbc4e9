"""Parsers, categories and derived values of one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object types by what their spelling contains, in this order.
OBJECT_TYPES = [
    (("etw", "eigentumswohnung"), "Eigentumswohnung"),
    (("doppelhaus",), "Doppelhaushaelfte"),
    (("reihenendhaus",), "Reihenendhaus"),
    (("reihenmittelhaus",), "Reihenmittelhaus"),
    (("zweifamilienhaus",), "Zweifamilienhaus"),
    (("reihenhaus",), "Reihenhaus"),
    (("mehrfamilienhaus",), "Mehrfamilienhaus"),
    (("einlieger",), "EinfamilienhausMitEinliegerWohnung"),
    (("efh", "einfamilienhaus"), "Einfamilienhaus"),
]
#: 1 row and semi-detached, 2 detached, 3 flat, 4 multi-family.
OBJECT_CATEGORY = {
    "Doppelhaushaelfte": 1,
    "Reihenmittelhaus": 1,
    "Reihenendhaus": 1,
    "Reihenhaus": 1,
    "Einfamilienhaus": 2,
    "Zweifamilienhaus": 2,
    "EinfamilienhausMitEinliegerWohnung": 2,
    "Eigentumswohnung": 3,
    "Mehrfamilienhaus": 4,
}
#: Fixed values of offer files.
OFFER_CONDITION = {"gut": "gut", "normal": "mittel", "schlecht": "schlecht"}
OFFER_FURNISHING = {"einfach": "einfach (Stufe 2)", "normal": "mittel (Stufe 3)", "gut": "gehoben (Stufe 4)", "hochwertig": "sehr gehoben (Stufe 5)"}
OFFER_OBJECT = {"EFH": "Einfamilienhaus", "MFH": "Mehrfamilienhaus", "RH": "Reihenhaus", "DHH": "Doppelhaushälfte"}
CONDITIONS = {"katastrophal": 0, "schlecht": 1, "maessig": 2, "mäßig": 2, "befriedigend": 2, "mittel": 3, "gut": 4, "sehr gut": 5}


def lookup(c: Column, table: dict, otherwise: Column | None = None) -> Column:
    out = F.lit(None) if otherwise is None else otherwise
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def ja_nein(c: Column) -> Column:
    """ja is true, nein false, in any case and between white space; anything else null."""
    t = F.lower(trimmed(c))
    return F.when(t == "ja", True).when(t == "nein", False)


def percentage(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), "%", "").try_cast("double") / 100


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").try_cast("double")


def object_type(c: Column) -> Column:
    t = F.lower(trimmed(c))
    out = F.lit(None).cast("string")
    for parts, name in reversed(OBJECT_TYPES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(t, F.lit(p))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def condition(c: Column) -> Column:
    return lookup(F.lower(trimmed(c)), CONDITIONS).cast("int")


def offer_object(c: Column) -> Column:
    return lookup(c, OFFER_OBJECT, F.when(F.contains(c, F.lit("Whg")), "Eigentumswohnung"))


def furnishing_grade(c: Column) -> Column:
    """The grade of a furnishing text such as `mittel (Stufe 3)`."""
    return F.regexp_extract(c, r"\(Stufe ([2-5])\)$", 1).try_cast("int")


def house_number(c: Column) -> Column:
    return F.concat(F.lit("0"), F.regexp_extract(c, "^[0-9]*", 0)).cast("int")


def run_number(c: Column) -> Column:
    """The last run of digits in a name."""
    return F.regexp_extract(c, r"(\d+)\D*$", 1).try_cast("int")


# ------------------------------------------------------------------ derived values
def sqm_price(prefix: str = "") -> Column:
    return F.try_divide(F.col(prefix + "marktwert"), F.col(prefix + "wohnflaeche"))


def object_category(prefix: str = "") -> Column:
    return lookup(F.col(prefix + "objektunterart"), OBJECT_CATEGORY).cast("int")


def is_house(prefix: str = "") -> Column:
    return F.coalesce(object_category(prefix).isin(1, 2), F.lit(False))


def steps(value: Column, bounds: list[float]) -> Column:
    """1 below the first bound, 2 below the second and so on."""
    out = F.lit(len(bounds) + 1)
    for i, b in reversed(list(enumerate(bounds, 1))):
        out = F.when(value < b, i).otherwise(out)
    return F.when(value.isNotNull(), out)


def fictitious_year(prefix: str = "") -> Column:
    """The valuation year minus the years of use that are already spent."""
    return F.year(F.col(prefix + "wertermittlungsstichtag")) - (F.col(prefix + "gesamtnutzungsdauer") - F.col(prefix + "restnutzungsdauer")).cast("int")


def year_of(prefix: str = "") -> Column:
    return F.coalesce(fictitious_year(prefix), F.col(prefix + "baujahr").cast("int"))


def year_category(prefix: str = "") -> Column:
    return steps(year_of(prefix), [1919, 1949, 1974, 1990])


def area_category(prefix: str = "") -> Column:
    c, v = object_category(prefix), F.col(prefix + "wohnflaeche")
    return F.when(v.isNull(), None).when(c.isin(1, 2), steps(v, [100, 150])).when(c == 3, steps(v, [40, 90])).otherwise(0)


def lot_category(prefix: str = "") -> Column:
    v = F.col(prefix + "grundstuecksgroesse")
    return F.when(v.isNull(), None).when(object_category(prefix).isin(1, 2), steps(v, [250, 500, 750, 1000, 1500])).otherwise(0)


def location_score(prefix: str = "") -> Column:
    macro = (F.col(prefix + "macro_social_status") + F.col(prefix + "macro_economic_status") + F.col(prefix + "macro_market_dynamics")) / 3
    return (F.col(prefix + "micro_all") + macro) / 2


def squared_distance(a: str, b: str) -> Column:
    dx, dy = F.col(a + "x") - F.col(b + "x"), F.col(a + "y") - F.col(b + "y")
    return dx * dx + dy * dy


def significant(c: Column, digits: int = 3) -> Column:
    """Rounded to significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def hash_byte(seed: str, c: Column) -> Column:
    """First byte of sha256(seed) xor first byte of sha256(id), the key of the deterministic split."""
    first = lambda x: F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 2), 16, 10).cast("int")
    return first(F.lit(seed)).bitwiseXOR(first(c))
