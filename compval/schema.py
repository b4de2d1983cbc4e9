"""Columns of a listing record and the order of its feature vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 22 slots of the feature vector; the price is not among them.
FEATURES = [
    "baujahr",
    "wohnflaeche",
    "zustand",
    "grundstuecksgroesse",
    "anzahl_stellplaetze",
    "x",
    "y",
    "regiotyp",
    "micro_all",
    "micro_education_and_work",
    "micro_leisure",
    "micro_public_transport",
    "micro_shopping",
    "restnutzungsdauer",
    "balcony_area",
    "convenience_store_distance",
    "distance_elem_school",
    "distance_jun_highschool",
    "distance_parking",
    "walking_distance",
    "urbanity_score",
    "floor_no",
]

#: The other columns that operators read, with their types; a table may lack any of them.
OPTIONAL = {
    "ausstattung": "int",
    "objektunterart": "string",
    "anzahl_zimmer": "double",
    "verwendung": "string",
    "keller": "boolean",
    "erbbaurecht": "boolean",
    "vermietbarkeit": "boolean",
    "verwertbarkeit": "boolean",
    "drittverwendungsfaehigkeit": "boolean",
    "gesamtnutzungsdauer": "double",
    "macro_social_status": "double",
    "macro_economic_status": "double",
    "macro_market_dynamics": "double",
    "wertermittlungsstichtag": "date",
    "plr_berlin": "string",
    "plz": "string",
    "ags0": "string",
    "prefecture": "string",
    "u": "double",
}


def completed(listings: DataFrame) -> DataFrame:
    """listings with null for every column of the full record that it lacks."""
    kinds = {**{f: "double" for f in FEATURES}, **OPTIONAL}
    return listings.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in listings.columns})


def feature_array(prefix: str = "") -> Column:
    """The feature vector: an array of 22 doubles, null where unknown."""
    return F.array(*[F.col(prefix + f).cast("double") for f in FEATURES])
