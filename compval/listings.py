"""The derived `listings` table over orders, customer and nation, the base of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column by column, in the SQL that Spark and DuckDB share; integer arithmetic only, hence equal in both.
COLUMNS = {
    "id": "lpad(CAST(o.o_orderkey AS VARCHAR(24)), 24, '0')",
    "marktwert": "o.o_totalprice",
    "wohnflaeche": "CAST(20 + (o.o_orderkey * 37) % 181 AS DOUBLE)",
    "x": "CAST((o.o_orderkey * 7919 + o.o_custkey * 1013) % 200000 AS DOUBLE)",
    "y": "CAST((o.o_orderkey * 104729 + o.o_custkey * 31337) % 200000 AS DOUBLE)",
    "wertermittlungsstichtag": "CAST(o.o_orderdate + INTERVAL 17 YEARS AS DATE)",
    "baujahr": "CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1900 + (o.o_custkey * 13) % 121 AS INT) END",
    "grundstuecksgroesse": "CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST((o.o_orderkey * 53) % 1800 AS DOUBLE) END",
    "zustand": "CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_custkey % 6 AS INT) END",
    "ausstattung": "CAST(1 + o.o_custkey % 5 AS INT)",
    "objektunterart": "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Eigentumswohnung' WHEN '2-HIGH' THEN 'Einfamilienhaus' WHEN '3-MEDIUM' THEN 'Doppelhaushaelfte' WHEN '5-LOW' THEN 'Mehrfamilienhaus' ELSE 'Reihenhaus' END",
    "anzahl_stellplaetze": "CAST(o.o_orderkey % 4 AS INT)",
    "anzahl_zimmer": "CAST(1 + o.o_orderkey % 8 AS DOUBLE)",
    "keller": "(o.o_custkey % 2 = 0)",
    "regiotyp": "CASE WHEN o.o_custkey % 17 = 0 THEN NULL ELSE CAST(o.o_custkey % 20 AS INT) END",
    "balcony_area": "CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST((o.o_orderkey * 29) % 30 AS DOUBLE) END",
    "walking_distance": "CAST((o.o_custkey * 71) % 5000 AS DOUBLE)",
    "urbanity_score": "CAST(1 + o.o_custkey % 4 AS INT)",
    "floor_no": "CAST(o.o_orderkey % 30 AS DOUBLE)",
    "plz": "lpad(CAST((o.o_custkey * 7) % 100000 AS VARCHAR(5)), 5, '0')",
    "ags0": "lpad(CAST(c.c_nationkey AS VARCHAR(5)), 5, '0')",
    "prefecture": "n.n_name",
    "plr_berlin": "lpad(CAST(o.o_custkey % 50 AS VARCHAR(9)), 9, '0')",
}

#: The same for an oracle string.
SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    joined = read("orders").alias("o").join(read("customer").alias("c"), F.expr("o.o_custkey = c.c_custkey")).join(read("nation").alias("n"), F.expr("c.c_nationkey = n.n_nationkey"))
    return joined.select(*[F.expr(sql).alias(name) for name, sql in COLUMNS.items()])
