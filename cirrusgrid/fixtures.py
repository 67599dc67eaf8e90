"""Pseudo-climate views of the driver's tables, for queries and their DuckDB counterparts.

Observation sites and days come from events, a coarse grid of ten columns from lineitem and supplier, a fine grid of
forty columns from part; a coarse cell covers five rows and four columns of fine ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ready

VIEWS = {
    "v_obs": """SELECT user_id AS cell, CAST(floor(user_id/10) AS INT)+1 AS row_, CAST(user_id % 10 AS INT)+1 AS col_, ts,
        value*0.08-5 AS tc, event_type FROM events""",
    "v_day": """SELECT cell, row_, col_, CAST(ts AS DATE) AS d, min(tc) AS tmin, max(tc) AS tmax, avg(tc) AS tmean, count(*) AS n
        FROM v_obs GROUP BY cell, row_, col_, CAST(ts AS DATE)""",
    "v_coarse": """SELECT l_suppkey AS cell, CAST(floor(l_suppkey/10) AS INT)+1 AS row_, CAST(l_suppkey % 10 AS INT)+1 AS col_,
        CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS prec, avg(l_discount)*100 AS windspeed,
        max(l_extendedprice) % 360 AS winddir, least(100.0, 40+avg(l_tax)*500) AS relhum, 95+avg(l_discount)*50 AS pres
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "v_dtmc": """SELECT s_suppkey AS cell, CAST(floor(s_suppkey/10) AS INT)+1 AS row_, CAST(s_suppkey % 10 AS INT)+1 AS col_,
        CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal/10 END AS elev FROM supplier""",
    "v_dtmf": """SELECT p_partkey AS cell, CAST(floor(p_partkey/40) AS INT)+1 AS row_, CAST(p_partkey % 40 AS INT)+1 AS col_,
        CASE WHEN p_size <= 5 THEN NULL ELSE (p_retailprice-900)*10 END AS elev FROM part""",
}
NEEDS = {"v_obs": "events", "v_day": "v_obs", "v_coarse": "lineitem", "v_dtmc": "supplier", "v_dtmf": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of sf_dir, as a DataFrame."""
    if name not in VIEWS:
        return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    need = NEEDS[name]
    return spark.sql(VIEWS[name].replace(f"FROM {need}", "FROM {source}"), source=view(spark, sf_dir, need))


def sql(body: str) -> str:
    """body with the views it names before it."""
    used = [n for n in VIEWS if n in body or (n == "v_obs" and "v_day" in body)]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + (", " if body.startswith("-- with\n") else " ") + body.removeprefix("-- with\n") if used else body
