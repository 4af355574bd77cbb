"""The layers of this engine derived from the provided tables, as SQL both Spark and the checking engine understand.

Numbers are written with an exponent so that both compute in doubles; positions come from integer hashing of the keys.
About one point in eight falls outside the study area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.crs import with_crs
from ..settings import STORAGE_CRS


def _position(key: str, a: int, b: int) -> str:
    return (
        f"34.69E0+CAST(({key}*{a})%100003 AS DOUBLE)/100003.0E0*0.27E0 AS lon, "
        f"31.89E0+CAST(({key}*{b})%99991 AS DOUBLE)/99991.0E0*0.32E0 AS lat"
    )


TRANSACTIONS = f"""
SELECT o_orderkey AS txn_id, n_name AS neighborhood, o_totalprice*20.0E0 AS transaction_price,
  CASE WHEN o_orderkey%53=0 THEN NULL ELSE 2.0E0+(o_orderkey%7)*0.5E0 END AS rooms,
  CASE WHEN o_orderkey%97=0 THEN 0.0E0 ELSE 30.0E0+(o_orderkey%121) END AS area_m2,
  {_position("o_orderkey", 7919, 104729)}
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey"""

TRANSIT_STOPS = f"""
SELECT c_custkey AS stop_id, c_name AS stop_name,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'rail' WHEN 'BUILDING' THEN 'light_rail' ELSE 'bus' END AS stop_type,
  {_position("c_custkey", 15485863, 32452843)}
FROM customer"""

PARKS = f"""
SELECT s_suppkey AS park_id, s_name AS name, {_position("s_suppkey", 49979687, 67867967)}
FROM supplier"""

ZONES = """
SELECT n_nationkey, n_name AS name,
  34.70E0+(n_nationkey%5)*0.05E0+0.005E0 AS x0, 34.70E0+(n_nationkey%5)*0.05E0+0.045E0 AS x1,
  31.90E0+CAST(FLOOR(n_nationkey/5) AS INT)*0.06E0+0.005E0 AS y0,
  31.90E0+CAST(FLOOR(n_nationkey/5) AS INT)*0.06E0+0.055E0 AS y1
FROM nation"""

# One small district per customer, overlapping where customers sit close together.
DISTRICTS = f"""
SELECT c_custkey AS district_id, c_name AS name,
  lon-0.0015E0-0.0001E0*(c_custkey%17) AS x0, lon+0.0015E0+0.0001E0*(c_custkey%13) AS x1,
  lat-0.0015E0-0.0001E0*(c_custkey%11) AS y0, lat+0.0015E0+0.0001E0*(c_custkey%7) AS y1
FROM (SELECT c_custkey, c_name, {_position("c_custkey", 15485863, 32452843)} FROM customer) AS placed"""

# One footprint per part; every 41st crosses itself and is invalid.
FOOTPRINTS = f"""
SELECT p_partkey AS park_id, p_name AS name, p_partkey%41=0 AS twisted,
  lon AS x0, lon+0.0001E0*(1+p_size) AS x1, lat AS y0, lat+0.0001E0*(1+p_partkey%37) AS y1
FROM (SELECT p_partkey, p_name, p_size, {_position("p_partkey", 86028121, 122949823)} FROM part) AS placed"""

# Raw deal records as the open-data feed delivers them: every value is text, some of it unusable.
DEALS = """
SELECT o_orderkey AS deal_id,
  CASE n_nationkey%5 WHEN 0 THEN 'תל אביב-יפו' WHEN 1 THEN 'רמת גן' WHEN 2 THEN 'חולון' WHEN 3 THEN 'הרצליה'
    ELSE 'חיפה' END AS CITYNAME,
  CASE WHEN o_orderkey%29=0 THEN 'n/a' ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR(20)) END AS DEALAMOUNT,
  CASE WHEN o_orderkey%31=0 THEN NULL ELSE CAST(o_orderkey%143 AS VARCHAR(20)) END AS AREA,
  CASE WHEN o_orderkey%5=0 THEN NULL ELSE CAST(o_orderkey%6 AS VARCHAR(20)) END AS ASSETROOMNUM,
  CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderpriority END AS FULLADRESS
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey"""

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders")


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Evaluate one of the statements above on a folder of tables."""
    used = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in SOURCES if t in sql}
    # the session's formatter would read {name} as a table, and the statements hold none but these
    for t in sorted(used, key=len, reverse=True):
        used[t].createOrReplaceTempView(f"zonewise_{t}")
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM zonewise_{t}").replace(f"JOIN {t}", f"JOIN zonewise_{t}")
    return spark.sql(sql)


def _pentagon() -> G.Column:
    """Five corners with a notch in the upper right, so that the box alone gives wrong answers."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    corners = [(x0, y0), (x1, y0), (x1, (y0 + y1) / 2), ((x0 + x1) / 2, y1), (x0, y1)]
    return G.polygon(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def _footprint() -> G.Column:
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    plain = F.array(corner(x0, y0), corner(x1, y0), corner((x0 + x1) / 2, y1), corner(x0, y1))
    twisted = F.array(corner(x0, y0), corner(x1, y1), corner(x1, y0), corner(x0, y1))
    return G.polygon(F.when(F.col("twisted"), twisted).otherwise(plain))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return with_crs(run(spark, folder, TRANSACTIONS), STORAGE_CRS)


def transit_stops(spark: SparkSession, folder: str) -> DataFrame:
    return with_crs(run(spark, folder, TRANSIT_STOPS), STORAGE_CRS)


def parks(spark: SparkSession, folder: str) -> DataFrame:
    return with_crs(run(spark, folder, PARKS), STORAGE_CRS)


def zones(spark: SparkSession, folder: str, shift: float = 0.0) -> DataFrame:
    """Zone polygons; ``shift`` moves them, to lay a second layer over the first."""
    z = run(spark, folder, ZONES)
    if shift:
        z = z.withColumns({c: F.col(c) + F.lit(shift) for c in ("x0", "x1", "y0", "y1")})
    z = z.select("n_nationkey", "name", _pentagon().alias("geometry"))
    return with_crs(z, STORAGE_CRS)


def districts(spark: SparkSession, folder: str) -> DataFrame:
    d = run(spark, folder, DISTRICTS).select("district_id", "name", _pentagon().alias("geometry"))
    return with_crs(d, STORAGE_CRS)


def footprints(spark: SparkSession, folder: str) -> DataFrame:
    f = run(spark, folder, FOOTPRINTS).select("park_id", "name", _footprint().alias("geometry"))
    return with_crs(f, STORAGE_CRS)


def deals(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, DEALS)
