"""The catalogue's queries once more as plain SQL, written independently for checking."""

from __future__ import annotations

import math

from ..functions import projection as P
from ..operators import recommend
from ..settings import SCENARIOS
from ..sources.open_data import DEFAULT_CENTRE, PLACES
from . import tables as T
from .catalog import SCENARIO_COLUMNS

SQL: dict[str, str] = {}


def statement(parts: dict[str, str], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + f"\n{final}"


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def half_even(expr: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round_even(CAST({expr} AS DOUBLE), 0)"
    return f"round_even(({expr}) * {10**digits}.0E0, 0) / {10**digits}.0E0"


def projected(source: str, out: str) -> dict[str, str]:
    """CTEs that add metric x, y to a source with lon, lat."""
    e = num(P.ECCENTRICITY)
    x = " + ".join(f"{num(a)} * cos({2 * j}.0E0 * xi) * sinh({2 * j}.0E0 * eta)" for j, a in enumerate(P.ALPHA, 1))
    y = " + ".join(f"{num(a)} * sin({2 * j}.0E0 * xi) * cosh({2 * j}.0E0 * eta)" for j, a in enumerate(P.ALPHA, 1))
    return {
        f"{out}_1": f"SELECT *, sin(radians(lat)) AS sn, radians(lon - {num(P.LON_ORIGIN)}) AS dl FROM {source}",
        f"{out}_2": f"SELECT *, sinh(atanh(sn) - {e} * atanh({e} * sn)) AS t FROM {out}_1",
        f"{out}_3": f"SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM {out}_2",
        out: f"SELECT * EXCLUDE (sn, dl, t, xi, eta), {num(P.FALSE_EASTING)} + {num(P.RADIUS)} * (eta + {x}) AS x, "
        f"{num(P.FALSE_NORTHING)} + {num(P.RADIUS)} * (xi + {y} - {num(P.ORIGIN_XI)}) AS y FROM {out}_3",
    }


def unprojected(source: str, out: str) -> dict[str, str]:
    """CTEs that add lon, lat to a source with metric x, y."""
    u = " - ".join(f"{num(b)} * sin({2 * j}.0E0 * xi) * cosh({2 * j}.0E0 * eta)" for j, b in enumerate(P.BETA, 1))
    v = " - ".join(f"{num(b)} * cos({2 * j}.0E0 * xi) * sinh({2 * j}.0E0 * eta)" for j, b in enumerate(P.BETA, 1))
    phi = " + ".join(f"{num(d)} * sin({2 * j}.0E0 * chi)" for j, d in enumerate(P.DELTA, 1))
    return {
        f"{out}_1": f"SELECT *, (y - {num(P.FALSE_NORTHING)}) / {num(P.RADIUS)} + {num(P.ORIGIN_XI)} AS xi, "
        f"(x - {num(P.FALSE_EASTING)}) / {num(P.RADIUS)} AS eta FROM {source}",
        f"{out}_2": f"SELECT *, xi - {u} AS u, eta - {v} AS v FROM {out}_1",
        f"{out}_3": f"SELECT *, asin(sin(u) / cosh(v)) AS chi FROM {out}_2",
        out: f"SELECT * EXCLUDE (xi, eta, u, v, chi), {num(P.LON_ORIGIN)} + degrees(atan2(sinh(v), cos(u))) AS lon, "
        f"degrees(chi + {phi}) AS lat FROM {out}_3",
    }


IN_BOX = "lon > 34.70E0 AND lon < 34.95E0 AND lat > 31.90E0 AND lat < 32.20E0"
POLY_IN_BOX = "x0 >= 34.70E0 AND x1 <= 34.95E0 AND y0 >= 31.90E0 AND y1 <= 32.20E0"
TX = {"tx": T.TRANSACTIONS}
CLEAN = {
    **TX,
    "clean": f"""SELECT *, {half_even("transaction_price / area_m2")} AS price_per_m2,
      {half_even("ln(1 + transaction_price)", 6)} AS log_price FROM tx
      WHERE {IN_BOX} AND neighborhood IN (SELECT n_name FROM nation)
        AND transaction_price > 200000 AND transaction_price < 100000000 AND area_m2 > 0""",
}
ZONES = {"zones": T.ZONES}
DISTRICTS = {"districts": T.DISTRICTS}
FOOTPRINTS = {"footprints": T.FOOTPRINTS, "sound": "SELECT * FROM footprints WHERE NOT twisted"}


def corners(source: str, key: str, out: str) -> dict[str, str]:
    """Five-cornered polygons as numbered vertices."""
    return {
        out: f"""SELECT {key}, i,
      CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 WHEN 3 THEN (x0 + x1) / 2 ELSE x0 END AS lon,
      CASE i WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN (y0 + y1) / 2 WHEN 3 THEN y1 ELSE y1 END AS lat
      FROM {source}, range(5) AS r(i)"""
    }


FOOT_CORNERS = {
    "foot_corners": """SELECT park_id, i,
      CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN (x0 + x1) / 2 ELSE x0 END AS lon,
      CASE i WHEN 0 THEN y0 WHEN 1 THEN y0 ELSE y1 END AS lat FROM sound, range(4) AS r(i)"""
}


def edges(source: str, key: str, n: int, out: str, x: str = "lon", y: str = "lat") -> dict[str, str]:
    return {
        out: f"""SELECT a.{key}, a.{x} AS ax, a.{y} AS ay, b.{x} AS b_x, b.{y} AS b_y
      FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND b.i = (a.i + 1) % {n}"""
    }


def moments(source: str, key: str, n: int, out: str) -> dict[str, str]:
    """Area and centroid of single-ring polygons from projected vertices."""
    return {
        f"{out}_o": f"SELECT {key}, x AS ox, y AS oy FROM {source} WHERE i = 0",
        **edges(source, key, n, f"{out}_e", "x", "y"),
        f"{out}_c": f"""SELECT e.{key}, ox, oy, ax - ox AS px, ay - oy AS py, b_x - ox AS qx, b_y - oy AS qy
      FROM {out}_e e JOIN {out}_o o ON e.{key} = o.{key}""",
        out: f"""SELECT {key}, abs(sum(px * qy - qx * py)) / 2 AS area,
      any_value(ox) + sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS x,
      any_value(oy) + sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS y
      FROM {out}_c GROUP BY {key}""",
    }


def inside(points: str, pkey: str, polys: str, key: str, edge: str, out: str) -> dict[str, str]:
    """Pairs of points and five-cornered polygons by ray casting; no point of the data lies on an edge."""
    return {
        f"{out}_near": f"SELECT {pkey}, {key}, lon, lat FROM {points} JOIN {polys} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1",
        out: f"""SELECT {pkey}, n.{key} FROM {out}_near n JOIN {edge} e ON n.{key} = e.{key}
      WHERE (ay > lat) <> (b_y > lat) AND lon < ax + (lat - ay) / (b_y - ay) * (b_x - ax)
      GROUP BY {pkey}, n.{key} HAVING count(*) % 2 = 1""",
    }


ROUNDED_STATS = f"""{half_even("avg(transaction_price)")} AS avg_price,
  {half_even("quantile_cont(transaction_price, 0.5)")} AS median_price, {half_even("avg(price_per_m2)")} AS avg_price_per_m2,
  count(transaction_price) AS transaction_count, {half_even("avg(rooms)")} AS avg_rooms, {half_even("avg(area_m2)")} AS avg_area_m2"""


def stats(source: str, by: str, out: str = "stats") -> dict[str, str]:
    return {
        out: f"""SELECT {by} AS name, {ROUNDED_STATS} FROM {source} WHERE {by} IS NOT NULL
      GROUP BY {by} HAVING count(transaction_price) >= 3"""
    }


# cleaning
SQL["clean_transactions"] = statement(CLEAN, "SELECT * FROM clean")
STOPS = {"stops_raw": T.TRANSIT_STOPS, "stops": f"SELECT * FROM stops_raw WHERE {IN_BOX}"}
SQL["clean_stops"] = statement(STOPS, "SELECT * FROM stops")
SQL["clean_stops_without_type"] = statement(STOPS, "SELECT stop_id, stop_name, lon, lat, 'unknown' AS stop_type FROM stops")
CENTRED = {
    **FOOTPRINTS,
    **FOOT_CORNERS,
    **projected("foot_corners", "foot_m"),
    **moments("foot_m", "park_id", 4, "foot"),
}
SQL["clean_parks"] = statement(
    {**CENTRED, **unprojected("foot", "foot_ll")},
    f"""SELECT f.park_id, name, {half_even("lon", 6)} AS lon, {half_even("lat", 6)} AS lat
    FROM sound f JOIN foot_ll c ON f.park_id = c.park_id WHERE {POLY_IN_BOX}""",
)
SQL["clean_zones"] = "SELECT n_nationkey, n_name AS name FROM nation"
SQL["clip_polygons"] = statement(FOOTPRINTS, f"SELECT park_id FROM footprints WHERE {POLY_IN_BOX}")
SQL["keep_known"] = statement(
    TX,
    """SELECT txn_id, neighborhood FROM tx WHERE neighborhood IN
    (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 0)""",
)
SQL["clip_group_percentiles"] = statement(
    {
        **CLEAN,
        "q": """SELECT neighborhood AS name, quantile_cont(transaction_price, 0.01) AS lo,
          quantile_cont(transaction_price, 0.99) AS hi FROM clean GROUP BY neighborhood""",
    },
    "SELECT txn_id, neighborhood, transaction_price FROM clean JOIN q ON neighborhood = name WHERE transaction_price BETWEEN lo AND hi",
)
SQL["impute_group_median"] = statement(
    {**CLEAN, "q": "SELECT neighborhood AS name, quantile_cont(rooms, 0.5) AS mid FROM clean GROUP BY neighborhood"},
    "SELECT txn_id, neighborhood, coalesce(rooms, mid) AS rooms FROM clean JOIN q ON neighborhood = name",
)
SQL["dedupe"] = statement(TX, "SELECT DISTINCT neighborhood, rooms, area_m2 FROM tx")

# statistics
SQL["zone_stats"] = statement({**CLEAN, **stats("clean", "neighborhood")}, "SELECT * FROM stats")
ZONE_EDGES = {**ZONES, **corners("zones", "name", "zone_corners"), **edges("zone_corners", "name", 5, "zone_edges")}
SQL["zone_stats_by_polygon"] = statement(
    {
        **CLEAN,
        **ZONE_EDGES,
        **inside("clean", "txn_id", "zones", "name", "zone_edges", "hit"),
        "located": "SELECT c.*, h.name AS zone FROM clean c JOIN hit h ON c.txn_id = h.txn_id",
        **stats("located", "zone"),
    },
    "SELECT * FROM stats",
)


def summary(value: str, digits: int) -> str:
    q = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    shown = {"mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})"}
    shown |= {n: f"quantile_cont({value}, {p})" for n, p in q.items()} | {"max": f"max({value})"}
    return f"count({value}) AS count, " + ", ".join(f"{half_even(e, digits)} AS {n}" for n, e in shown.items())


SQL["describe_by_zone"] = statement(
    TX, f"SELECT 'transaction_price' AS \"column\", neighborhood, {summary('transaction_price', 0)} FROM tx GROUP BY neighborhood"
)
SQL["describe_columns"] = statement(
    TX,
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {summary(c, 1)} FROM tx" for c in ("transaction_price", "rooms", "area_m2")
    ),
)
SQL["value_counts"] = statement(STOPS, "SELECT stop_type, count(*) AS count FROM stops_raw GROUP BY stop_type")
SQL["area_average"] = statement(
    {**CLEAN, **stats("clean", "neighborhood")}, f"SELECT {half_even('avg(avg_price)', 2)} AS area_average FROM stats"
)
SQL["column_profile"] = statement(
    TX,
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, min({c}) AS min, {half_even(f'avg({c})', 1)} AS mean, max({c}) AS max FROM tx"
        for c in ("transaction_price", "rooms", "area_m2")
    ),
)

# geometry
SQL["project_metric"] = statement(
    {**TX, **projected("tx", "p")}, f"SELECT txn_id, {half_even('x', 2)} AS x, {half_even('y', 2)} AS y FROM p"
)
SQL["unproject_round_trip"] = statement(TX, "SELECT txn_id, true AS same_place FROM tx")
SQL["polygon_area"] = statement(CENTRED, f"SELECT park_id, {half_even('area')} AS area_m2 FROM foot")
SQL["polygon_centroid"] = statement(CENTRED, f"SELECT park_id, {half_even('x', 1)} AS x, {half_even('y', 1)} AS y FROM foot")
SQL["polygon_validity"] = statement(FOOTPRINTS, "SELECT park_id, NOT twisted AS valid FROM footprints")
SQL["polygon_bounds"] = statement(
    FOOTPRINTS,
    "SELECT park_id, " + ", ".join(
        f"{half_even(c, 6)} AS {n}" for c, n in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))
    ) + " FROM footprints",
)

# joins
TX_IN_ZONES = {**TX, **ZONE_EDGES, **inside("tx", "txn_id", "zones", "name", "zone_edges", "hit")}
SQL["points_in_zones"] = statement(
    TX_IN_ZONES, "SELECT tx.txn_id, h.name AS neighborhood_polygon FROM tx LEFT JOIN hit h ON tx.txn_id = h.txn_id"
)
DISTRICT_EDGES = {
    **DISTRICTS,
    **corners("districts", "district_id", "district_corners"),
    **edges("district_corners", "district_id", 5, "district_edges"),
}
TX_IN_DISTRICTS = {
    **TX,
    **DISTRICT_EDGES,
    **inside("tx", "txn_id", "districts", "district_id", "district_edges", "hit"),
    "located": """SELECT tx.txn_id, d.name AS neighborhood_polygon FROM tx
      LEFT JOIN hit h ON tx.txn_id = h.txn_id LEFT JOIN districts d ON h.district_id = d.district_id""",
}
SQL["points_in_districts"] = statement(TX_IN_DISTRICTS, "SELECT * FROM located")
SQL["join_report"] = statement(
    TX_IN_DISTRICTS,
    """SELECT count(*) AS n_rows, count(*) - count(neighborhood_polygon) AS n_unmatched,
    count(DISTINCT neighborhood_polygon) AS n_zones FROM located""",
)
SQL["overlap_fanout"] = statement(
    {
        **TX,
        "base": T.ZONES,
        "zones": """SELECT n_nationkey AS zone_id, name, x0, x1, y0, y1 FROM base UNION ALL
          SELECT n_nationkey + 1000, name, x0 + 0.02E0, x1 + 0.02E0, y0 + 0.02E0, y1 + 0.02E0 FROM base""",
        **corners("zones", "zone_id", "zone_corners"),
        **edges("zone_corners", "zone_id", 5, "zone_edges"),
        **inside("tx", "txn_id", "zones", "zone_id", "zone_edges", "hit"),
    },
    """SELECT tx.txn_id, z.name AS neighborhood_polygon FROM tx LEFT JOIN hit h ON tx.txn_id = h.txn_id
    LEFT JOIN zones z ON h.zone_id = z.zone_id""",
)
SQL["spatial_join_within"] = statement(
    {**STOPS, **ZONE_EDGES, **inside("stops_raw", "stop_id", "zones", "name", "zone_edges", "hit")}, "SELECT stop_id, name FROM hit"
)
PARKS = {"parks_raw": T.PARKS, "parks": f"SELECT * FROM parks_raw WHERE {IN_BOX}"}
PARKS_IN_DISTRICTS = {
    **PARKS,
    **DISTRICT_EDGES,
    **inside("parks_raw", "park_id", "districts", "district_id", "district_edges", "hit"),
}
SQL["spatial_join_contains"] = statement(
    PARKS_IN_DISTRICTS, "SELECT d.district_id, h.park_id FROM districts d LEFT JOIN hit h ON d.district_id = h.district_id"
)
SQL["spatial_join_right"] = statement(
    PARKS_IN_DISTRICTS, "SELECT h.district_id, p.park_id FROM parks_raw p LEFT JOIN hit h ON p.park_id = h.park_id"
)


def side(a: str, b: str, c: str) -> str:
    """Orientation of point c (x,y names) against the line a to b."""
    (ax, ay), (bx, by), (cx, cy) = (p.split(",") for p in (a, b, c))
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_A, _B = ("d.ax,d.ay", "d.b_x,d.b_y"), ("z.ax,z.ay", "z.b_x,z.b_y")
PAIRS = {
    **DISTRICT_EDGES,
    "zones": T.ZONES,
    **corners("zones", "n_nationkey", "zone_corners"),
    **edges("zone_corners", "n_nationkey", 5, "zone_edges"),
    "near": """SELECT d.district_id, z.n_nationkey FROM districts d JOIN zones z
      ON d.x0 <= z.x1 AND z.x0 <= d.x1 AND d.y0 <= z.y1 AND z.y0 <= d.y1""",
    "crossing": f"""SELECT DISTINCT n.district_id, n.n_nationkey FROM near n JOIN district_edges d ON n.district_id = d.district_id
      JOIN zone_edges z ON n.n_nationkey = z.n_nationkey
      WHERE {side(*_A, _B[0])} * {side(*_A, _B[1])} <= 0 AND {side(*_B, _A[0])} * {side(*_B, _A[1])} <= 0""",
    "first_corner": "SELECT district_id, lon, lat FROM district_corners WHERE i = 0",
    **inside("first_corner", "district_id", "zones", "n_nationkey", "zone_edges", "in_zone"),
    "zone_corner": "SELECT n_nationkey, lon, lat FROM zone_corners WHERE i = 0",
    **inside("zone_corner", "n_nationkey", "districts", "district_id", "district_edges", "in_district"),
}
SQL["polygons_intersect"] = statement(
    PAIRS,
    """SELECT district_id, n_nationkey FROM crossing UNION SELECT district_id, n_nationkey FROM in_zone
    UNION SELECT district_id, n_nationkey FROM in_district""",
)
SQL["polygons_within"] = statement(
    PAIRS, "SELECT district_id, n_nationkey FROM in_zone EXCEPT SELECT district_id, n_nationkey FROM crossing"
)
SQL["polygons_intersect_by_edges"], SQL["polygons_within_by_edges"] = SQL["polygons_intersect"], SQL["polygons_within"]
STOPS_M = {**STOPS, **projected("stops_raw", "stops_all_m"), **projected("stops", "stops_m")}
PARKS_M = {**PARKS, **projected("parks_raw", "parks_all_m"), **projected("parks", "parks_m")}
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
SQL["nearest_distance"] = statement(
    {**TX, **projected("tx", "tx_m"), **STOPS_M},
    f"SELECT txn_id, {half_even(f'min({DIST})', 1)} AS dist_m FROM tx_m a, stops_all_m b GROUP BY txn_id",
)
SQL["nearest_polygon"] = statement(
    {
        **STOPS_M,
        **ZONE_EDGES,
        **inside("stops_raw", "stop_id", "zones", "name", "zone_edges", "hit"),
        **projected("zone_corners", "zone_m"),
        **edges("zone_m", "name", 5, "zone_me", "x", "y"),
        "along": """SELECT stop_id, x, y, ax, ay, b_x - ax AS dx, b_y - ay AS dy,
          greatest(0, least(1, ((x - ax) * (b_x - ax) + (y - ay) * (b_y - ay)) / ((b_x - ax) * (b_x - ax) + (b_y - ay) * (b_y - ay)))) AS t
          FROM stops_all_m, zone_me""",
        "closest": """SELECT stop_id, min(sqrt((x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy))) AS d
          FROM along GROUP BY stop_id""",
    },
    f"""SELECT stop_id, CASE WHEN stop_id IN (SELECT stop_id FROM hit) THEN 0.0E0 ELSE {half_even('d', 1)} END AS dist_m FROM closest""",
)
SQL["nearest_empty_target"] = statement(STOPS, "SELECT stop_id, CAST(NULL AS DOUBLE) AS dist_m FROM stops_raw")
SQL["count_within"] = statement(
    {**TX, **projected("tx", "tx_m"), **STOPS_M},
    f"""SELECT txn_id, count(*) FILTER ({DIST} < 500) AS stops_500m, count(*) FILTER ({DIST} < 1000) AS stops_1km
    FROM tx_m a, stops_all_m b GROUP BY txn_id""",
)
_SECTOR = num(math.pi / 32)
_TURN = f"(atan2(b.y - a.y, b.x - a.x) + 2 * pi()) - floor((atan2(b.y - a.y, b.x - a.x) + 2 * pi()) / {_SECTOR}) * {_SECTOR}"
SQL["count_within_inscribed"] = statement(
    {**STOPS_M, **PARKS_M},
    f"""SELECT stop_id, greatest(1, count(*) FILTER ({DIST} * cos({_TURN} - {num(math.pi / 64)}) < {num(1000 * math.cos(math.pi / 64))})) AS parks_1km
    FROM stops_all_m a, parks_all_m b GROUP BY stop_id""",
)


def spatial(key: str, corner: str) -> dict[str, str]:
    return {
        **STOPS_M,
        **PARKS_M,
        **projected(corner, "corner_m"),
        **moments("corner_m", key, 5, "centre"),
        "by_stop": f"""SELECT a.{key}, {half_even(f'min({DIST})', 1)} AS dist_to_nearest_transit_m,
          count(*) FILTER ({DIST} < 500) AS transit_stops_500m, count(*) FILTER ({DIST} < 1000) AS transit_stops_1km
          FROM centre a, stops_m b GROUP BY a.{key}""",
        "by_park": f"""SELECT a.{key}, {half_even(f'min({DIST})', 1)} AS dist_to_nearest_park_m,
          count(*) FILTER ({DIST} < 1000) AS parks_1km FROM centre a, parks_m b GROUP BY a.{key}""",
        "spatial": f"""SELECT s.{key}, dist_to_nearest_transit_m, dist_to_nearest_park_m, transit_stops_500m,
          transit_stops_1km, parks_1km FROM by_stop s JOIN by_park p ON s.{key} = p.{key}""",
    }


ZONE_SPATIAL = {**ZONES, **corners("zones", "name", "zone_corners"), **spatial("name", "zone_corners")}
SQL["zone_spatial_features"] = statement(ZONE_SPATIAL, "SELECT * FROM spatial")
SQL["district_spatial_features"] = statement(
    {**DISTRICTS, **corners("districts", "district_id", "district_corners"), **spatial("district_id", "district_corners")},
    "SELECT * FROM spatial",
)
SQL["attach_stats"] = statement(
    {**CLEAN, **stats("clean", "neighborhood")},
    "SELECT n_nationkey, stats.* REPLACE (n_name AS name) FROM nation LEFT JOIN stats ON n_name = stats.name",
)

# scoring
ENRICHED = {
    **CLEAN,
    **stats("clean", "neighborhood"),
    **ZONE_SPATIAL,
    "enriched": "SELECT s.*, t.* EXCLUDE (name) FROM spatial s LEFT JOIN stats t ON s.name = t.name",
    "filled": """SELECT *, coalesce(avg_price, (SELECT quantile_cont(avg_price, 0.5) FROM enriched)) AS fp,
      1 / (1 + coalesce(dist_to_nearest_transit_m, (SELECT max(dist_to_nearest_transit_m) FROM enriched))) + transit_stops_500m AS ft,
      1 / (1 + coalesce(dist_to_nearest_park_m, (SELECT max(dist_to_nearest_park_m) FROM enriched))) + parks_1km AS fk FROM enriched""",
    "subscores": f"""SELECT *,
      {half_even("1 - (fp - min(fp) OVER ()) / CASE WHEN max(fp) OVER () = min(fp) OVER () THEN 1 ELSE max(fp) OVER () - min(fp) OVER () END", 4)} AS score_affordability,
      {half_even("(ft - min(ft) OVER ()) / CASE WHEN max(ft) OVER () = min(ft) OVER () THEN 1 ELSE max(ft) OVER () - min(ft) OVER () END", 4)} AS score_transit,
      {half_even("(fk - min(fk) OVER ()) / CASE WHEN max(fk) OVER () = min(fk) OVER () THEN 1 ELSE max(fk) OVER () - min(fk) OVER () END", 4)} AS score_parks
      FROM filled""",
}


def weighted(a, t, p) -> str:
    return half_even(f"(score_affordability * {a}E0 + score_transit * {t}E0 + score_parks * {p}E0) * 100.0E0", 1)


def scored(a=0.4, t=0.35, p=0.25) -> dict[str, str]:
    return {
        **ENRICHED,
        "weighted": f"SELECT *, {weighted(a, t, p)} AS neighborhood_score FROM subscores",
        "scored": 'SELECT *, CAST(rank() OVER (ORDER BY neighborhood_score DESC) AS INTEGER) AS "rank" FROM weighted',
    }


SCORED = scored()
_SCORES = 'name, score_affordability, score_transit, score_parks, neighborhood_score, "rank"'
SQL["score_zones"] = statement(SCORED, f"SELECT {_SCORES} FROM scored")
SQL["score_percent_weights"] = statement(scored(0.2, 0.6, 0.2), f"SELECT {_SCORES} FROM scored")
SQL["rank_zones"] = statement(
    {"s": f"SELECT c_custkey, {half_even('c_acctbal / 100.0E0', 1)} AS score FROM customer"},
    'SELECT c_custkey, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS "rank" FROM s',
)
SQL["budget_filter"] = statement(SCORED, 'SELECT name, avg_price, "rank" FROM scored WHERE avg_price <= 5000000')
SQL["budget_fallback"] = statement(SCORED, 'SELECT name, avg_price, "rank" FROM scored')
SQL["weight_scenarios"] = statement(
    ENRICHED,
    " UNION ALL ".join(
        f"SELECT name, '{n}' AS scenario, {weighted(*w)} AS neighborhood_score FROM subscores" for n, w in SCENARIOS.items()
    ),
)
SQL["scenario_pivot"] = statement(
    ENRICHED, "SELECT name, " + ", ".join(f"{weighted(*w)} AS {SCENARIO_COLUMNS[n]}" for n, w in SCENARIOS.items()) + " FROM subscores"
)


# validation
def findings(checks: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{s}' AS severity, CAST({n} AS BIGINT) AS n_bad" for c, s, n in checks)


def generic(source: str, invalid: str = "0", outside: str = "0") -> list[tuple[str, str, str]]:
    return [
        ("empty", "error", f"(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {source})"),
        ("crs", "error", "0"),
        ("required_columns", "error", "0"),
        ("invalid_geometry", "warning", invalid),
        ("null_geometry", "error", "0"),
        ("geometry_type", "warning", "0"),
        ("country_bounds", "warning", outside),
    ]


SQL["validate_transactions"] = statement(
    TX,
    findings(
        generic("tx")
        + [
            ("null_price", "error", "(SELECT count(*) - count(transaction_price) FROM tx)"),
            ("price_range", "warning", "(SELECT count(*) FROM tx WHERE transaction_price < 200000 OR transaction_price > 100000000)"),
            ("area", "warning", "(SELECT count(*) FROM tx WHERE area_m2 IS NULL OR area_m2 <= 0)"),
            ("unknown_names", "warning", "(SELECT count(*) FROM tx WHERE neighborhood = (SELECT min(n_name) FROM nation))"),
        ]
    ),
)
SQL["validate_zones"] = statement(
    {"both_layers": "SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation"},
    findings(
        generic("both_layers")
        + [
            ("duplicate_names", "error", "(SELECT count(*) - count(DISTINCT name) FROM both_layers)"),
            ("unknown_names", "warning", "0"),
            ("missing_zones", "warning", "1"),
        ]
    ),
)
SQL["validate_stops"] = statement(STOPS, findings(generic("stops_raw")))
SQL["validate_parks"] = statement(FOOTPRINTS, findings(generic("footprints", "(SELECT count(*) FROM footprints WHERE twisted)")))
SQL["missing_zones"] = "SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0"
SQL["duplicate_zones"] = statement(
    FOOTPRINTS, "SELECT name, count(*) - 1 AS surplus FROM footprints GROUP BY name HAVING count(*) > 1"
)


def profile(source: str, label: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"""SELECT '{label}' AS layer, 'EPSG:4326' AS crs, count(*) AS n_rows, {half_even(f'min({x0})', 4)} AS min_lon,
      {half_even(f'min({y0})', 4)} AS min_lat, {half_even(f'max({x1})', 4)} AS max_lon, {half_even(f'max({y1})', 4)} AS max_lat FROM {source}"""


SQL["layer_profile"] = statement(
    {**TX, **FOOTPRINTS},
    profile("tx", "transactions", "lon", "lat", "lon", "lat") + " UNION ALL " + profile("footprints", "footprints", "x0", "y0", "x1", "y1"),
)

# reports
SQL["kpis"] = statement(
    SCORED,
    f"""SELECT count(*) AS n_zones, (SELECT name FROM scored ORDER BY neighborhood_score DESC, name LIMIT 1) AS top_zone,
    max(neighborhood_score) AS top_score, min(avg_price) AS min_avg_price, {half_even("avg(neighborhood_score)", 1)} AS avg_score FROM scored""",
)
SQL["top_k"] = statement(SCORED, 'SELECT "rank", name, neighborhood_score FROM scored ORDER BY "rank", name LIMIT 12')
MONEY = "coalesce('₪' || format('{:,.0f}', avg_price), 'N/A')"
SQL["ranking_table"] = statement(
    SCORED,
    f"""SELECT "rank", name, printf('%.1f', neighborhood_score) AS neighborhood_score, {MONEY} AS avg_price,
    CAST(transit_stops_500m AS VARCHAR) AS transit_stops_500m, CAST(parks_1km AS VARCHAR) AS parks_1km FROM scored""",
)


def color(score: str) -> str:
    r = f"least(greatest({score} / 100.0E0, 0), 1)"
    return f"""CASE WHEN {r} < 0.5E0 THEN printf('#dc%02x00', CAST(trunc({r} * 2 * 200) AS INTEGER))
      ELSE printf('#%02xb400', CAST(trunc((1 - ({r} - 0.5E0) * 2) * 220) AS INTEGER)) END"""


BAND = "CASE WHEN {0} < 40 THEN 'low' WHEN {0} < 65 THEN 'mid' ELSE 'high' END"
SQL["map_table"] = statement(
    SCORED,
    f"""SELECT name, split_part(name, '-', 1) AS label, {color('neighborhood_score')} AS color,
    {BAND.format('neighborhood_score')} AS band, {MONEY} AS price_label, CAST(transit_stops_500m AS VARCHAR) AS stops_label,
    CAST(parks_1km AS VARCHAR) AS parks_label FROM scored""",
)
SQL["score_color"] = statement(
    {"s": f"SELECT o_orderkey, {half_even('o_totalprice / 4000.0E0', 1)} AS score FROM orders"},
    f"SELECT o_orderkey, {color('score')} AS color, {BAND.format('score')} AS band FROM s",
)
SQL["score_breakdown"] = statement(
    SCORED,
    " UNION ALL ".join(
        f"SELECT name, \"rank\", '{n}' AS component, {half_even(v + ' * 100', 1)} AS value, {half_even(o, 1)} AS \"offset\" FROM scored"
        for n, v, o in (
            ("affordability", "score_affordability", "0.0E0"),
            ("transit", "score_transit", "score_affordability * 100"),
            ("parks", "score_parks", "score_affordability * 100 + score_transit * 100"),
        )
    ),
)
PREDICTED = {
    **SCORED,
    "predicted": f"SELECT *, {half_even('neighborhood_score * 0.5E0 + transit_stops_1km * 2.0E0', 1)} AS ml_score FROM scored",
}
SQL["score_delta"] = statement(
    PREDICTED,
    f"""SELECT name, neighborhood_score, ml_score, CAST(rank() OVER (ORDER BY ml_score DESC) AS INTEGER) AS ml_rank,
    {half_even('ml_score - neighborhood_score', 1)} AS delta FROM predicted""",
)

# models
_RAW = [
    "avg_price", "avg_price_per_m2", "avg_rooms", "avg_area_m2", "transaction_count", "dist_to_nearest_transit_m",
    "dist_to_nearest_park_m", "transit_stops_500m", "transit_stops_1km", "parks_1km",
]
_ML = {
    **{c: c for c in _RAW},
    "transit_composite": "1 / (1 + dist_to_nearest_transit_m) + transit_stops_500m",
    "park_composite": "1 / (1 + dist_to_nearest_park_m) + parks_1km",
    "centroid_x": "x",
    "centroid_y": "y",
}
SQL["ml_features"] = statement(
    {
        **SCORED,
        "raw": "SELECT s.name, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _ML.items())
        + " FROM scored s JOIN centre c ON s.name = c.name",
    },
    "SELECT name, " + ", ".join(
        half_even(f"coalesce({n}, (SELECT quantile_cont({n}, 0.5) FROM raw))", 3) + f" AS {n}" for n in _ML
    ) + " FROM raw",
)
_LEFT_OUT = {
    **SCORED,
    "p": """SELECT neighborhood_score AS y,
      (sum(neighborhood_score) OVER () - neighborhood_score) / (count(*) OVER () - 1) AS pred FROM scored""",
    "baseline": f"SELECT {half_even('avg(abs(y - pred))', 2)} AS mae FROM p",
}
SQL["loo_baseline"] = statement(
    _LEFT_OUT,
    f"""SELECT 'Baseline (mean)' AS model, 'loo' AS cv, {half_even('avg(abs(y - pred))', 2)} AS mae,
    {half_even('stddev_pop(abs(y - pred))', 2)} AS mae_std,
    {half_even('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))', 3)} AS r2_pooled FROM p""",
)
# Ridge by its normal equations, for all zones together (fold '') and with every zone left out: standardise, sum up, and solve
# the small system by eliminating one column after the other. Tree ensembles have no such form, so their queries have no SQL.
_RIDGE = {
    **SCORED,
    "raw": "SELECT s.name, s.neighborhood_score AS y, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _ML.items())
    + " FROM scored s JOIN centre c ON s.name = c.name",
    "x": " UNION ALL ".join(
        f"SELECT name, y, {j} AS j, coalesce({n}, (SELECT quantile_cont({n}, 0.5) FROM raw)) AS v FROM raw" for j, n in enumerate(_ML, 1)
    ),
    "fold": "SELECT name AS fold FROM raw UNION ALL SELECT ''",
    "around": """SELECT fold, j, avg(v) AS m, CASE WHEN var_pop(v) > 1.0E-10 THEN stddev_pop(v) ELSE 1.0E0 END AS s, avg(y) AS ym
      FROM fold JOIN x ON x.name <> fold GROUP BY fold, j""",
    "z": "SELECT fold, name, j, (v - m) / s AS z, y - ym AS yc FROM around JOIN x USING (j) WHERE name <> fold",
    "gram": """SELECT a.fold, a.j AS i, b.j, sum(a.z * b.z) + CASE WHEN a.j = b.j THEN 1.0E0 ELSE 0.0E0 END AS g
      FROM z a JOIN z b ON a.fold = b.fold AND a.name = b.name GROUP BY a.fold, a.j, b.j
      UNION ALL SELECT fold, j, 99, sum(z * yc) FROM z GROUP BY fold, j""",
    "gramrow": "SELECT fold, i, list(g ORDER BY j) AS r FROM gram GROUP BY fold, i",
    "system": "SELECT fold, list(r ORDER BY i) AS m FROM gramrow GROUP BY fold",
    "solved(fold, k, m)": f"""SELECT fold, 1, m FROM system UNION ALL SELECT fold, k + 1, list_transform(m, lambda r, i:
      CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
      FROM solved WHERE k <= {len(_ML)}""",
    "beta": f"""SELECT q.fold, a.j, q.m[a.j][{len(_ML) + 1}] AS b, a.m AS mean, a.s, a.ym
      FROM solved q JOIN around a ON a.fold = q.fold WHERE q.k = {len(_ML) + 1}""",
    "foretold": """SELECT fold, name, y, ym + sum(b * (v - mean) / s) AS pred FROM beta JOIN x USING (j)
      WHERE fold = '' OR fold = name GROUP BY fold, name, y, ym""",
}
_ERRORS = f"""{half_even('avg(abs(y - pred))', 2)} AS mae, {half_even('stddev_pop(abs(y - pred))', 2)} AS mae_std,
  {half_even('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))', 3)} AS r2_pooled"""
_COMPARED = {
    **_RIDGE,
    "p": _LEFT_OUT["p"],
    "compared": f"""SELECT 'Baseline (mean)' AS model, 'loo' AS cv, {_ERRORS} FROM p
      UNION ALL SELECT 'Ridge Regression', 'loo', {_ERRORS} FROM foretold WHERE fold <> ''""",
}
_BY_RIDGE = {
    **_RIDGE,
    "predicted": f"""SELECT s.*, {half_even('least(greatest(pred, 0.0E0), 100.0E0)', 1)} AS ml_score
      FROM scored s JOIN foretold f ON f.name = s.name AND f.fold = ''""",
}
_MARKS = """SELECT quantile_cont(ml_score, 0.5) AS mid, quantile_cont(avg_price, 0.75) AS p75,
  quantile_cont(transit_stops_500m, 0.25) AS s25 FROM predicted"""
_ADVICE = f"""CASE WHEN dist_to_nearest_transit_m > 1000 THEN '{recommend.FAR_TRANSIT}'
  WHEN dist_to_nearest_park_m > 2000 THEN '{recommend.FAR_PARK}' WHEN avg_price > p75 THEN '{recommend.HIGH_PRICE}'
  WHEN transit_stops_500m < s25 THEN '{recommend.FEW_STOPS}' ELSE '{recommend.OTHER}' END"""
SQL["loo_ridge"] = statement(_RIDGE, f"SELECT name, y AS actual, {half_even('pred', 4)} AS predicted FROM foretold WHERE fold <> ''")
SQL["linear_compare"] = statement(_COMPARED, "SELECT * FROM compared")
SQL["model_improvement"] = statement(
    _COMPARED,
    f"""SELECT max(CASE WHEN model = 'Baseline (mean)' THEN mae END) AS baseline_mae, min(mae) AS best_mae,
    {half_even("max(CASE WHEN model = 'Baseline (mean)' THEN mae END) - min(mae)", 2)} AS improvement FROM compared""",
)
_RANKED = 'CAST(rank() OVER (ORDER BY ml_score DESC) AS INTEGER) AS ml_rank'
SQL["ridge_scores"] = statement(_BY_RIDGE, f"SELECT name, neighborhood_score, ml_score, {_RANKED} FROM predicted")
SQL["predictive_flow"] = statement(
    {**_BY_RIDGE, **_COMPARED, "marks": _MARKS},
    f"""SELECT name, neighborhood_score, ml_score, {_RANKED}, CASE WHEN ml_score < mid THEN {_ADVICE} END AS recommendation,
    (SELECT arg_min(model, mae) FROM compared) AS best_model FROM predicted, marks""",
)
SQL["recommendations"] = statement(
    {
        **PREDICTED,
        "marks": """SELECT quantile_cont(ml_score, 0.5) AS mid, quantile_cont(avg_price, 0.75) AS p75,
          quantile_cont(transit_stops_500m, 0.25) AS s25 FROM predicted""",
    },
    f"""SELECT name AS city, ml_score, CASE WHEN dist_to_nearest_transit_m > 1000 THEN '{recommend.FAR_TRANSIT}'
    WHEN dist_to_nearest_park_m > 2000 THEN '{recommend.FAR_PARK}' WHEN avg_price > p75 THEN '{recommend.HIGH_PRICE}'
    WHEN transit_stops_500m < s25 THEN '{recommend.FEW_STOPS}' ELSE '{recommend.OTHER}' END AS recommendation
    FROM predicted, marks WHERE ml_score < mid""",
)

# sources
_PLACES = ", ".join(f"('{l}', '{n}', {lon}E0, {lat}E0)" for l, n, lon, lat in PLACES)
DEALS = {
    "deals": T.DEALS,
    "places": f"SELECT * FROM (VALUES {_PLACES}) AS t(local_name, place, clon, clat)",
    "typed": """SELECT *, TRY_CAST(DEALAMOUNT AS DOUBLE) AS price, TRY_CAST(AREA AS DOUBLE) AS deal_area,
      TRY_CAST(ASSETROOMNUM AS DOUBLE) AS room_count FROM deals LEFT JOIN places ON CITYNAME = local_name""",
    "good": "SELECT * FROM typed WHERE price > 100000 AND deal_area > 10",
}
SQL["normalise_deals"] = statement(
    DEALS,
    f"""SELECT coalesce(FULLADRESS, '') AS address, place AS neighborhood, CAST(trunc(price) AS BIGINT) AS transaction_price,
    coalesce(room_count, 0.0E0) AS rooms, {half_even('deal_area', 1)} AS area_m2, {half_even('price / deal_area')} AS price_per_m2,
    coalesce(clon, {DEFAULT_CENTRE[0]}E0) AS lon, coalesce(clat, {DEFAULT_CENTRE[1]}E0) AS lat FROM good""",
)
SQL["geocode_jitter"] = statement(
    DEALS, "SELECT place AS neighborhood, count(*) AS n, count(*) AS n_near FROM good WHERE place IS NOT NULL GROUP BY place"
)
SQL["normalise_ways"] = statement(
    CENTRED,
    f"""SELECT CASE WHEN f.park_id % 7 = 0 THEN 'Park' ELSE name END AS name, {half_even('area')} AS area_m2
    FROM sound f JOIN foot c ON f.park_id = c.park_id WHERE f.park_id % 23 <> 0""",
)
SQL["fill_missing_zones"] = """SELECT n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 'primary' ELSE 'backup' END AS origin,
    CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS n_nationkey FROM nation"""
_AREAS = f"SELECT f.park_id, name, {half_even('area')} AS area_m2 FROM sound f JOIN foot c ON f.park_id = c.park_id"
SQL["geojson_round_trip"] = statement(CENTRED, _AREAS)
SQL["clip_written_polygons"] = SQL["clip_polygons"]
SQL["geojson_collection"] = statement(CENTRED, _AREAS)
SQL["geoparquet_round_trip"] = statement(CENTRED, _AREAS)
_PLACE = f"{half_even('lon', 6)} AS lon, {half_even('lat', 6)} AS lat"
SQL["geojson_points"] = statement(STOPS, f"SELECT stop_name, stop_type, {_PLACE} FROM stops_raw")
SQL["geoparquet_points"] = statement(TX, f"SELECT txn_id, {_PLACE} FROM tx")
SQL["csv_points"] = statement(STOPS, f"SELECT stop_id, stop_name, {_PLACE} FROM stops_raw")
SQL["scores_round_trip"] = statement(SCORED, 'SELECT name, neighborhood_score, "rank" FROM scored')
SQL["geoparquet_metric"] = SQL["geoparquet_points"]
SQL["mixed_parks"] = statement(
    {**CENTRED, **unprojected("foot", "foot_ll"), **PARKS},
    f"""SELECT name, {half_even("lon", 6)} AS lon, {half_even("lat", 6)} AS lat
    FROM sound f JOIN foot_ll c ON f.park_id = c.park_id WHERE {POLY_IN_BOX}
    UNION ALL SELECT name, {half_even("lon", 6)}, {half_even("lat", 6)} FROM parks""",
)

# Two zone layers over each other: names repeat, so rows go by a key of their own.
TWINS = {
    **CLEAN,
    **stats("clean", "neighborhood"),
    **ZONES,
    "twins": """SELECT n_nationkey AS zone_id, name, x0, x1, y0, y1 FROM zones
      UNION ALL SELECT n_nationkey + 100, name, x0 + 0.02E0, x1 + 0.02E0, y0 + 0.02E0, y1 + 0.02E0 FROM zones""",
    **corners("twins", "zone_id", "twin_corners"),
    **spatial("zone_id", "twin_corners"),
    "enriched": """SELECT s.* EXCLUDE (zone_id), z.name, t.* EXCLUDE (name) FROM spatial s JOIN twins z ON s.zone_id = z.zone_id
      LEFT JOIN stats t ON z.name = t.name""",
    **{k: SCORED[k] for k in ("filled", "subscores", "weighted", "scored")},
}
SQL["twin_zone_scores"] = statement(
    TWINS,
    """SELECT name, dist_to_nearest_transit_m, transit_stops_1km, neighborhood_score, "rank", true AS in_range FROM scored""",
)
_MATRIX = ", ".join(f"{weighted(*w)} AS {SCENARIO_COLUMNS[n]}" for n, w in SCENARIOS.items())
SQL["twin_scenarios"] = statement(TWINS, f"SELECT name, dist_to_nearest_transit_m, transit_stops_1km, {_MATRIX} FROM subscores")
SQL["pipeline_stages"] = statement(
    {**_BY_RIDGE, **scored(0.2, 0.6, 0.2)}, f'SELECT name, neighborhood_score, ml_score, {_RANKED}, "rank" FROM predicted'
)
# Corners in the order of their angle make a ring that does not meet itself; two exchanged far apart make it cross.
SQL["long_ring_validity"] = """SELECT n_nationkey, CAST(count(*) AS INTEGER) AS n_vertices, n_nationkey % 3 <> 0 AS valid
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey"""
