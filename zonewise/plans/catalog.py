"""One named query per operator over the layers derived from the provided tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.crs import with_crs
from ..functions.numeric import half_even
from ..functions.projection import project, unproject
from ..operators import clean, estimators, features, models, overlay, proximity, recommend, report, scoring, stats, validate, validity
from ..operators.polygons import points_in_polygons, spatial_join
from ..operators.workset import Scratch, application_scratch, settle
from ..settings import STORAGE_CRS
from ..sources import layers, open_data
from . import tables as T
from .suitability import enriched_zones, scored_zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _names(spark, sf):
    """All zone names, as the table of supported zones."""
    return T.zones(spark, sf).select("name")


def _enriched(spark, sf):
    return enriched_zones(
        T.zones(spark, sf), T.transactions(spark, sf), T.transit_stops(spark, sf), T.parks(spark, sf), _names(spark, sf)
    )


def _scored(spark, sf):
    return scored_zones(
        T.zones(spark, sf), T.transactions(spark, sf), T.transit_stops(spark, sf), T.parks(spark, sf), _names(spark, sf)
    )


def _clean_transactions(spark, sf):
    return clean.transactions(T.transactions(spark, sf), _names(spark, sf))


def _predicted(spark, sf):
    """Scored zones with a stand-in prediction that follows from the score by a formula."""
    zones = _scored(spark, sf)
    return zones.withColumn("ml_score", half_even(F.col("neighborhood_score") * 0.5 + F.col("transit_stops_1km") * 2.0, 1))


# cleaning -------------------------------------------------------------------------------------------------------------


@query
def clean_transactions(spark, sf):
    df = _clean_transactions(spark, sf)
    return df.withColumn("log_price", half_even(F.col("log_price"), 6))


@query
def clean_stops(spark, sf):
    return clean.stops(T.transit_stops(spark, sf))


@query
def clean_stops_without_type(spark, sf):
    return clean.stops(T.transit_stops(spark, sf).drop("stop_type"))


@query
def clean_parks(spark, sf):
    df = clean.parks(T.footprints(spark, sf))
    return df.select("park_id", "name", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def clean_zones(spark, sf):
    return clean.zones(T.zones(spark, sf), _names(spark, sf)).select("n_nationkey", "name")


@query
def clip_polygons(spark, sf):
    return clean.clip_to_bbox(T.footprints(spark, sf)).select("park_id")


@query
def keep_known(spark, sf):
    region = spark.read.parquet(f"{sf}/region.parquet").filter(F.col("r_regionkey") > 0)
    nation = spark.read.parquet(f"{sf}/nation.parquet").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    known = nation.select(F.col("n_name").alias("name"))
    return clean.keep_known(T.transactions(spark, sf), "neighborhood", known).select("txn_id", "neighborhood")


@query
def clip_group_percentiles(spark, sf):
    df = clean.clip_group_percentiles(_clean_transactions(spark, sf))
    return df.select("txn_id", "neighborhood", "transaction_price")


@query
def impute_group_median(spark, sf):
    return clean.impute_group_median(_clean_transactions(spark, sf)).select("txn_id", "neighborhood", "rooms")


@query
def dedupe(spark, sf):
    tx = T.transactions(spark, sf).select("neighborhood", "rooms", "area_m2")
    return clean.dedupe(tx)


# statistics -----------------------------------------------------------------------------------------------------------


@query
def zone_stats(spark, sf):
    return stats.by_zone(_clean_transactions(spark, sf))


@query
def zone_stats_by_polygon(spark, sf):
    located = points_in_polygons(_clean_transactions(spark, sf), T.zones(spark, sf), key="txn_id")
    return stats.by_zone(located, "neighborhood_polygon")


@query
def describe_by_zone(spark, sf):
    return stats.describe(T.transactions(spark, sf), ["transaction_price"], by="neighborhood")


@query
def describe_columns(spark, sf):
    return stats.describe(T.transactions(spark, sf), ["transaction_price", "rooms", "area_m2"], digits=1)


@query
def value_counts(spark, sf):
    return stats.value_counts(T.transit_stops(spark, sf), "stop_type")


@query
def area_average(spark, sf):
    zones = stats.by_zone(_clean_transactions(spark, sf))
    return stats.area_average(zones).select(half_even(F.col("area_average"), 2).alias("area_average"))


@query
def column_profile(spark, sf):
    return stats.column_profile(T.transactions(spark, sf), ["transaction_price", "rooms", "area_m2"])


# geometry -------------------------------------------------------------------------------------------------------------


@query
def project_metric(spark, sf):
    x, y = project(F.col("lon"), F.col("lat"))
    return T.transactions(spark, sf).select("txn_id", half_even(x, 2).alias("x"), half_even(y, 2).alias("y"))


@query
def unproject_round_trip(spark, sf):
    x, y = project(F.col("lon"), F.col("lat"))
    df = T.transactions(spark, sf).select("txn_id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = unproject(F.col("x"), F.col("y"))
    exact = (F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9)
    return df.select("txn_id", exact.alias("same_place"))


@query
def polygon_area(spark, sf):
    df = clean.drop_invalid(T.footprints(spark, sf))
    return df.select("park_id", half_even(G.area(F.col("geometry"))).alias("area_m2"))


@query
def polygon_centroid(spark, sf):
    df = clean.drop_invalid(T.footprints(spark, sf)).select("park_id", G.metric_centroid(F.col("geometry")).alias("c"))
    return df.select("park_id", half_even(F.col("c.x"), 1).alias("x"), half_even(F.col("c.y"), 1).alias("y"))


@query
def polygon_validity(spark, sf):
    return T.footprints(spark, sf).select("park_id", G.is_valid(F.col("geometry")).alias("valid"))


@query
def long_ring_validity(spark, sf):
    """One ring per nation around the study area, a vertex per order in turn; every third has two of its vertices exchanged."""
    turn = Window.partitionBy("n_nationkey").orderBy("o_orderkey")
    orders = T.run(spark, sf, "SELECT o_orderkey, n_nationkey FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey")
    placed = orders.withColumns({"k": F.row_number().over(turn), "n": F.count(F.lit(1)).over(Window.partitionBy("n_nationkey"))})
    order = F.when((F.col("n_nationkey") % 3 == 0) & F.col("k").isin(5, 15), 20 - F.col("k")).otherwise(F.col("k"))
    angle = F.col("k") / F.col("n") * F.lit(2 * math.pi)
    corner = F.struct("k2", F.struct((34.8 + 0.1 * F.cos("t")).alias("x"), (32.0 + 0.1 * F.sin("t")).alias("y")).alias("v"))
    rings = placed.select("n_nationkey", order.alias("k2"), angle.alias("t")).groupBy("n_nationkey").agg(F.sort_array(F.collect_list(corner)).alias("c"))
    shapes = rings.select("n_nationkey", G.polygon(F.transform("c", lambda c: c["v"])).alias("geometry"))
    with Scratch(spark) as scratch:
        found = validity.judged(shapes, scratch, long=100).select("n_nationkey", F.size(G.vertices(F.col("geometry"))).alias("n_vertices"), F.col("_valid").alias("valid"))
        return scratch.keep(found)


@query
def polygon_bounds(spark, sf):
    b = G.bbox(F.col("geometry"))
    return T.footprints(spark, sf).select("park_id", *[half_even(c, 6).alias(n) for n, c in b.items()])


# joins ----------------------------------------------------------------------------------------------------------------


@query
def points_in_zones(spark, sf):
    joined = points_in_polygons(T.transactions(spark, sf), T.zones(spark, sf), key="txn_id")
    return joined.select("txn_id", "neighborhood_polygon")


@query
def points_in_districts(spark, sf):
    joined = points_in_polygons(T.transactions(spark, sf), T.districts(spark, sf), key="txn_id")
    return joined.select("txn_id", "neighborhood_polygon")


@query
def overlap_fanout(spark, sf):
    both = T.zones(spark, sf).unionByName(T.zones(spark, sf, shift=0.02))
    joined = points_in_polygons(T.transactions(spark, sf), with_crs(both, STORAGE_CRS), key="txn_id")
    return joined.select("txn_id", "neighborhood_polygon")


@query
def join_report(spark, sf):
    return stats.join_report(points_in_polygons(T.transactions(spark, sf), T.districts(spark, sf), key="txn_id"))


@query
def spatial_join_within(spark, sf):
    left = T.transit_stops(spark, sf).select("stop_id", "lon", "lat")
    joined = spatial_join(left, T.zones(spark, sf), "inner", "within", "stop_id", "n_nationkey")
    return joined.select("stop_id", "name")


@query
def spatial_join_contains(spark, sf):
    points = T.parks(spark, sf).select("park_id", "lon", "lat")
    joined = spatial_join(T.districts(spark, sf), points, "left", "contains", "district_id", "park_id")
    return joined.select("district_id", "park_id")


@query
def spatial_join_right(spark, sf):
    points = T.parks(spark, sf).select("park_id", "lon", "lat")
    joined = spatial_join(T.districts(spark, sf), points, "right", "intersects", "district_id", "park_id")
    return joined.select("district_id", "park_id")


@query
def polygons_intersect(spark, sf):
    joined = spatial_join(T.districts(spark, sf), T.zones(spark, sf), "inner", "intersects", "district_id", "n_nationkey")
    return joined.select("district_id", "n_nationkey")


@query
def polygons_within(spark, sf):
    joined = spatial_join(T.districts(spark, sf), T.zones(spark, sf), "inner", "within", "district_id", "n_nationkey")
    return joined.select("district_id", "n_nationkey")


@query
def polygons_intersect_by_edges(spark, sf):
    left = T.districts(spark, sf).select(F.col("district_id").alias("_lk"), "geometry")
    right = T.zones(spark, sf).select(F.col("n_nationkey").alias("_rk"), "geometry")
    with Scratch(spark) as scratch:
        found = overlay.intersecting(left, right, scratch)
        return scratch.keep(found.select(F.col("_lk").alias("district_id"), F.col("_rk").alias("n_nationkey")))


@query
def polygons_within_by_edges(spark, sf):
    inner = T.districts(spark, sf).select(F.col("district_id").alias("_ik"), "geometry")
    outer = T.zones(spark, sf).select(F.col("n_nationkey").alias("_ok"), "geometry")
    with Scratch(spark) as scratch:
        found = overlay.lying_within(inner, outer, scratch)
        return scratch.keep(found.select(F.col("_ik").alias("district_id"), F.col("_ok").alias("n_nationkey")))


@query
def nearest_distance(spark, sf):
    found = proximity.nearest_distance(T.transactions(spark, sf), T.transit_stops(spark, sf), "dist_m", "txn_id")
    return found.select("txn_id", "dist_m")


@query
def nearest_polygon(spark, sf):
    found = proximity.nearest_distance(T.transit_stops(spark, sf), T.zones(spark, sf), "dist_m", "stop_id")
    return found.select("stop_id", "dist_m")


@query
def nearest_empty_target(spark, sf):
    none = T.parks(spark, sf).filter(F.col("name").isNull())
    return proximity.nearest_distance(T.transit_stops(spark, sf), none, "dist_m", "stop_id").select("stop_id", "dist_m")


@query
def count_within(spark, sf):
    radii = {"stops_500m": 500.0, "stops_1km": 1000.0}
    found = proximity.count_within(T.transactions(spark, sf), T.transit_stops(spark, sf), radii, "txn_id")
    return found.select("txn_id", *radii)


@query
def count_within_inscribed(spark, sf):
    found = proximity.count_within(
        T.transit_stops(spark, sf), T.parks(spark, sf), {"parks_1km": 1000.0}, "stop_id", circle="polygon64", empty_as_one=True
    )
    return found.select("stop_id", "parks_1km")


@query
def zone_spatial_features(spark, sf):
    zones = features.zone_spatial(T.zones(spark, sf), clean.stops(T.transit_stops(spark, sf)), clean.parks(T.parks(spark, sf)))
    return zones.select("name", *features.SPATIAL)


@query
def district_spatial_features(spark, sf):
    zones = features.zone_spatial(
        T.districts(spark, sf), clean.stops(T.transit_stops(spark, sf)), clean.parks(T.parks(spark, sf)), "district_id"
    )
    return zones.select("district_id", *features.SPATIAL)


@query
def attach_stats(spark, sf):
    return features.attach_stats(T.zones(spark, sf).drop("geometry"), _clean_transactions(spark, sf))


# scoring --------------------------------------------------------------------------------------------------------------

SCORED = ["name", *scoring.SUBSCORES, "neighborhood_score", "rank"]


@query
def score_zones(spark, sf):
    return _scored(spark, sf).select(*SCORED)


@query
def score_percent_weights(spark, sf):
    return scoring.run(_enriched(spark, sf), scoring.Weights.from_percent(60, 20)).select(*SCORED)


@query
def rank_zones(spark, sf):
    """Rank over many rows: one score per customer."""
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    scores = customer.select("c_custkey", half_even(F.col("c_acctbal") / 100.0, 1).alias("score"))
    return scoring.rank_by(scores, "score")


@query
def budget_filter(spark, sf):
    return scoring.filter_by_budget(_scored(spark, sf), 5_000_000).select("name", "avg_price", "rank")


@query
def budget_fallback(spark, sf):
    return scoring.filter_by_budget(_scored(spark, sf), 1_000).select("name", "avg_price", "rank")


@query
def weight_scenarios(spark, sf):
    return scoring.score_scenarios(_enriched(spark, sf))


SCENARIO_COLUMNS = {
    "Default (40/35/25)": "default_score",
    "Price-focused (70/15/15)": "price_focused",
    "Transit-focused (20/60/20)": "transit_focused",
    "Green-focused (20/20/60)": "green_focused",
}


@query
def scenario_pivot(spark, sf):
    return scoring.compare_scenarios(_enriched(spark, sf)).withColumnsRenamed(SCENARIO_COLUMNS)


# validation -----------------------------------------------------------------------------------------------------------

FINDING = ["check", "severity", "n_bad"]


@query
def validate_transactions(spark, sf):
    return validate.layer(T.transactions(spark, sf), validate.TRANSACTIONS, known=T.zones(spark, sf).filter("n_nationkey > 0")).select(*FINDING)


@query
def validate_zones(spark, sf):
    both = T.zones(spark, sf).unionByName(T.zones(spark, sf, shift=0.02))
    atlantis = spark.range(1).select(F.lit("Atlantis").alias("name"))
    return validate.layer(with_crs(both, STORAGE_CRS), validate.ZONES, known=_names(spark, sf).unionByName(atlantis)).select(*FINDING)


@query
def validate_stops(spark, sf):
    return validate.layer(T.transit_stops(spark, sf), validate.STOPS).select(*FINDING)


@query
def validate_parks(spark, sf):
    return validate.layer(T.footprints(spark, sf), validate.PARKS).select(*FINDING)


@query
def missing_zones(spark, sf):
    return validate.missing_zones(T.zones(spark, sf).filter(F.col("n_nationkey") % 3 != 0), _names(spark, sf))


@query
def duplicate_zones(spark, sf):
    parts = T.footprints(spark, sf)
    return validate.duplicate_names(parts)


@query
def layer_profile(spark, sf):
    point = validate.layer_profile(T.transactions(spark, sf), "transactions")
    return point.unionByName(validate.layer_profile(T.footprints(spark, sf), "footprints"))


# reports --------------------------------------------------------------------------------------------------------------


@query
def kpis(spark, sf):
    return report.kpis(_scored(spark, sf))


@query
def top_k(spark, sf):
    return report.top_k(_scored(spark, sf).select("rank", "name", "neighborhood_score"))


@query
def ranking_table(spark, sf):
    return report.ranking_table(_scored(spark, sf))


@query
def map_table(spark, sf):
    return report.map_table(_scored(spark, sf))


@query
def score_color(spark, sf):
    """Colour over many scores: one per order."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    score = half_even(F.col("o_totalprice") / 4000.0, 1)
    return orders.select("o_orderkey", report.score_color(score).alias("color"), report.score_band(score).alias("band"))


@query
def score_breakdown(spark, sf):
    return report.score_breakdown(_scored(spark, sf))


@query
def score_delta(spark, sf):
    return report.score_delta(scoring.rank_by(_predicted(spark, sf), "ml_score", "ml_rank"))


# models ---------------------------------------------------------------------------------------------------------------


@query
def ml_features(spark, sf):
    table, names = models.features(_scored(spark, sf))
    return table.select("name", *[half_even(F.col(c), 3).alias(c) for c in names])


@query
def loo_baseline(spark, sf):
    return models.metrics(models.loo_baseline(_scored(spark, sf)), "Baseline (mean)")


@query
def loo_ridge(spark, sf):
    """Every zone as ridge on the others predicts it."""
    table, names = models.features(_scored(spark, sf))
    found = models.loo_ridge(settle(table), names)
    return found.select("name", "actual", half_even(F.col("predicted"), 4).alias("predicted"))


@query
def model_compare(spark, sf):
    """Errors of all four models, every zone left out once. Tree ensembles have no form in SQL."""
    return models.compare_models(settle(_scored(spark, sf)))


@query
def linear_compare(spark, sf):
    """Errors of the two models that SQL can refit."""
    return models.compare_models(settle(_scored(spark, sf)), candidates=models.LINEAR)


@query
def model_improvement(spark, sf):
    return models.improvement(models.compare_models(settle(_scored(spark, sf)), candidates=models.LINEAR))


_FORETOLD = ("name", "neighborhood_score", "ml_score", "ml_rank")


@query
def ml_scores(spark, sf):
    """Scores and ranks that the forest predicts."""
    return models.ScoreModel().fit_transform(settle(_scored(spark, sf))).select(*_FORETOLD)


@query
def ridge_scores(spark, sf):
    return models.ScoreModel(models.Ridge()).fit_transform(settle(_scored(spark, sf))).select(*_FORETOLD)


@query
def importances(spark, sf):
    """The eight features that the forest used most."""
    every = models.ScoreModel().fit(settle(_scored(spark, sf))).importances(spark)
    return every.orderBy(F.desc("importance"), "feature").limit(8)


@query
def predictive_flow(spark, sf):
    """The whole bundle with ridge: predictions, the advice a zone gets, and the model that compared best."""
    bundle = models.run(settle(_scored(spark, sf)), model=models.Ridge(), candidates=models.LINEAR)
    advised = bundle["recommendations"].select(F.col("city").alias("name"), "recommendation")
    best = bundle["comparison"].agg(F.min_by("model", "mae").alias("best_model"))
    return bundle["scores"].join(advised, "name", "left").crossJoin(F.broadcast(best)).select(*_FORETOLD, "recommendation", "best_model")


def _twins(spark, sf):
    return with_crs(T.zones(spark, sf).unionByName(T.zones(spark, sf, shift=0.02)), STORAGE_CRS)


@query
def twin_zone_scores(spark, sf):
    """Two overlaid layers in which every name occurs twice, through features, scoring and prediction."""
    scored = scored_zones(_twins(spark, sf), T.transactions(spark, sf), T.transit_stops(spark, sf), T.parks(spark, sf), _names(spark, sf))
    found = models.ScoreModel(models.Ridge()).fit_transform(settle(scored))
    in_range = F.col("ml_score").between(0, 100).alias("in_range")
    return found.select("name", "dist_to_nearest_transit_m", "transit_stops_1km", "neighborhood_score", "rank", in_range)


@query
def twin_scenarios(spark, sf):
    """The scenario matrix of zones that share their names: a row per zone."""
    zones = enriched_zones(_twins(spark, sf), T.transactions(spark, sf), T.transit_stops(spark, sf), T.parks(spark, sf), _names(spark, sf))
    kept = ("name", "dist_to_nearest_transit_m", "transit_stops_1km")
    return scoring.compare_scenarios(zones, keep=kept).withColumnsRenamed(SCENARIO_COLUMNS)


@query
def pipeline_stages(spark, sf):
    """Scorer and ridge as stages of one pipeline, saved and loaded before they score."""
    stages = [estimators.SuitabilityStage(weights=[0.2, 0.6, 0.2]), estimators.PredictedScoreStage(kind="ridge")]
    zones = _enriched(spark, sf)
    path = _fresh(spark, ".model")
    Pipeline(stages=stages).fit(zones).write().save(path)
    return PipelineModel.load(path).transform(zones).select(*_FORETOLD, "rank")


@query
def recommendations(spark, sf):
    return recommend.recommend(_predicted(spark, sf))


# sources and sinks ----------------------------------------------------------------------------------------------------


def _fresh(spark, suffix):
    return application_scratch(spark).folder() + suffix


@query
def normalise_deals(spark, sf):
    return open_data.normalise_deals(T.deals(spark, sf).drop("deal_id"))


@query
def geocode_jitter(spark, sf):
    """Scattered positions; only their rough spread is fixed."""
    placed = open_data.normalise_deals(T.deals(spark, sf), key="deal_id")
    centred = placed.join(
        F.broadcast(open_data.places(spark).select(F.col("name").alias("neighborhood"), "centre_lon", "centre_lat")), "neighborhood"
    )
    near = (F.abs(F.col("lon") - F.col("centre_lon")) < 0.08) & (F.abs(F.col("lat") - F.col("centre_lat")) < 0.07)
    return centred.groupBy("neighborhood").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("n_near"))


@query
def normalise_ways(spark, sf):
    """Footprints written as way payloads, one document per group of parts, and read back."""
    ring = F.transform(F.col("geometry.parts")[0][0], lambda v: F.struct(v["x"].alias("lon"), v["y"].alias("lat")))
    element = F.struct(
        F.when(F.col("park_id") % 23 == 0, "node").otherwise("way").alias("type"),
        F.col("park_id").alias("id"),
        F.struct(F.when(F.col("park_id") % 7 != 0, F.col("name")).alias("name")).alias("tags"),
        ring.alias("geometry"),
    )
    # a thousand ways to a document, as an extract cut into tiles would have
    documents = T.footprints(spark, sf).groupBy(F.floor(F.col("park_id") / 1000).alias("tile")).agg(
        F.collect_list(element).alias("elements")
    )
    path = _fresh(spark, ".json")
    documents.drop("tile").write.json(path)
    raw = spark.read.schema(open_data.WAYS_DDL).json(path)
    return open_data.normalise_ways(raw).select("name", "area_m2")


@query
def fill_missing_zones(spark, sf):
    primary = T.zones(spark, sf).filter(F.col("n_nationkey") % 3 != 0).select("name", F.lit("primary").alias("origin"))
    backup = T.zones(spark, sf).select("name", F.lit("backup").alias("origin"), "n_nationkey")
    return open_data.fill_missing_zones(primary, backup)


def _area(df):
    return df.select("park_id", "name", half_even(G.area(F.col("geometry"))).alias("area_m2"))


@query
def geojson_round_trip(spark, sf):
    path = _fresh(spark, ".geojsonl")
    layers.write_geojson(clean.drop_invalid(T.footprints(spark, sf)), path)
    return _area(layers.read_geojson(spark, path, "park_id bigint, name string", lines=True))


@query
def geojson_collection(spark, sf):
    """One FeatureCollection in one file, read by ranges of 64 KB."""
    path = _fresh(spark, ".geojson")
    layers.write_geojson(clean.drop_invalid(T.footprints(spark, sf)).coalesce(1), path, collection=True)
    return _area(layers.read_geojson(spark, path, "park_id bigint, name string", range_bytes=1 << 16))


@query
def geojson_points(spark, sf):
    path = _fresh(spark, ".geojsonl")
    layers.write_geojson(T.transit_stops(spark, sf), path)
    back = layers.load_layer(spark, [f"{path}.absent.parquet", path], "transit_stops")
    return back.select("stop_name", "stop_type", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def geoparquet_round_trip(spark, sf):
    path = _fresh(spark, ".parquet")
    layers.write_layer(clean.drop_invalid(T.footprints(spark, sf)), path)
    return _area(layers.read_geoparquet(spark, path))


@query
def clip_written_polygons(spark, sf):
    """The study area out of a written layer: the bounds of the rows are filtered at the scan."""
    path = _fresh(spark, ".parquet")
    layers.write_layer(T.footprints(spark, sf), path, row_group_rows=1000)
    return clean.clip_to_bbox(layers.load_layer(spark, [path], "parks", points=False)).select("park_id")


@query
def geoparquet_points(spark, sf):
    path = _fresh(spark, ".parquet")
    layers.write_layer(T.transactions(spark, sf), path)
    back = layers.read_geoparquet(spark, path, points=True)
    return back.select("txn_id", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def csv_points(spark, sf):
    """Columns in another order than wanted, and one that nobody asked for."""
    path = _fresh(spark, ".csv")
    x, y = project(F.col("lon"), F.col("lat"))
    stops = T.transit_stops(spark, sf).select(y.alias("y"), "stop_name", F.lit("z").alias("extra"), x.alias("x"), "stop_id")
    stops.write.option("header", True).csv(path)
    back = layers.read_points_csv(
        spark, path, "stop_id bigint, stop_name string, x double, y double", "x", "y", crs="EPSG:2039"
    )
    return back.select("stop_id", "stop_name", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def geoparquet_metric(spark, sf):
    """A layer written in metres comes back in degrees by what the file says."""
    path = _fresh(spark, ".parquet")
    x, y = project(F.col("lon"), F.col("lat"))
    metric = T.transactions(spark, sf).select("txn_id", x.alias("lon"), y.alias("lat"))
    layers.write_layer(with_crs(metric, "EPSG:2039"), path)
    back = layers.read_geoparquet(spark, path, points=True)
    return back.select("txn_id", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def mixed_parks(spark, sf):
    """Points and polygons in one geometry column, through FeatureCollection files and the cleaning of parks."""
    spot = F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))))
    points = T.parks(spark, sf).select("name", F.struct(F.lit("Point").alias("type"), spot.alias("parts")).alias("geometry"))
    both = points.unionByName(T.footprints(spark, sf).select("name", "geometry"))
    path = _fresh(spark, ".geojson")
    layers.write_geojson(with_crs(both, STORAGE_CRS), path, collection=True)
    parks = clean.parks(layers.load_layer(spark, [path], "parks").drop("area_m2"))
    return parks.select("name", half_even(F.col("lon"), 6).alias("lon"), half_even(F.col("lat"), 6).alias("lat"))


@query
def scores_round_trip(spark, sf):
    path = _fresh(spark, ".parquet")
    layers.write_layer(with_crs(_scored(spark, sf), STORAGE_CRS), path)
    return layers.read_scores(spark, path).select("name", "neighborhood_score", "rank")
