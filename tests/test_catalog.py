import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "clean_transactions", "clean_parks", "zone_stats", "describe_by_zone", "describe_columns", "points_in_districts", "overlap_fanout",
    "polygons_within", "nearest_polygon", "count_within_inscribed", "score_zones", "scenario_pivot", "validate_zones", "recommendations",
    "normalise_deals", "normalise_ways", "clip_group_percentiles", "rank_zones", "csv_points", "mixed_parks", "missing_zones", "fill_missing_zones", "geoparquet_metric", "ridge_scores",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = normal(entry.queries()[name](spark, FOLDER).toPandas())
    want = normal(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert got.equals(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["points_in_districts", "nearest_distance", "count_within", "clean_transactions", "zone_stats"])
def test_plans_have_no_cross_product_of_layers(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bbox_and_price_filters_reach_the_scan(spark):
    from zonewise.functions.crs import with_crs
    from zonewise.operators import clean
    from zonewise.operators.workset import settle
    from zonewise.plans import tables

    stored = with_crs(settle(tables.transactions(spark, FOLDER)), "EPSG:4326")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the plan's text cuts long filter lists
    text = plan(clean.transactions(stored, ["NATION_1", "NATION_2"]))
    assert "GreaterThan(lon,34.7)" in text and "In(neighborhood" in text and "Exchange" not in text
