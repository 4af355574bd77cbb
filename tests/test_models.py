import numpy as np
import pytest
from pyspark.sql import functions as F

from test_geometry import geom
from zonewise.functions.crs import with_crs
from zonewise.operators import models
from zonewise.operators.recommend import FAR_PARK, FEW_STOPS, HIGH_PRICE, OTHER, recommend


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 30
    x = rng.normal(size=(n, 3)) * [1e6, 1, 50] + [5e6, 2, 300]
    y = 50 + 1e-5 * (x[:, 0] - 5e6) + 3 * x[:, 1] + rng.normal(size=n)
    rows = [(f"z{i:02d}", float(y[i]), *map(float, x[i]), 4.0) for i in range(n)]
    return spark.createDataFrame(rows, "name string, neighborhood_score double, a double, b double, c double, flat double")


def refit(x, y, alpha=1.0):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-9, sd, 1)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - mean) / sd) @ beta


NAMES = ["a", "b", "c", "flat"]


def arrays(table):
    pdf = table.orderBy("name").toPandas()
    return pdf[NAMES].to_numpy(), pdf.neighborhood_score.to_numpy()


def test_loo_ridge_equals_refitting(table):
    x, y = arrays(table)
    got = models.loo_ridge(table, NAMES).orderBy("name").toPandas().predicted.to_numpy()
    keep = ~np.eye(len(y), dtype=bool)
    want = [refit(x[keep[i]], y[keep[i]])(x[i]) for i in range(len(y))]
    assert np.abs(got - want).max() < 1e-6


def test_fitted_ridge_equals_closed_form(table):
    x, y = arrays(table)
    predict, importances = models.Ridge().fit(table, NAMES, models.TARGET)
    got = predict(table).orderBy("name").toPandas()._p.to_numpy()
    assert importances is None
    assert np.abs(got - refit(x, y)(x)).max() < 1e-6


def test_baseline_and_metrics(table):
    _, y = arrays(table)
    row = models.metrics(models.loo_baseline(table), "b").first()
    e = np.abs(y - (y.sum() - y) / (len(y) - 1))
    assert row.mae == pytest.approx(e.mean(), abs=0.006) and row.mae_std == pytest.approx(e.std(), abs=0.006)


def test_trees_learn_and_importances_sum_to_one(table):
    predict, importances = models.random_forest().fit(table, NAMES, models.TARGET)
    assert sum(importances.values()) == pytest.approx(1)
    errors = predict(table).select(F.avg(F.abs(F.col("_p") - F.col("neighborhood_score")))).first()[0]
    baseline = models.metrics(models.loo_baseline(table), "b").first().mae
    assert errors < baseline
    cv = models.cross_validate(models.random_forest(), table, NAMES, cv=3)
    assert cv.count() == table.count() and cv.select("name").distinct().count() == table.count()


def square(i):
    x = 34.7 + 0.02 * i
    return geom([[(x, 32.0), (x + 0.01, 32.0), (x + 0.01, 32.01), (x, 32.01)]])


def zones(spark, rows):
    cols = "name, neighborhood_score, avg_price, dist_to_nearest_transit_m, dist_to_nearest_park_m, transit_stops_500m, parks_1km"
    body = " union all ".join(
        f"select '{r[0]}' name, {r[1]}D neighborhood_score, cast({r[2]} as double) avg_price, {r[3]}D dist_to_nearest_transit_m,"
        f" {r[4]}D dist_to_nearest_park_m, {r[5]}L transit_stops_500m, {r[6]}L parks_1km, {square(i)} geometry"
        for i, r in enumerate(rows)
    )
    return with_crs(spark.sql(body), "EPSG:4326")


ROWS = [("a", 90, 3e6, 100, 300, 5, 2), ("b", 50, 4e6, 200, 900, 3, 1), ("c", 30, "null", 700, 800, 1, 0), ("d", 20, 6e6, 900, 2500, 0, 0)]


def test_features_fill_medians_and_drop_empty_columns(spark):
    df = zones(spark, ROWS).withColumn("avg_rooms", F.lit(None).cast("double"))
    table, names = models.features(df)
    assert "avg_rooms" not in names and {"transit_composite", "park_composite", "centroid_x", "centroid_y"} <= set(names)
    assert table.filter("name = 'c'").first().avg_price == 4e6
    bare = df.drop("neighborhood_score")
    with pytest.raises(ValueError):
        models.compare_models(bare)
    with pytest.raises(ValueError):
        models.ScoreModel().fit(bare)
    with pytest.raises(RuntimeError):
        models.ScoreModel().transform(df)


def test_score_model_stays_in_range_and_ranks(spark):
    out = models.ScoreModel(models.Ridge()).fit_transform(zones(spark, ROWS)).toPandas()
    assert out.ml_score.between(0, 100).all() and out.ml_rank.min() == 1


def test_recommendations_take_the_first_rule(spark):
    df = spark.createDataFrame(
        [
            ("far_park", 10.0, None, 2500.0, 1.0, 9), ("pricey", 11.0, 900.0, 100.0, 9e6, 9), ("few", 12.0, 1.0, 1.0, 1.0, 0),
            ("rest", 13.0, 1.0, 1.0, 1.0, 9), ("good", 90.0, 1.0, 1.0, 1.0, 9), ("better", 91.0, 1.0, 1.0, 2.0, 9),
            ("best", 92.0, 1.0, 1.0, 2.0, 9), ("top", 93.0, 1.0, 1.0, 2.0, 9),
        ],
        "name string, ml_score double, dist_to_nearest_transit_m double, dist_to_nearest_park_m double, avg_price double, transit_stops_500m int",
    )
    got = [(r.city, r.recommendation) for r in recommend(df).collect()]
    assert got == [("far_park", FAR_PARK), ("pricey", HIGH_PRICE), ("few", FEW_STOPS), ("rest", OTHER)]
    assert recommend(df.withColumn("ml_score", F.lit(5.0))).count() == 0
    assert recommend(df.select("name", "ml_score")).filter(F.col("recommendation") != OTHER).count() == 0


def test_tree_queries_return_scores_in_range_with_their_ranks(spark):
    """What must hold of rows that SQL cannot compute."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    out = entry.queries()["ml_scores"](spark, folder).toPandas()
    assert len(out) == 25 and out.ml_score.between(0, 100).all() and (out.ml_score * 10 % 1).abs().max() < 1e-6
    assert (out.ml_rank == [1 + (out.ml_score > s).sum() for s in out.ml_score]).all()
    # a fitted forest lies closer to the scores than their mean does, and orders the zones alike
    gap = (out.ml_score - out.neighborhood_score).abs().mean()
    assert gap < 0.6 * (out.neighborhood_score - out.neighborhood_score.mean()).abs().mean()
    assert out.ml_score.rank().corr(out.neighborhood_score.rank()) > 0.8
    top = entry.queries()["importances"](spark, folder).toPandas()
    assert len(top) == 8 and top.importance.is_monotonic_decreasing and 0.5 < top.importance.sum() <= 1 + 1e-9
    assert set(top.feature) <= {*models.RAW_FEATURES, "transit_composite", "park_composite", "centroid_x", "centroid_y"}


def test_comparison_is_ordered_and_measured_by_the_same_folds(table):
    found = models.CANDIDATES["Gradient Boosting"](table, NAMES, 3), models.CANDIDATES["Baseline (mean)"](table, NAMES, 3)
    boosted, mean = (models.metrics(p, "m", 3).first() for p in found)
    assert boosted.mae < mean.mae and boosted.cv == "3" and boosted.r2_pooled > mean.r2_pooled
