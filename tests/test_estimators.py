import pytest
from pyspark.ml import Pipeline, PipelineModel

from test_models import ROWS, zones
from zonewise.operators import estimators, scoring


def rows(df):
    return sorted((r.name, r.neighborhood_score, r["rank"], r.ml_score, r.ml_rank) for r in df.collect())


@pytest.mark.parametrize("kind", ["ridge", "random_forest", "gradient_boosting"])
def test_a_saved_pipeline_scores_alike(spark, tmp_path, kind):
    df = zones(spark, ROWS).drop("neighborhood_score")
    pipeline = Pipeline(stages=[estimators.SuitabilityStage(weights=[0.5, 0.3, 0.2]), estimators.PredictedScoreStage(kind=kind)])
    fitted = pipeline.fit(df)
    want = rows(fitted.transform(df))
    assert [r[:3] for r in want] == sorted((r.name, r.neighborhood_score, r["rank"]) for r in scoring.run(df, scoring.Weights(0.5, 0.3, 0.2)).collect())
    fitted.write().save(str(tmp_path / "fitted"))
    pipeline.write().save(str(tmp_path / "plan"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert rows(loaded.transform(df)) == want
    # limits are those of the zones that were fitted, not of the zones that are scored
    part = df.filter("name <> 'd'")
    assert {r[0]: r[1] for r in rows(loaded.transform(part))}["a"] == {r[0]: r[1] for r in want}["a"]
    again = Pipeline.load(str(tmp_path / "plan"))
    assert again.getStages()[0].getWeights() == scoring.Weights(0.5, 0.3, 0.2) and again.getStages()[1].getOrDefault("kind") == kind
    assert loaded.stages[1].scores.importances(spark) is None if kind == "ridge" else loaded.stages[1].scores.importances(spark).count() > 4


def test_empty_features_and_wrong_kinds(spark, tmp_path):
    df = zones(spark, ROWS).selectExpr("* EXCEPT (dist_to_nearest_park_m)", "cast(null as double) AS dist_to_nearest_park_m")
    model = estimators.SuitabilityStage().fit(df)
    model.write().save(str(tmp_path / "m"))
    out = estimators.SuitabilityStageModel.load(str(tmp_path / "m")).transform(df)
    assert all(r.neighborhood_score is None and r["rank"] is None for r in out.collect())
    with pytest.raises(ValueError):
        estimators.PredictedScoreStage(kind="oracle").fit(df)


def test_scenario_matrix_keeps_zones_of_equal_name(spark):
    df = zones(spark, [*ROWS, ("a", 10, 2e6, 50, 60, 9, 9)]).selectExpr("nullif(name, 'd') AS name", "* EXCEPT (name)")
    got = scoring.compare_scenarios(df)
    assert got.count() == 5 and got.filter("name = 'a'").distinct().count() == 2 and got.filter("name is null").count() == 1
    long = scoring.score_scenarios(df, keep=("name", "avg_price"))
    assert long.count() == 5 * (len(got.columns) - 1) and "avg_price" in long.columns


def test_ranks_of_many_scores_equal_those_of_few(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 11 > 0 THEN cast(hash(id) % 700 AS double) / 10 END AS s")
    few = sorted(map(tuple, scoring.rank_by(df, "s").collect()))
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, scoring.rank_by(df, "s").collect()), key=lambda r: r[0]) == few
    values = sorted((r[1] for r in few if r[1] is not None), reverse=True)
    assert all(r[2] == (None if r[1] is None else values.index(r[1]) + 1) for r in few)
