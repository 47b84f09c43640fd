"""Poisson boosting against plain searches, and the store, promotion and importance of models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridelake.operators import boosting, features, models
from ridelake.operators.boosting import TreeSettings

EXACT = TreeSettings(iterations=1, depth=1, leaves=2, min_leaf=5, bins=10_000, patience=0)


def frame(n=400, seed=0):
    chosen = np.random.default_rng(seed)
    x = chosen.integers(0, 30, n).astype(float)
    x[chosen.random(n) < 0.2] = np.nan
    z = chosen.normal(size=n)
    c = chosen.choice(["a", "b", "c", None], n)
    mean = np.exp(0.5 + 0.05 * np.nan_to_num(x, nan=25) + (c == "b") * 0.8 - 0.2 * (z > 1))
    return pd.DataFrame({"x": x, "z": z, "c": c, "y": chosen.poisson(mean).astype(float)})


def plain_best(rows, min_leaf=5, l2=EXACT.l2):
    """Largest gain over all thresholds, sides of missing values and categories."""
    y = rows["y"].to_numpy()
    g, h = y.mean() - y, np.full(len(y), y.mean())

    def gain(left):
        if min(left.sum(), (~left).sum()) < min_leaf:
            return -np.inf
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
        return part(left) + part(~left) - part(np.ones(len(y), bool))

    found = []
    for name in ("x", "z"):
        v = rows[name].to_numpy()
        missing = np.isnan(v)
        met = np.unique(v[~missing])
        for cut in [*((met[1:] + met[:-1]) / 2), np.inf]:
            found += [gain(~missing & (v <= cut)), gain(missing | (v <= cut))]
    values = rows["c"].astype(object).where(rows["c"].notna(), boosting.MISSING_CATEGORY)
    return max(found + [gain((values == k).to_numpy()) for k in set(values)])


@pytest.mark.parametrize("seed", range(4))
def test_first_split_is_the_best(seed):
    rows = frame(seed=seed)
    nodes = boosting.fit(rows, "y", ["x", "z"], ["c"], EXACT)
    assert nodes["gain"].dropna().tolist() == pytest.approx([plain_best(rows)])
    base, leaves = nodes["value"].iloc[0], nodes[nodes["feature"].isna() & (nodes["tree"] == 0)]
    assert base == pytest.approx(np.log(rows["y"].mean()))
    assert leaves["n_rows"].sum() == len(rows) and leaves["n_rows"].min() >= 5


def walk(nodes, row):
    """Prediction of one row, node by node."""
    raw = nodes.loc[nodes["tree"] == -1, "value"].iloc[0]
    for _, tree in nodes[nodes["tree"] >= 0].groupby("tree"):
        tree, at = tree.set_index("node"), 0
        while tree.loc[at, "feature"] is not None:
            node, value = tree.loc[at], row[tree.loc[at, "feature"]]
            if node["category"] is not None:
                left = (boosting.MISSING_CATEGORY if value is None else value) == node["category"]
            else:
                left = bool(node["missing_left"]) if pd.isna(value) else value <= node["threshold"]
            at = int(node["left"] if left else node["right"])
        raw += tree.loc[at, "value"]
    return np.exp(raw)


def test_forests_score_like_a_walk():
    rows = frame(800, 9)
    nodes = boosting.fit(rows, "y", ["x", "z"], ["c"], TreeSettings(iterations=25, depth=4, min_leaf=10, bins=20))
    forest = boosting.Forest(nodes)
    odd = pd.concat([rows.head(60), pd.DataFrame({"x": [1e9, np.nan], "z": [np.nan, -1e9], "c": ["never met", None], "y": [0.0, 0.0]})])
    expected = [walk(nodes, r) for r in odd.to_dict("records")]
    assert forest.predict(odd).tolist() == pytest.approx(expected)
    values = forest.matrix(odd)
    parts = [forest.sums(values, np.array([t])) for t in range(len(forest.roots))]
    assert np.sum(parts, axis=0).tolist() == pytest.approx(forest.sums(values).tolist())
    for f, trees in enumerate(forest.trees):
        other = values.copy()
        other[:, f] = np.nan if f == 0 else 0
        outside = np.setdiff1d(np.arange(len(forest.roots)), trees)
        assert forest.sums(other, outside).tolist() == forest.sums(values, outside).tolist()


def test_boosting_learns_and_ends_early():
    rows, held = frame(4000, 1), frame(2000, 2)
    settings = TreeSettings()
    nodes = boosting.fit(rows, "y", ["x", "z"], ["c"], settings)
    found = boosting.Forest(nodes).predict(held)
    y = held["y"].to_numpy()
    flat = boosting.poisson_loss(y, np.full(len(y), np.log(rows["y"].mean())))
    assert boosting.poisson_loss(y, np.log(found)) < flat - 0.2
    trees = nodes[nodes["tree"] >= 0].groupby("tree").size()
    assert 5 < len(trees) < settings.iterations and trees.max() <= 2 * settings.leaves - 1
    assert nodes["n_rows"].min() >= settings.min_leaf
    assert boosting.fit(rows, "y", ["x", "z"], ["c"], settings).equals(nodes)


def test_rows_without_anything_to_learn():
    rows = pd.DataFrame({"x": [np.nan] * 60, "c": [None] * 60, "y": [0.0] * 60})
    nodes = boosting.fit(rows, "y", ["x"], ["c"], TreeSettings())
    assert len(nodes) == 1 and boosting.Forest(nodes).predict(rows).max() < 1e-6


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of eight specs over 800 days and four series, one of them sparse."""
    start = dt.date(2022, 1, 1)
    chosen = np.random.default_rng(3)
    data = [
        (f"S{s}", f"L{s % 2}", f"ST{s}", start + dt.timedelta(d), start + dt.timedelta(d + h), h, float(chosen.poisson(3 + 4 * (d % 7 == 0) + s)), float(d % 7), float(chosen.normal()))
        for s in range(4) for d in range(800) for h in (1, 7)
    ]
    names = "series_id string, linea string, estacion string, forecast_origin_date date, target_date date, horizon_days int, trip_count_target double, calendar_day_of_week double, target_lag_1 double"
    frame = spark.createDataFrame(data, names).withColumn("baseline_naive_seasonal_weekly", F.lit(4.0))
    pairs = [("strict_available", "all_series"), ("strict_available", "sparse_excluded"), ("forecastable_scenario", "all_series")]
    late, dense = F.col("target_date") >= F.lit("2022-02-01").cast("date"), F.col("series_id") != "S3"
    held = [F.lit(True), dense, late]
    struct = "array<struct<variant:string,series_policy:string>>"
    specs = F.filter(F.array(*[F.when(h, F.struct(F.lit(v).alias("variant"), F.lit(p).alias("series_policy"))) for (v, p), h in zip(pairs, held)]), lambda s: s.isNotNull())
    return frame.withColumn("specs", specs.cast(struct))


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "store")
    models.save_models(models.fit_models(rows, TreeSettings(iterations=30), limit=700), path)
    return models.load_models(spark, path)


def test_models_of_all_specs_and_splits(stored, rows):
    heads = stored.filter("tree = -1").collect()
    assert len(heads) == 3 * 2 * 4 and len({(*[r[c] for c in models.SPEC], r.split_name) for r in heads}) == 24
    # One row in ten is held back for the validation loss.
    assert {r.n_rows for r in heads} == {630}
    by_spec = {tuple(r[c] for c in models.SPEC): r.n for r in models.fitting_rows(rows, None).groupBy(*models.SPEC).agg(F.count("*").alias("n")).collect()}
    assert by_spec["strict_available", "sparse_excluded", 1] * 4 == by_spec["strict_available", "all_series", 1] * 3


def test_backtest_promotion_and_serving(spark, stored, rows):
    predictions = models.run_backtest(stored, rows)
    error = predictions.groupBy("split_type").agg(
        F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("own"), F.avg(F.abs(F.col("y_true") - 4.0)).alias("flat")
    ).collect()
    assert len(error) == 2 and all(r.own < r.flat for r in error)
    decision = models.policy_of(predictions)
    assert decision.columns[0] == "recommended_series_policy" and decision.count() == 1
    for policy in ("all_series", "sparse_excluded"):
        promoted = models.promoted_models(stored, spark.createDataFrame([(policy,)], "recommended_series_policy string"))
        heads = promoted.filter("tree = -1").collect()
        assert {(r.variant, r.series_policy, r.split_name) for r in heads} == {("strict_available", policy, "test")}
        assert sorted(r.horizon_days for r in heads) == [1, 7]
        served = models.smoke_inference(rows, promoted, per_origin=3).collect()
        assert len(served) == 2 * 2 * 3 and {r.series_policy for r in served} == {policy}
        assert {r.series_id for r in served} == {"S0", "S1", "S2"}


def test_importance_of_permuted_features(stored, rows):
    test = models.scored_rows(rows).filter("split_type = 'test' AND variant = 'strict_available' AND series_policy = 'all_series'")
    chosen = stored.filter("split_type = 'test' AND variant = 'strict_available' AND series_policy = 'all_series'")
    found = {(r.horizon_days, r.feature_name): r.importance_mean for r in models.permutation_importance(chosen, test, repeats=3, blocks=4).collect()}
    names = {n for n in features.feature_columns("strict_available") if n in rows.columns}
    assert {n for _, n in found} == names
    for horizon in (1, 7):
        assert max(names, key=lambda n: found[horizon, n]) == "calendar_day_of_week"


def test_one_pass_gives_every_training_dataset(spark):
    """Rows of all specs, cut by spec, are the datasets that are built one by one."""
    from ridelake.catalog import derived
    from ridelake.catalog.roles import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    panel, external = derived.panel_features(t).cache(), features.external_features(derived.external(t)).cache()
    more = {"scenario_start": "1996-01-01", "sparse_series": ["NAD1", "NCD2"]}
    together = features.training_rows(panel, external, **more).select("*", F.inline("specs")).cache()
    for variant, policy, horizon in [(features.STRICT, features.SPARSE_EXCLUDED, 7), (features.SCENARIO, features.ALL_SERIES, 1)]:
        one = features.training_dataset(panel, external, variant, horizon, policy, **more)
        part = together.filter((F.col("variant") == variant) & (F.col("series_policy") == policy) & (F.col("horizon_days") == horizon))
        cut = features.select_features(part.withColumn("feature_variant", F.col("variant")), variant).select(*one.columns)
        assert cut.exceptAll(one).count() == one.exceptAll(cut).count() == 0 and one.count() > 0
