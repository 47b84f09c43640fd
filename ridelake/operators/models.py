"""Tabular demand models of all training specs: fits, back-tests, store, importance, scoring.

A spec is (variant, series policy, horizon). Its models, one per temporal split, are fitted side
by side: one group of an aggregation holds the bounded labelled rows of one model. A model is the
rows of its trees, so that models are stored, promoted and read like any other table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.functions import domain
from ridelake.operators import backtest, boosting, panel
from ridelake.operators.boosting import TreeSettings
from ridelake.operators.features import (
    ALL_SERIES,
    CATEGORICAL_FEATURES,
    HORIZONS,
    SCENARIO,
    STRICT,
    feature_columns,
)
from ridelake.operators.scale import dense_index

MODEL_NAME = "tabular_hgbr"
SPEC = ["variant", "series_policy", "horizon_days"]
KEY = ["series_id", "forecast_origin_date"]
TARGET = "trip_count_target"
#: Labelled rows that one model is fitted on, those with the smallest hashes of their keys.
MAX_LABELLED_ROWS = 10_000
MODEL_SCHEMA = (
    "variant string, series_policy string, horizon_days int, split_name string, split_type string, tree int, node int, "
    "feature string, threshold double, category string, missing_left boolean, left int, right int, value double, "
    "gain double, n_rows long"
)

MODEL_COLUMNS = [f.split()[0] for f in MODEL_SCHEMA.split(", ")]


def split_columns(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Present features as (numeric, categorical)."""
    present = [c for c in features if c in df.columns]
    textual = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    categorical = [c for c in present if c in textual or c in CATEGORICAL_FEATURES]
    return [c for c in present if c not in categorical], categorical


def spec_columns(variant: str, policy: str = ALL_SERIES) -> Column:
    """``specs`` of rows that are all of one variant and policy."""
    return F.array(F.struct(F.lit(variant).alias("variant"), F.lit(policy).alias("series_policy")))


def key_hash(*names: str) -> Column:
    """Hash that orders rows for a bounded choice, the same in any engine."""
    return F.md5(F.concat_ws("|", *[F.col(n).cast("string") for n in names]))


def fitting_rows(rows: DataFrame, limit: int | None = MAX_LABELLED_ROWS) -> DataFrame:
    """Rows that the models of all specs and splits are fitted on, once per model.

    ``rows`` (of :func:`features.training_rows`) have ``specs``. Only keys are exploded and cut,
    within each task before the shuffle; the rows themselves are joined to those that stay.
    """
    keys = rows.select(*KEY, "horizon_days", F.inline("specs"))
    trained = backtest.assign_splits(keys, by=SPEC, role="train")
    if limit is not None:
        ranked = Window.partitionBy(*SPEC, "split_name").orderBy(key_hash(*KEY), *KEY)
        trained = trained.withColumn("_i", F.row_number().over(ranked)).filter(F.col("_i") <= limit).drop("_i")
    return trained.join(rows.drop("specs"), [*KEY, "horizon_days"])


def _names(rows: DataFrame) -> dict[str, tuple[list[str], list[str]]]:
    return {v: split_columns(rows, feature_columns(v)) for v in (STRICT, SCENARIO)}


def fit_models(
    rows: DataFrame, settings: TreeSettings = TreeSettings(), *, limit: int | None = MAX_LABELLED_ROWS, target: str = TARGET
) -> DataFrame:
    """Trees of every spec and split as rows of :data:`MODEL_SCHEMA`.

    A group has at most ``limit`` rows and is fitted in one task, all models in one job.
    """
    names = _names(rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[[*SPEC, "split_name", "split_type"]].iloc[0]
        # Groups arrive in any order of rows; sums of numbers depend on it in the last digits.
        ordered = frame.sort_values(KEY, ignore_index=True)
        nodes = boosting.fit(ordered, target, *names[head["variant"]], settings)
        return pd.DataFrame({c: nodes[c] if c in nodes else pd.Series([head[c]] * len(nodes), dtype=object) for c in MODEL_COLUMNS})

    chosen = fitting_rows(rows, limit)
    return chosen.groupBy(*SPEC, "split_name").applyInPandas(run, MODEL_SCHEMA)


def save_models(models: DataFrame, path: str) -> None:
    """Write models, one folder per spec; only the specs that are written are replaced."""
    models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SPEC).parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(MODEL_SCHEMA).parquet(path)
    return stored.select(*MODEL_COLUMNS)


class _Forests:
    """Models on their way to tasks: at most specs x splits x trees x (2 x leaves - 1) rows."""

    def __init__(self, models: DataFrame):
        columns = [*SPEC, "split_name", "tree", "node", "feature", "threshold", "category", "missing_left", "left", "right", "value"]
        table = models.select(*columns).toArrow()
        self.shared = models.sparkSession.sparkContext.broadcast(table)
        self.built: dict[tuple, boosting.Forest] = {}

    def __getstate__(self):
        return {"shared": self.shared, "built": {}}

    def of(self, key: tuple) -> boosting.Forest:
        if key not in self.built:
            mask = None
            for name, value in zip([*SPEC, "split_name"], key, strict=True):
                one = pa.compute.equal(self.shared.value[name], value)
                mask = one if mask is None else pa.compute.and_(mask, one)
            self.built[key] = boosting.Forest(self.shared.value.filter(mask).to_pandas())
        return self.built[key]


def _by_model(frame: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
    for key, places in frame.groupby([*SPEC, "split_name"]).indices.items():
        variant, policy, horizon, split = key
        yield (variant, policy, int(horizon), split), places


def score(models: DataFrame, rows: DataFrame, *, clip: bool = True) -> DataFrame:
    """Rows with ``y_pred`` of the model of their spec and ``split_name``; back-tests clip at
    zero, serving does not. A row without such a model raises."""
    forests = _Forests(models)
    wanted = [c for v in (STRICT, SCENARIO) for c in feature_columns(v) if c in rows.columns]
    wanted = list(dict.fromkeys([*SPEC, "split_name", *wanted]))
    kept = rows.drop("y_pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            frame = batch.select(wanted).to_pandas()
            found = np.zeros(len(frame))
            for key, places in _by_model(frame):
                found[places] = forests.of(key).predict(frame.iloc[places])
            yield batch.append_column("y_pred", pa.array(np.maximum(found, 0.0) if clip else found))

    schema = T.StructType([*kept.schema.fields, T.StructField("y_pred", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def scored_rows(rows: DataFrame) -> DataFrame:
    """Rows once per spec and split in which they are scored."""
    return backtest.assign_splits(rows.select("*", F.inline("specs")).drop("specs"), by=SPEC)


def run_backtest(models: DataFrame, rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Clipped predictions of every spec and split in long form.

    The rows hold the columns of ``backtest.SPEC_COLUMNS``, the split, the keys, ``y_true`` and
    ``y_pred``, and the seasonal baseline of the same rows.
    """
    found = score(models, scored_rows(rows))
    return found.select(
        F.lit(MODEL_NAME).alias("model_name"), *SPEC, "split_name", "split_type", "series_id", "linea",
        "forecast_origin_date", "target_date", F.col(target).cast("double").alias("y_true"), "y_pred",
        "baseline_naive_seasonal_weekly",
    )


def policy_of(predictions: DataFrame, variant: str = STRICT) -> DataFrame:
    """One row: the series policy that the test metrics of a variant recommend."""
    test = predictions.filter((F.col("split_type") == "test") & (F.col("variant") == variant))
    by_spec = backtest.forecast_metrics(test, ["series_policy", "horizon_days"])
    by_line = backtest.forecast_metrics(test, ["series_policy", "horizon_days", "linea"])
    return backtest.recommended_policy(backtest.select_policy(by_spec, by_line))


def promoted_models(models: DataFrame, decision: DataFrame, variant: str = STRICT) -> DataFrame:
    """Models of the test split of the decided policy, one per horizon. ``decision`` has one row."""
    policy = F.broadcast(decision.select(F.col("recommended_series_policy").alias("series_policy")))
    tested = models.filter((F.col("variant") == variant) & (F.col("split_type") == "test"))
    return tested.join(policy, "series_policy").select(*models.columns)


def promoted_rows(rows: DataFrame, promoted: DataFrame) -> DataFrame:
    """Rows of the promoted specs, with the split whose models are promoted."""
    specs = F.broadcast(promoted.select(*SPEC, "split_name").distinct())
    return rows.select("*", F.inline("specs")).drop("specs").join(specs, SPEC)


def smoke_inference(rows: DataFrame, promoted: DataFrame, per_origin: int = 10, dates: DataFrame | None = None) -> DataFrame:
    """Predictions of the newest origins by the promoted models, not clipped."""
    every = promoted_rows(rows, promoted)
    chosen = None
    for horizon in HORIZONS:
        part = panel.smoke_rows(every.filter(F.col("horizon_days") == horizon), per_origin, dates)
        chosen = part if chosen is None else chosen.unionByName(part)
    return score(promoted, chosen, clip=False).select(
        "forecast_origin_date", "target_date", "series_id", "linea", "estacion", F.lit(MODEL_NAME).alias("model_name"),
        *SPEC, F.col(TARGET).alias("y_true_if_available"), "y_pred",
    )


#: Steps of the permutations, coprime to a row count unless they divide it.
_PRIMES = [1_000_003, 15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121, 104_395_301, 122_949_823, 141_650_939, 160_481_183]


def donors(rows: DataFrame, repeats: int, key: Sequence[str], values: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Every row once per repeat, with ``donor``: the ``values`` of the row it is exchanged with.

    Rows get a dense index; the donor of row ``i`` is ``(a * i + b) mod n`` with ``a`` coprime to
    ``n``, a permutation that needs no global sort. One equi-join serves all features.
    """
    indexed = dense_index(rows, key, "_index", blocks)
    n = rows.select(F.count("*")).scalar()
    given = indexed.select(F.col("_index").alias("_donor"), F.struct(*values).alias("donor"))
    steps = [F.struct(F.lit(r).alias("repeat"), F.lit(_PRIMES[r % len(_PRIMES)]).cast("long").alias("_a")) for r in range(repeats)]
    spread = indexed.withColumn("_n", n).withColumn("_r", F.explode(F.array(*steps))).select("*", "_r.*").drop("_r")
    # A step that divides the row count only rotates the rows.
    factor = F.when(F.col("_n") % F.col("_a") != 0, F.col("_a")).otherwise(1)
    place = F.pmod(F.col("_index") * factor + F.col("repeat") * 7919 + 1, F.col("_n"))
    return spread.withColumn("_donor", place).join(given, "_donor").drop("_donor", "_index", "_n", "_a")


def permutation_importance(
    models: DataFrame, rows: DataFrame, *, repeats: int = 10, target: str = TARGET, blocks: int | None = None
) -> DataFrame:
    """Mean and deviation, over repeats, of the rise in MAE when a feature is permuted.

    ``rows`` are those of one or more models, with their spec and ``split_name``; values are
    exchanged within a spec. A feature's exchange changes only the trees that test it, and only
    rows whose value differs, so that only those are walked again; tasks return sums of errors.
    """
    forests = _Forests(models)
    wanted = [c for v in (STRICT, SCENARIO) for c in feature_columns(v) if c in rows.columns]
    wanted = list(dict.fromkeys(wanted))
    names = _names(rows)
    specs = models.select(*SPEC, "split_name").distinct().collect()  # one row per model
    parts = []
    for spec in specs:
        own = rows
        for c in (*SPEC, "split_name"):
            own = own.filter(F.col(c) == F.lit(spec[c]))
        parts.append(donors(own, repeats, KEY, wanted, blocks))
    exchanged = parts[0]
    for part in parts[1:]:
        exchanged = exchanged.unionByName(part)
    exchanged = exchanged.select(*SPEC, "split_name", *[c for c in wanted if c not in SPEC], target, "repeat", "donor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            frame = batch.drop_columns(["donor"]).to_pandas()
            given = pa.Table.from_struct_array(batch.column("donor")).to_pandas()
            y = boosting.as_numbers(frame[target])
            for key, places in _by_model(frame):
                forest = forests.of(key)
                values, other = forest.matrix(frame.iloc[places]), forest.matrix(given.iloc[places])
                raw = forest.base + forest.sums(values)
                error = np.abs(np.maximum(np.exp(raw), 0) - y[places])
                repeat = frame["repeat"].to_numpy()[places]
                for name in [n for part in names[key[0]] for n in part]:
                    changed = error
                    if name in forest.names:
                        f = forest.names.index(name)
                        differs = np.flatnonzero(~((values[:, f] == other[:, f]) | (np.isnan(values[:, f]) & np.isnan(other[:, f]))))
                        mixed = values[differs].copy()
                        mixed[:, f] = other[differs, f]
                        moved = forest.sums(mixed, forest.trees[f]) - forest.sums(values[differs], forest.trees[f])
                        changed = error.copy()
                        changed[differs] = np.abs(np.exp(raw[differs] + moved) - y[places][differs])
                    total = sums.setdefault((*key, name), np.zeros((3, repeats)))
                    total += [np.bincount(repeat, w, repeats) for w in (np.ones(len(error)), error, changed)]
        out = [(*key, r, *total[:, r].tolist()) for key, total in sums.items() for r in range(repeats)]
        columns = zip(*out, strict=True) if out else [[]] * 9
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=[*SPEC, "split_name", "feature_name", "repeat", "n", "before", "after"],
        )

    schema = (
        "variant string, series_policy string, horizon_days int, split_name string, feature_name string, repeat int, "
        "n double, before double, after double"
    )
    found = exchanged.mapInArrow(run, schema)
    per_repeat = found.groupBy(*SPEC, "split_name", "feature_name", "repeat").agg(
        ((F.sum("after") - F.sum("before")) / F.sum("n")).alias("_rise")
    )
    return per_repeat.groupBy(F.lit(MODEL_NAME).alias("model_name"), *SPEC, "feature_name").agg(
        F.avg("_rise").alias("importance_mean"), F.stddev_pop("_rise").alias("importance_std")
    )


def scenario_inference(models: DataFrame, rows: DataFrame, variant: str = STRICT, horizon_days: int = 1) -> DataFrame:
    """Predictions of scenario feature rows by a variant's model, with the hash of their features.

    ``models`` are promoted ones; features that ``rows`` lack are missing. Rows are scored once per
    scenario they belong to; the hash is of the model's features.
    """
    names = feature_columns(variant)
    known = models.filter((F.col("variant") == variant) & (F.col("horizon_days") == horizon_days))
    spec = F.broadcast(known.select("variant", "series_policy", "split_name").distinct())
    absent = {c: F.lit(None).cast("string" if c in CATEGORICAL_FEATURES else "double") for c in names if c not in rows.columns}
    given = rows.withColumns(absent).withColumn("feature_row_hash", domain.row_hash(*names))
    given = given.withColumns({"horizon_days": F.lit(horizon_days), "variant": F.lit(variant)}).join(spec, "variant")
    return score(known, given, clip=False).select(
        "execution_id", "target_date", "forecast_origin_date", "series_id", "linea", "estacion", *SPEC,
        F.round("y_pred", 6).alias("y_pred"), F.lit("model_inference").alias("prediction_mode"), "feature_row_hash",
    )
