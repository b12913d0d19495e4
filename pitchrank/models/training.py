"""Fitting one weighted gradient-boosted regression per pitch type."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.models.boosting import TREES, Booster, fit_boosters, from_rows, tree_rows, with_predictions
from pitchrank.operators.scale import fit_scaler
from pitchrank.operators.validate import fit_metrics
from pitchrank.params import DEFAULTS, Settings
from pitchrank.schema import game_day
from pitchrank.session import materialize

RAW = "_raw"


@dataclass
class TypeModel:
    """What scoring one pitch type needs, and how well it did."""

    pitch_type: str
    model: Booster
    inputs: list[str]
    scaler: dict
    metrics: dict


def season_of(df: DataFrame):
    """Season of each row: the season column, else the year of the date."""
    if "season" in df.columns:
        return F.col("season")
    if "game_date" in df.columns:
        return F.year(game_day(F.col("game_date"), df.schema["game_date"].dataType))
    raise ValueError("a split by time needs a season or a game_date column")


def time_split(df: DataFrame, val_season: int) -> DataFrame:
    """Mark rows as ``train`` (earlier seasons) or ``val`` (that season); later rows get null.

    A table without season and date has no order to split by and is refused.
    """
    season = season_of(df)
    return df.withColumn(
        "split", F.when(season < val_season, "train").when(season == val_season, "val"))


def required_inputs(df: DataFrame, settings: Settings = DEFAULTS) -> list[str]:
    return [c for c in (*settings.model_inputs, P.LABEL)
            if c in df.columns and c not in P.NULLABLE_INPUTS]


def train_set(df: DataFrame, val_season: int | None = None, types=None,
              settings: Settings = DEFAULTS) -> DataFrame:
    """Rows fit for training, with their split and the row count that sizes the model.

    Types with too few rows, or without complete rows on either side of the split,
    are left out. ``val_season`` defaults to the latest season.
    """
    if val_season is None:
        val_season = df.agg(F.max(season_of(df))).first()[0]
    rows = df.where(F.col("pitch_type").isin(list(types or settings.model_types)))
    complete = F.lit(True)
    for c in required_inputs(df, settings):
        complete = complete & F.col(c).isNotNull()
    rows = time_split(rows, val_season).withColumn("_complete", complete)
    # at most one row per modelled type: a fixed, short list
    gates = rows.groupBy("pitch_type").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if("_complete").alias("rows_complete"),
        F.count_if(F.col("_complete") & (F.col("split") == "train")).alias("_train"),
        F.count_if(F.col("_complete") & (F.col("split") == "val")).alias("_val"),
    ).where((F.col("_all") >= settings.min_rows_per_model) & (F.col("_train") > 0) & (F.col("_val") > 0))
    return (
        rows.where("_complete AND split IS NOT NULL")
        .join(F.broadcast(gates.select("pitch_type", "rows_complete")), "pitch_type")
        .drop("_complete").select(*df.columns, "split", "rows_complete")
    )


def train_models(df: DataFrame, val_season: int | None = None, types=None,
                 settings: Settings = DEFAULTS) -> dict[str, TypeModel]:
    """Fit every type that passes the gates, all of them side by side.

    Training rows count by their pitches where the table tells them; the validation season
    decides when a type stops. Scaler and metrics come from one pass over the rows.
    """
    chosen = materialize(train_set(df, val_season, types, settings), "train")
    inputs = [c for c in settings.model_inputs if c in df.columns]
    # one row per modelled type
    sizes = {r["pitch_type"]: r["rows_complete"]
             for r in chosen.select("pitch_type", "rows_complete").distinct().collect()}
    params = {t: settings.small_boost if n < settings.small_model_below else settings.standard_boost
              for t, n in sizes.items()}
    boosters = fit_boosters(chosen, inputs, P.LABEL, params, "n_pitches" if "n_pitches" in df.columns else None)
    if not boosters:
        return {}
    scored = materialize(
        with_predictions(chosen, boosters, RAW).select("pitch_type", "split", P.LABEL, RAW), "fitted")
    scalers = {r["pitch_type"]: r.asDict() for r in fit_scaler(scored.where("split = 'train'"), RAW, settings).collect()}
    found = {r["pitch_type"]: r for r in fit_metrics(scored.where("split = 'val'"), P.LABEL, RAW).collect()}
    out = {}
    for t, booster in sorted(boosters.items()):
        scaler = {k: scalers[t][k] for k in ("mean_raw", "std_raw", "center", "scale")}
        metrics = {"rmse": found[t]["rmse"], "corr": found[t]["corr"], "best_iteration": booster.best}
        out[t] = TypeModel(t, booster, inputs, scaler, metrics)
    return out


def artifact_table(spark: SparkSession, models: dict[str, TypeModel]) -> DataFrame:
    """Scaler, metrics, start value and ordered inputs, one row per type."""
    rows = [
        (m.pitch_type, m.scaler["mean_raw"], m.scaler["std_raw"], m.scaler["center"], m.scaler["scale"],
         m.metrics["rmse"], m.metrics["corr"], m.metrics["best_iteration"], m.model.base, m.inputs)
        for m in models.values()
    ]
    return spark.createDataFrame(
        rows,
        "pitch_type string, mean_raw double, std_raw double, center double, scale double, "
        "rmse double, corr double, best_iteration int, base double, inputs array<string>",
    )


def tree_table(spark: SparkSession, models: dict[str, TypeModel]) -> DataFrame:
    """All nodes of all trees, one row each."""
    return spark.createDataFrame([row for m in models.values() for row in tree_rows(m.pitch_type, m.model)], TREES)


def save_models(spark: SparkSession, models: dict[str, TypeModel], root: str) -> None:
    """Write the trees of all types and, next to them, the small table of what else scoring needs."""
    tree_table(spark, models).coalesce(1).write.mode("overwrite").parquet(f"{root}/trees")
    artifact_table(spark, models).coalesce(1).write.mode("overwrite").parquet(f"{root}/artifacts")


def load_models(spark: SparkSession, root: str) -> dict[str, TypeModel]:
    nodes = defaultdict(list)
    for r in spark.read.schema(TREES).parquet(f"{root}/trees").collect():  # rounds x nodes of a few types
        nodes[r["pitch_type"]].append(r)
    out = {}
    for r in sorted(spark.read.parquet(f"{root}/artifacts").collect(), key=lambda r: r["pitch_type"]):
        inputs = list(r["inputs"])
        out[r["pitch_type"]] = TypeModel(
            r["pitch_type"], from_rows(inputs, r["base"], r["best_iteration"], nodes[r["pitch_type"]]), inputs,
            {k: r[k] for k in ("mean_raw", "std_raw", "center", "scale")},
            {k: r[k] for k in ("rmse", "corr", "best_iteration")})
    return out


def feature_importance(spark: SparkSession, models: dict[str, TypeModel], top: int = 15) -> DataFrame:
    """The most important inputs of each type's model by mean gain, most important first."""
    rows = []
    for m in models.values():
        shares = m.model.importance()
        order = sorted(range(len(shares)), key=lambda i: (-shares[i], i))[:top]
        rows += [(m.pitch_type, place + 1, m.inputs[i], float(shares[i])) for place, i in enumerate(order)]
    return spark.createDataFrame(rows, "pitch_type string, place int, feature string, importance double")
