"""The six steps as jobs over stored tables.

    jobs.run(spark, "/data/pitches", ["features", "aggregate"])

Tables under the root: ``raw`` (the store), ``clean``, ``features``, ``profiles``,
``models``, ``scored`` and ``boards``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from pitchrank.models.scoring import score_profiles
from pitchrank.models.training import feature_importance, load_models, save_models, train_models
from pitchrank.operators import boards as B
from pitchrank.operators.clean import clean
from pitchrank.operators.features import build_features
from pitchrank.operators.profile import profile
from pitchrank.operators.validate import rank_correlations, score_histogram
from pitchrank.params import DEFAULTS, Settings
from pitchrank.sources.landing import ingest_season, refresh_months
from pitchrank.sources.tables import load_seasons, read_table, save_board, write_table

STEPS = ("fetch", "preprocess", "features", "aggregate", "train", "evaluate")


@dataclass
class Job:
    """Where a run reads and writes, and what it covers."""

    root: str
    landing: DataFrame | None = None
    seasons: tuple | None = None
    include_current: bool = False
    types: tuple | None = None
    val_season: int | None = None
    force: bool = False
    today: date | None = None
    settings: Settings = field(default_factory=lambda: DEFAULTS)

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def fetch(spark: SparkSession, job: Job) -> None:
    if job.landing is None:
        raise ValueError("fetching needs a landing table")
    for season in job.seasons or job.settings.train_seasons:
        ingest_season(spark, job.landing, job.table("raw"), season, job.force, job.today)
    if job.include_current:
        refresh_months(spark, job.landing, job.table("raw"), today=job.today,
                       force=job.force, settings=job.settings)


def preprocess(spark: SparkSession, job: Job) -> None:
    raw = load_seasons(spark, job.table("raw"), job.seasons, job.include_current, settings=job.settings)
    write_table(clean(raw.drop("season", "month"), job.settings), job.table("clean"))


def features(spark: SparkSession, job: Job) -> None:
    write_table(build_features(read_table(spark, job.table("clean")), job.settings), job.table("features"))


def aggregate(spark: SparkSession, job: Job) -> None:
    profiles = profile(read_table(spark, job.table("features")), job.settings)
    # models and leaderboards read one type at a time
    write_table(profiles, job.table("profiles"), partition_by=["pitch_type"])


def train(spark: SparkSession, job: Job) -> None:
    models = train_models(read_table(spark, job.table("profiles")), job.val_season, job.types, job.settings)
    save_models(spark, models, job.table("models"))


def evaluate(spark: SparkSession, job: Job) -> None:
    """Score the profiles and write every output table."""
    models = load_models(spark, job.table("models"))
    scored = score_profiles(read_table(spark, job.table("profiles")), models)
    write_table(scored, job.table("scored"), partition_by=["pitch_type"])
    scored = read_table(spark, job.table("scored"))
    recent = B.most_recent(scored)
    minimum = job.settings.board_min_pitches

    def out(name):
        return job.table(f"boards/{name}")

    save_board(B.leaderboard(recent, minimum), out("all"))
    save_board(B.leaderboards_by(recent, "pitch_type", minimum), out("by_type"), "pitch_type")
    save_board(B.leaderboards_by(recent, "pitch_group", minimum), out("by_group"), "pitch_group")
    save_board(B.career(scored), out("career"))
    save_board(feature_importance(spark, models), out("importance"))
    save_board(rank_correlations(scored, job.settings), out("rank_correlations"))
    save_board(score_histogram(scored), out("histogram"))


_RUN = dict(zip(STEPS, (fetch, preprocess, features, aggregate, train, evaluate)))


def run(spark: SparkSession, root: str, steps=STEPS, **options) -> Job:
    """Run any of the steps, in the order given."""
    unknown = [s for s in steps if s not in _RUN]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; choose from {', '.join(STEPS)}")
    job = Job(root, **options)
    for step in steps:
        _RUN[step](spark, job)
    return job
