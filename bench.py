"""Times the main operators on one season of stored pitches; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. The pitch table and the tables
between the steps are written first, untimed; every timing then starts from a
stored table and runs to the last row. One warm-up, then the median of three; ingest
and models, which take long, once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F, types as T  # noqa: E402

from pitchrank.fixtures import pitch_view  # noqa: E402
from pitchrank.models.scoring import score_profiles  # noqa: E402
from pitchrank.models.training import train_models  # noqa: E402
from pitchrank.operators import boards, profile as prof  # noqa: E402
from pitchrank.operators.clean import clean  # noqa: E402
from pitchrank.operators.features import build_features  # noqa: E402
from pitchrank.operators.scale import apply_scaler, fit_scaler  # noqa: E402
from pitchrank.operators.tunnel import add_tunnel_features  # noqa: E402
from pitchrank.operators.validate import rank_correlations, score_histogram  # noqa: E402
from pitchrank.operators.zscore import add_zscores  # noqa: E402
from pitchrank.params import LABEL, Settings  # noqa: E402
from pitchrank.plans.fused import profiles_from_raw  # noqa: E402
from pitchrank.plans.queries import QUERIES  # noqa: E402
from pitchrank.schema import PITCH_SCHEMA  # noqa: E402
from pitchrank.session import build_session, materialize  # noqa: E402

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    settings = Settings() if sf_dir.rstrip("/").endswith("sf0.1") else Settings(min_pitches_per_type=20)

    # the tables come as one file; a store of this size would be several. Columns the view lacks
    # are filled, so that a season is read with all its declared columns
    view = pitch_view(spark, sf_dir)
    filler = {T.StringType(): F.col("description"), T.DoubleType(): F.col("release_speed") * F.rand(1)}
    view = view.withColumns({f.name: filler.get(f.dataType, F.col("game_pk") % 97).cast(f.dataType)
                             for f in PITCH_SCHEMA if f.name not in view.columns})
    whole = materialize(view.repartition(int(cpus)), "whole")
    raw = materialize(pitch_view(spark, sf_dir).repartition(int(cpus)), "raw")
    cleaned = materialize(clean(raw, settings), "clean")
    features = materialize(build_features(cleaned, settings), "features")
    summaries = materialize(prof.keep_complete(prof.summarize(features, settings), features.columns, settings), "summaries")
    neighbours = materialize(add_tunnel_features(summaries), "neighbours")
    profiles = materialize(prof.profile(features, settings), "profiles")
    scored = materialize(apply_scaler(profiles, fit_scaler(profiles, LABEL), LABEL), "scored")

    queries = {
        "season_read": lambda: whole,
        "season_read_4_columns": lambda: whole.select("pitcher", "pitch_type", "release_speed", "game_date"),
        "clean": lambda: clean(raw, settings),
        "physics_features": lambda: build_features(cleaned, settings),
        "profile": lambda: prof.profile(features, settings),
        "profile_from_raw": lambda: profiles_from_raw(raw, settings),
        "nearest_in_group": lambda: add_tunnel_features(summaries),
        "zscore_in_group": lambda: add_zscores(neighbours),
        "leaderboard_recent": lambda: boards.leaderboard(boards.most_recent(scored)),
        "career": lambda: boards.career(scored),
        "score_histogram": lambda: score_histogram(scored),
        "spearman_by_type": lambda: rank_correlations(scored, settings),
    }
    def timed(build) -> float:
        start = time.perf_counter()
        if (result := build()) is not None:
            result.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name, build in queries.items():
        times = [timed(build) for _ in range(RUNS + 1)]
        seconds[name] = round(statistics.median(times[1:]), 3)
    # the dear ones, once each
    seconds["profile_incremental"] = round(timed(lambda: QUERIES["profile_incremental"](spark, sf_dir)), 3)
    seconds["refresh_months"] = round(timed(lambda: QUERIES["refresh_months"](spark, sf_dir)), 3)
    seconds["stream_ingest"] = round(timed(lambda: QUERIES["stream_ingest"](spark, sf_dir)), 3)
    models: dict = {}
    seconds["train"] = round(timed(lambda: models.update(train_models(
        profiles, settings=settings))), 3)
    seconds["score"] = round(timed(lambda: score_profiles(profiles, models)), 3)
    rows = raw.agg(F.count(F.lit(1))).first()[0]
    spark.stop()
    print(json.dumps({
        "metric": "pitch scoring, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows}))


if __name__ == "__main__":
    main()
