import os
from datetime import date

import numpy as np
import pytest

from pitchrank.params import BoostParams, Settings
from pitchrank.plans import jobs
from pitchrank.sources.tables import read_board, read_table

QUICK = BoostParams(rounds=4, depth=2, learning_rate=0.3, min_child_weight=5, patience=2)
SMALL = Settings(min_pitches_per_season=10, min_pitches_per_type=5, board_min_pitches=5,
                 standard_boost=QUICK, small_boost=QUICK, train_seasons=(2024, 2025), current_season=2026)


def landing(pitches):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(6000):
        p = int(rng.integers(1, 41))
        rows.append(dict(
            game_pk=i, pitcher=p, player_name=f"P{p}",
            game_date=date(int(rng.integers(2024, 2027)), int(rng.integers(5, 9)), 3),
            pitch_type=str(rng.choice(["FF", "SL"])), release_speed=float(rng.uniform(80, 100)),
            pfx_x=float(rng.normal()), az=float(rng.normal(-16, 4)), vx0=float(rng.normal(0, 3)),
            release_pos_x=float(rng.normal(0, 1)), spin_axis=float(rng.uniform(0, 360)),
            description=str(rng.choice(["ball", "swinging_strike", "called_strike"])), type="S"))
    return pitches(rows)


def test_all_steps(spark, pitches, tmp_path):
    root = str(tmp_path / "work")
    jobs.run(spark, root, landing=landing(pitches), include_current=True, today=date(2026, 9, 1), settings=SMALL)
    scored = read_table(spark, f"{root}/scored")
    assert scored.where("score IS NOT NULL").count() == scored.count() > 200
    board = read_board(spark, f"{root}/boards/all").collect()
    assert board and {r.season for r in board} == {2026}
    assert len({(r.pitcher, r.pitch_type) for r in board}) == len(board)
    assert set(os.listdir(f"{root}/boards")) >= {
        "all", "by_type", "by_group", "career", "importance", "rank_correlations", "histogram"}
    # any step again, on its own
    jobs.run(spark, root, ["train", "evaluate"], types=("SL",), val_season=2025, settings=SMALL)
    again = read_table(spark, f"{root}/scored")
    assert {r[0] for r in again.where("score IS NOT NULL").select("pitch_type").distinct().collect()} == {"SL"}


def test_steps_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.run(spark, str(tmp_path), ["paint"])
    with pytest.raises(ValueError):
        jobs.run(spark, str(tmp_path), ["fetch"])
    with pytest.raises(FileNotFoundError):
        jobs.run(spark, str(tmp_path), ["aggregate"])
