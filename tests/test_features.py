import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchrank.operators import features as X


def flight(r):
    """Straightforward arithmetic for one ordinary pitch."""
    root = math.sqrt(r["vy0"] ** 2 + 2 * r["ay"] * (1.417 - r["release_pos_y"]))
    t = (-r["vy0"] - root) / r["ay"]
    tt = (-r["vy0"] - math.sqrt(r["vy0"] ** 2 + 2 * r["ay"] * (26.5 - r["release_pos_y"]))) / r["ay"]
    at = lambda axis, p, t: r[p] + r[f"v{axis}0"] * t + r[f"a{axis}"] * t * t / 2
    return {
        "vaa": math.degrees(math.atan((r["vz0"] + r["az"] * t) / root)),
        "haa": math.degrees(math.atan((r["vx0"] + r["ax"] * t) / root)),
        "tunnel_x": at("x", "release_pos_x", tt), "tunnel_z": at("z", "release_pos_z", tt),
        "plate_x_kin": at("x", "release_pos_x", t), "plate_z_kin": at("z", "release_pos_z", t),
    }


def test_flight_matches_plain_arithmetic(pitches):
    rng = np.random.default_rng(1)
    rows = [{"game_pk": i, "vx0": rng.normal(0, 4), "vy0": -rng.uniform(100, 150), "vz0": rng.normal(-4, 2),
             "ax": rng.normal(0, 8), "ay": rng.uniform(20, 35), "az": rng.normal(-20, 6),
             "release_pos_x": rng.normal(0, 2), "release_pos_y": rng.uniform(52, 56),
             "release_pos_z": rng.uniform(4, 7)} for i in range(50)]
    rows = [{k: (v if k == "game_pk" else float(v)) for k, v in r.items()} for r in rows]
    got = {r["game_pk"]: r for r in X.build_features(pitches(rows)).collect()}
    for r in rows:
        for name, value in flight(r).items():
            assert got[r["game_pk"]][name] == pytest.approx(value, abs=1e-9), name


def test_flight_at_its_limits(pitches):
    still, unknown, steep = X.build_features(pitches([
        {"game_pk": 0, "ay": 0.0}, {"game_pk": 1, "release_pos_y": None},
        {"game_pk": 2, "vy0": -10.0, "ay": 30.0},  # never reaches the plate
    ])).orderBy("game_pk").collect()
    for r in (still, unknown):
        assert r.vaa is None and r.haa is None and r.tunnel_x is None and r.plate_z_kin is None
    assert steep.vaa == pytest.approx(-90.0)


def test_absent_columns_give_null(pitches):
    r = X.build_features(pitches([{}], drop=["vx0", "spin_axis"])).first()
    assert r.haa is None and r.tunnel_x is None and r.spin_efficiency is None and r.vaa is not None
    r = X.build_features(pitches([{}], drop=["vy0"])).first()
    assert r.vaa is None and r.plate_x_kin is None


def test_spin_efficiency(pitches):
    rows = [{"game_pk": 0, "spin_axis": 180.0, "pfx_x": 0.0, "pfx_z": 9.0, "release_spin_rate": 2400.0,
             "release_speed": 95.0}, {"game_pk": 1, "spin_axis": None},
            {"game_pk": 2, "spin_axis": 0.0, "pfx_z": 9.0}, {"game_pk": 3, "spin_axis": 180.0, "pfx_z": 30.0,
                                                             "release_spin_rate": 0.0}]
    got = [r.spin_efficiency for r in X.add_spin_efficiency(pitches(rows)).orderBy("game_pk").collect()]
    assert got == pytest.approx([0.5, None, -0.05, 1.25])


def test_arm_side(pitches):
    rows = [{"game_pk": 0, "p_throws": "R"}, {"game_pk": 1, "p_throws": "L"}, {"game_pk": 2, "p_throws": None}]
    got = [r.arm_side_break for r in X.build_features(pitches(rows)).orderBy("game_pk").collect()]
    assert got == [-0.5, 0.5, 0.5]


def test_speed_diff(pitches):
    from datetime import date

    rows = [
        {"game_pk": 0, "release_speed": 96.0}, {"game_pk": 1, "release_speed": 92.0, "pitch_type": "SI"},
        {"game_pk": 2, "release_speed": 84.0, "pitch_type": "SL"},
        {"game_pk": 3, "release_speed": 80.0, "pitch_type": "SL", "game_date": date(2022, 5, 1)},
        {"game_pk": 4, "release_speed": 80.0, "pitch_type": "CH", "pitcher": 2},
        {"game_pk": 5, "release_speed": 80.0, "pitch_type": "CH", "pitcher": None},
    ]
    df = pitches(rows)
    got = [r.speed_diff for r in X.add_speed_diff(df).orderBy("game_pk").collect()]
    assert got == pytest.approx([0.0, 2.0, 10.0, 0.0, 0.0, 0.0])
    # over all seasons if there is no date
    got = [r.speed_diff for r in X.add_speed_diff(df.drop("game_date")).orderBy("game_pk").collect()]
    assert got == pytest.approx([0.0, 2.0, 10.0, 14.0, 0.0, 0.0])
    assert X.add_speed_diff(df).columns == [*df.columns, "speed_diff"]
    assert df.where(F.col("pitcher").isNull()).count() == 1
