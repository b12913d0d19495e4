import math
from datetime import date

import numpy as np
import pytest

from pitchrank.operators import profile as R
from pitchrank.operators.clean import clean
from pitchrank.operators.features import build_features
from pitchrank.operators.tunnel import add_tunnel_features, tunnel_summary
from pitchrank.params import Settings
from pitchrank.plans.fused import profiles_from_raw

LOW = Settings(min_pitches_per_season=5, min_pitches_per_type=2)


def season_rows(seed=5):
    """Pitchers with several types, one of them two-handed, names with typos, some gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        p = int(rng.integers(1, 6))
        rows.append(dict(
            game_pk=i, pitcher=p, player_name=f"P{p}" + ("?" if rng.random() < 0.1 else ""),
            game_date=date(int(rng.integers(2021, 2023)), 5, 1),
            pitch_type=str(rng.choice(["FF", "SL", "CH", "FT", "AB", "XX"])),
            release_speed=float(rng.uniform(60, 100)), pfx_x=float(rng.normal()), pfx_z=float(rng.normal()),
            release_pos_x=float(rng.normal(0, 3)), vx0=float(rng.normal(0, 3)), az=float(rng.normal(-16, 4)),
            spin_axis=None if rng.random() < 0.1 else float(rng.uniform(0, 360)),
            release_spin_rate=None if rng.random() < 0.05 else 2200.0,
            description=str(rng.choice(["ball", "foul_tip", "called_strike", "hit_into_play", "odd"])),
            type="B", p_throws=str(rng.choice(["L", "R"])) if p == 1 else "R", balls=int(rng.integers(0, 5))))
    return rows + [dict(game_pk=999, pitcher=None), dict(game_pk=998, game_date=None)]


def as_dict(df):
    return {tuple(r[k] for k in ("pitcher", "season", "pitch_type", "p_throws_enc")): r.asDict() for r in df.collect()}


def test_two_scans_equal_the_chain(pitches):
    raw = pitches(season_rows())
    chained = as_dict(R.profile(build_features(clean(raw, LOW), LOW), LOW))
    fused = as_dict(profiles_from_raw(raw, LOW))
    assert chained.keys() == fused.keys() and len(chained) > 20
    for key, row in chained.items():
        assert row == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in fused[key].items()}


def test_nothing_changes_beyond_the_broadcast_limit(pitches, monkeypatch):
    """Every lookup too large to broadcast, and a pitcher with a third of the pitches."""
    from pitchrank.operators import joins

    rows = season_rows()
    hot = [{**r, "game_pk": 1000 + i, "pitcher": 77, "player_name": "H", "game_date": date(2022, 5, 1)}
           for i, r in enumerate(rows[:200])]
    raw = pitches(rows + hot)
    small = as_dict(profiles_from_raw(raw, LOW))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    large = as_dict(profiles_from_raw(raw, LOW))
    assert small.keys() == large.keys()
    for key, row in small.items():
        assert row == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in large[key].items()}


def test_profiles_match_pandas(pitches):
    feats = build_features(clean(pitches(season_rows()), LOW), LOW)
    got = as_dict(R.profile(feats, LOW))
    pdf = feats.toPandas()
    pdf["season"] = [d.year for d in pdf.game_date]
    pdf["w"] = pdf.description.isin(["foul_tip"]).astype(float)
    pdf["c"] = pdf.description.isin(["foul_tip", "called_strike"]).astype(float)
    names = pdf.groupby("pitcher").player_name.agg(lambda s: s.mode().iloc[0])
    groups = {k: g for k, g in pdf.groupby(["pitcher", "season", "pitch_type", "p_throws_enc"])
              if len(g) >= 2 and g.spin_efficiency.notna().any()}
    assert set(groups) == set(got)
    assert any(k[0] == 1 and k[3] == 0 for k in got) and any(k[0] == 1 and k[3] == 1 for k in got)
    for key, g in groups.items():
        r = got[key]
        assert r["n_pitches"] == len(g)
        assert r["player_name"] == names[key[0]]
        for c in ("lw_run_value", "release_speed", "spin_axis", "vaa", "speed_diff", "spin_efficiency"):
            assert r[c] == pytest.approx(g[c].mean()), c
        assert r["whiff_rate"] == pytest.approx(g.w.mean()) and r["csw_rate"] == pytest.approx(g.c.mean())
        spread = math.hypot(g.release_pos_x.std(), g.release_pos_z.std())
        assert r["release_consistency"] == pytest.approx(spread, abs=1e-9)


def test_name_ties_take_the_first_in_text_order(pitches):
    rows = [{"player_name": n} for n in ("b", "a", "a", "b", None, None, None)] + [{"pitcher": 2, "player_name": None}]
    assert [tuple(r) for r in R.display_names(pitches(rows)).collect()] == [(1, "a")]


def test_single_pitch_has_no_spread(pitches):
    feats = build_features(clean(pitches([{}]), Settings(min_pitches_per_season=1)))
    r = R.profile(feats, Settings(min_pitches_per_type=1)).first()
    assert r.release_consistency == 0.0 and r.z_release_speed == 0.0
    assert r.tunnel_dist_nearest is None and r.z_tunnel_dist_nearest == 0.0


def test_group_without_any_spin_axis_is_dropped(pitches):
    rows = [{"spin_axis": None}] * 3 + [{"pitch_type": "SL", "spin_axis": None}] * 2 + [{"pitch_type": "SL"}]
    s = Settings(min_pitches_per_season=1, min_pitches_per_type=1)
    assert [r.pitch_type for r in R.profile(build_features(clean(pitches(rows), s), s), s).collect()] == ["SL"]


def test_circular_spin_mean(pitches):
    rows = [{"spin_axis": 350.0}, {"spin_axis": 20.0}]
    s = Settings(min_pitches_per_season=1, min_pitches_per_type=1, circular_spin_mean=True)
    feats = build_features(clean(pitches(rows), s), s)
    assert R.profile(feats, s).first().spin_axis == pytest.approx(5.0)


def test_missing_label_or_season_is_refused(pitches):
    with pytest.raises(ValueError):
        R.summarize(pitches([{}]))
    with pytest.raises(ValueError):
        R.with_season(pitches([{}]).drop("game_date"))


def arsenal(spark, rows):
    return spark.createDataFrame(rows, (
        "pitcher long, season int, pitch_type string, pitch_group string, p_throws_enc int, "
        "tunnel_x double, tunnel_z double, plate_x_kin double, plate_z_kin double"))


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    types = ["FF", "SI", "FC", "SL", "CU", "KC", "CH"]
    rows = [(p, s, t, "g", h, *[None if rng.random() < 0.08 else float(np.round(v, 1)) for v in rng.normal(size=4)])
            for p in range(12) for s in (2021, 2022) for t in types for h in (0, 1) if rng.random() < 0.4]
    got = {tuple(r[:5]): (r.tunnel_dist_nearest, r.tunnel_ratio_nearest)
           for r in add_tunnel_features(arsenal(spark, rows)).collect()}
    assert len(got) == len(rows)
    for a in rows:
        dist = ratio = None
        others = sorted((b for b in rows if b[:2] == a[:2] and b[2:5] != a[2:5] and None not in b[5:7]), key=lambda b: b[2:5])
        if None not in a[5:7] and others:
            b = min(others, key=lambda b: (math.hypot(b[5] - a[5], b[6] - a[6])))
            dist = math.hypot(b[5] - a[5], b[6] - a[6])
            if dist > 1e-4 and None not in a[7:] and None not in b[7:]:
                ratio = min(math.hypot(b[7] - a[7], b[8] - a[8]) / dist, 60.0)
        assert got[a[:5]] == (pytest.approx(dist), pytest.approx(ratio)), a


def test_nearest_special_cases(spark):
    rows = [
        (1, 2021, "FF", "f", 1, 0.0, 0.0, 0.0, 0.0), (1, 2021, "SL", "b", 1, 0.0, 0.0, 1.0, 1.0),  # same point
        (2, 2021, "FF", "f", 1, 0.0, 0.0, 0.0, 0.0),  # alone
        (3, 2021, "FF", "f", 1, 0.0, 0.0, 0.0, 0.0), (3, 2021, "SL", "b", 1, 0.001, 0.0, 5.0, 0.0),  # capped
        (4, 2021, "FF", "f", 0, 0.0, 0.0, 0.0, 0.0), (4, 2021, "FF", "f", 1, 3.0, 4.0, 6.0, 8.0),  # both hands
    ]
    out = add_tunnel_features(arsenal(spark, rows))
    got = {(r.pitcher, r.pitch_type, r.p_throws_enc): (r.tunnel_dist_nearest, r.tunnel_ratio_nearest) for r in out.collect()}
    assert got[(1, "FF", 1)] == (0.0, None)
    assert got[(2, "FF", 1)] == (None, None)
    assert got[(3, "SL", 1)] == (pytest.approx(0.001), 60.0)
    assert got[(4, "FF", 0)] == (5.0, 2.0)
    s = tunnel_summary(out).first()
    assert (s.n_with, s.n_without) == (6, 1)
    assert s.dist_median == pytest.approx(0.001) and s.ratio_median == pytest.approx(31.0)


def test_no_positions_give_null_features(spark):
    out = add_tunnel_features(arsenal(spark, [(1, 2021, "FF", "f", 1, 0.0, 0.0, 0.0, 0.0)]).drop("tunnel_x"))
    assert out.first().tunnel_dist_nearest is None
