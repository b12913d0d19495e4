import glob
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchrank.params import Settings
from pitchrank.plans import incremental as I
from pitchrank.plans.fused import profiles_from_raw
from pitchrank.sources import landing as L
from pitchrank.sources import tables as S

SMALL = Settings(min_pitches_per_season=12, min_pitches_per_type=4)
TODAY = date(2026, 1, 1)


def some(pitches, seed, months, n=250):
    """Pitches of six pitchers in the given (year, month) pairs; the fastest ones differ by month."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        year, month = months[i % len(months)]
        p = int(rng.integers(1, 7))
        rows.append(dict(
            game_pk=1000 * seed + i, pitcher=p, player_name=f"P{p}{'x' if rng.random() < .3 else ''}", game_date=date(year, month, 3),
            pitch_type=str(rng.choice(["FF", "SL", "CH"])), release_speed=float(np.round(rng.uniform(80 + month, 100), 1)),
            pfx_x=float(rng.normal()), pfx_z=float(rng.normal()), release_extension=float(rng.uniform(5, 7)), az=float(rng.normal(-16, 4)), release_pos_x=float(rng.normal(0, 1)),
            description=str(rng.choice(["ball", "swinging_strike", "called_strike"])), type="S"))
    return pitches(rows)


def rounded(df):
    columns = sorted(df.columns)
    return sorted((tuple(round(r[c], 7) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str)


def same(got, raw):
    want = profiles_from_raw(raw, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rounded(got), rounded(want)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-6, nan_ok=True) or str(g) == str(w)


def test_profiles_follow_the_store(spark, pitches, tmp_path):
    store, root = str(tmp_path / "raw"), str(tmp_path / "states")
    with pytest.raises(FileNotFoundError):
        I.refresh_profiles(spark, store, root, SMALL)
    first, second = some(pitches, 1, [(2024, 5), (2024, 6)]), some(pitches, 2, [(2025, 5), (2025, 6), (2024, 7)])
    L.replace_months(spark, first, store, TODAY)
    same(I.refresh_profiles(spark, store, root, SMALL), first)
    L.replace_months(spark, second, store, TODAY)
    assert {m[:2] for m in I.changed_months(spark, store, root)} == {(2024, 7), (2025, 5), (2025, 6)}
    # months that have not changed are not read: they could not be
    spoilt = {}
    for path in glob.glob(f"{store}/season=2024/month=[56]/*/*.parquet"):
        spoilt[path] = open(path, "rb").read()
        open(path, "wb").write(b"spoilt")
    both = S.union_tables(first, second)
    same(I.refresh_profiles(spark, store, root, SMALL), both)
    for path, content in spoilt.items():
        open(path, "wb").write(content)
    assert I.changed_months(spark, store, root) == []
    same(I.refresh_profiles(spark, store, root, SMALL), both)
    # a month comes again with other pitches, and moves its pitchers' whole season
    again = some(pitches, 3, [(2024, 6)], 120)
    L.replace_months(spark, again, store, TODAY)
    now = S.union_tables(both.where("NOT (year(game_date) = 2024 AND month(game_date) = 6)"), again)
    same(I.refresh_profiles(spark, store, root, SMALL), now)
    # a month whose pitches all fail the rules leaves nothing behind
    slow = some(pitches, 4, [(2024, 5)], 30).withColumn("release_speed", F.lit(1.0))
    L.replace_months(spark, slow, store, TODAY)
    now = now.where("NOT (year(game_date) = 2024 AND month(game_date) = 5)")
    same(I.refresh_profiles(spark, store, root, SMALL), now)


def test_a_call_that_broke_off_is_made_good(spark, pitches, tmp_path, monkeypatch):
    store, root = str(tmp_path / "raw"), str(tmp_path / "states")
    raw = some(pitches, 5, [(2024, 5), (2024, 6)])
    L.replace_months(spark, raw.where("month(game_date) = 5"), store, TODAY)
    I.refresh_profiles(spark, store, root, SMALL)
    L.replace_months(spark, raw.where("month(game_date) = 6"), store, TODAY)
    with monkeypatch.context() as m:
        m.setattr(I, "summaries_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            I.refresh_profiles(spark, store, root, SMALL)
    same(I.refresh_profiles(spark, store, root, SMALL), raw)


def test_speed_gap_from_counts(spark, pitches):
    """The gap is cut at zero pitch by pitch, so a mean of speeds would not do."""
    raw = some(pitches, 6, [(2024, 5)])
    rows = I.pitch_features(raw, SMALL)
    got = I.summaries_of(I.key_states(rows, SMALL), I.speed_states(rows), I.pitcher_states(raw, SMALL), SMALL)
    fast = {r.pitcher: r.m for r in rows.where("pitch_type = 'FF'").groupBy("pitcher").agg(F.avg("release_speed").alias("m")).collect()}
    speeds = {}
    for r in rows.collect():
        speeds.setdefault((r.pitcher, r.pitch_type), []).append(max(fast[r.pitcher] - r.release_speed, 0.0))
    for r in got.collect():
        assert r.speed_diff == pytest.approx(np.mean(speeds[(r.pitcher, r.pitch_type)]))
    assert min(max(v) for k, v in speeds.items() if k[1] == "FF") > 0


def test_changed_months_are_read_twice(spark, pitches, tmp_path, monkeypatch):
    """Once for the sums per key, once for all that is counted."""
    store, root = str(tmp_path / "raw"), str(tmp_path / "states")
    L.replace_months(spark, some(pitches, 1, [(2024, 5), (2024, 6)]), store, TODAY)
    read, write = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name: read.append(any(store in f for f in df.inputFiles())) or write(df, name))
    I.refresh_profiles(spark, store, root, SMALL)
    assert sum(read) == 2


def test_fingerprints_are_sums_of_hashes(spark, pitches):
    rows = L.by_month(some(pitches, 1, [(2024, 5), (2024, 6)]))
    values = [F.xxhash64(F.lit(n), F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType))
              for n, f in enumerate(L.PITCH_SCHEMA)]
    hashes = rows.select("month", F.xxhash64(*values).alias("h")).collect()
    want = {m: f"{sum(r.month == m for r in hashes)}:{sum(r.h for r in hashes if r.month == m)}" for m in (5, 6)}
    found = L.fingerprints(rows)
    assert {r.month: r.fingerprint for r in found.collect()} == want
    assert "decimal(38,0))" not in found._jdf.queryExecution().optimizedPlan().toString().split("sum(")[1]
