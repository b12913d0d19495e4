from datetime import date

import pytest
from pyspark.sql import functions as F

from pitchrank.operators import clean as C
from pitchrank.params import Settings

ONE = Settings(min_pitches_per_season=1)


def column(df, name, order="game_pk"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def numbered(rows):
    return [{"game_pk": i, **r} for i, r in enumerate(rows)]


def test_codes(pitches):
    given = ["FT", "PO", "EP", "SC", "FA", "AB", "IN", None, "SL", "XX"]
    out = C.normalize_codes(pitches(numbered([{"pitch_type": c} for c in given])))
    assert column(out, "pitch_type") == ["SI", "FF", "CH", "CH", "FF", "SL", "XX"]


def test_unreadable_dates_become_null(pitches):
    df = pitches(numbered([{}, {}, {}])).withColumn(
        "game_date", F.element_at(F.array(F.lit("2021-04-05"), F.lit("soon"), F.lit("2021-07-01 12:00:00")),
                                  (F.col("game_pk") + 1).cast("int")))
    assert column(C.parse_dates(df), "game_date") == [date(2021, 4, 5), None, date(2021, 7, 1)]


def test_required_columns_that_are_absent_are_not_required(pitches):
    rows = numbered([{"pfx_x": None}, {"spin_axis": None}, {"description": None}, {}])
    assert column(C.drop_incomplete(pitches(rows)), "game_pk") == [1, 3]
    assert column(C.drop_incomplete(pitches(rows, drop=["pfx_x"])), "game_pk") == [0, 1, 3]


def test_floors(pitches):
    rows = numbered([
        {"release_speed": 79.9}, {"release_speed": 80.0}, {"pitch_type": "XX", "release_speed": 20.0},
        {"pitch_type": "FO", "release_speed": 59.0}, {"release_speed": None}])
    assert column(C.drop_slow(pitches(rows)), "game_pk") == [1, 2, 4]


def test_run_values(pitches):
    rows = numbered([
        {"description": "swinging_strike", "type": "S"},
        {"description": "hit_into_play", "type": "X", "estimated_woba_using_speedangle": 1.2},
        {"description": "hit_into_play", "type": "X"},
        {"description": "hit_into_play", "type": "S"},
        {"description": "odd", "type": "X", "estimated_woba_using_speedangle": 0.32},
        {"description": "odd", "type": "B"},
        {"description": "foul", "type": None},
    ])
    df = pitches(rows, drop=["balls"])
    got = column(C.add_run_value(df), "lw_run_value")
    assert got == pytest.approx([-0.13, 0.88 / 1.157, 0.0, None, 0.0, None, -0.038])
    # without the result column the description decides
    assert column(C.add_run_value(df.drop("type")), "lw_run_value")[3:5] == [0.0, None]
    assert column(C.add_run_value(df.drop("estimated_woba_using_speedangle")), "lw_run_value")[1] == 0.0


def test_count_weight(pitches):
    rows = numbered([
        {"balls": 3, "strikes": 2}, {"balls": None, "strikes": None}, {"balls": 7, "strikes": 9},
        {"balls": -1, "strikes": 1}, {"balls": 3, "strikes": 0}])
    got = column(C.add_run_value(pitches(rows)), "lw_run_value")
    assert got == pytest.approx([0.056 * w for w in (2.16, 0.87, 2.16, 0.78, 0.67)])


def test_clipping_keeps_nulls(pitches):
    rows = numbered([{"release_spin_rate": 9000.0}, {"release_spin_rate": None}, {"release_spin_rate": 1.0}])
    assert column(C.clip_columns(pitches(rows)), "release_spin_rate") == [3500.0, None, 500.0]


def test_hand(pitches):
    rows = numbered([{"p_throws": "R"}, {"p_throws": "L"}, {"p_throws": None}])
    assert column(C.encode_hand(pitches(rows)), "p_throws_enc") == [1, 0, 0]


def test_rare_pitchers_and_rows_without_key(pitches):
    rows = numbered([{"pitcher": 1}] * 3 + [{"pitcher": 2}] * 2 + [{"pitcher": None}] * 5
                    + [{"pitcher": 1, "game_date": None}] + [{"pitcher": 1, "game_date": date(2022, 5, 1)}] * 2)
    assert column(C.drop_rare_pitchers(pitches(rows), 3), "game_pk") == [0, 1, 2]


def test_pitches_dropped_later_still_count(pitches):
    # two of three have no label or group, but the pitcher-season has three pitches
    rows = numbered([{}, {"description": "odd"}, {"pitch_type": "XX"}])
    out = C.clean(pitches(rows), Settings(min_pitches_per_season=3))
    assert column(out, "game_pk") == [0]


def test_clean_again_changes_nothing(pitches):
    rows = numbered([{"pitch_type": "FT", "release_pos_x": -9.0}, {"balls": 2}, {"pitch_type": "SL"}])
    once = C.clean(pitches(rows), ONE)
    twice = C.clean(once, ONE)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(*once.columns).collect()))


def test_report_adds_up(pitches):
    rows = numbered([{}] * 4 + [{"pitch_type": "AB"}, {"pfx_z": None}, {"release_speed": 60.0},
                                {"pitcher": 9}, {"description": "odd"}, {"pitch_type": "XX"}])
    settings = Settings(min_pitches_per_season=2)
    r = C.clean_report(pitches(rows), settings).first()
    assert (r.rows_in, r.no_pitch, r.incomplete, r.below_floor, r.rare_pitcher, r.no_label, r.no_group,
            r.rows_out) == (10, 1, 1, 1, 1, 1, 1, 4)
    assert r.rows_out == C.clean(pitches(rows), settings).count()
    assert [tuple(x) for x in C.floor_drops(pitches(rows)).collect()] == [("FF", 1, 60.0)]
    assert [tuple(x) for x in C.unknown_groups(pitches(rows), settings).collect()] == [("XX", 1)]
    assert [tuple(x) for x in C.unknown_descriptions(pitches(rows), settings=settings).collect()] == [("odd", 1)]
