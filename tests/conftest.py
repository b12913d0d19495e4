import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pitchrank.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pitches(spark):
    """Builds pitch rows from the columns that matter, the others being ordinary."""
    from datetime import date

    from pitchrank.schema import PITCH_SCHEMA

    usual = dict(
        game_date=date(2021, 6, 1), game_pk=1, pitcher=1, player_name="A", pitch_type="FF",
        release_speed=93.0, pfx_x=0.5, pfx_z=1.2, release_spin_rate=2300.0, spin_axis=200.0,
        release_pos_x=-1.5, release_pos_y=54.0, release_pos_z=6.0, release_extension=6.2,
        vx0=3.0, vy0=-135.0, vz0=-4.0, ax=-5.0, ay=28.0, az=-16.0,
        estimated_woba_using_speedangle=None, description="ball", type="B", balls=0, strikes=0,
        p_throws="R")

    def build(rows, drop=()):
        names = [n for n in usual if n not in drop]
        schema = PITCH_SCHEMA.__class__([PITCH_SCHEMA[n] for n in names])
        full = [tuple({**usual, **r}[n] for n in names) for r in rows]
        return spark.createDataFrame(full, schema)

    return build
