"""Fixed values of the scoring method and the settings a user may change."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType

# --- fixed values -----------------------------------------------------------
# Published constants of the method. They decide the results, so they are kept
# here in one place, in natural order.

# Legacy pitch codes and what they are read as; None drops the pitch.
CODE_ALIASES = {
    "FT": "SI",
    "PO": "FF",
    "EP": "CH",
    "SC": "CH",
    "AB": None,
    "IN": None,
    "FA": "FF",
}

# A pitch missing any of these cannot be used.
REQUIRED_COLUMNS = (
    "release_speed",
    "pfx_x",
    "pfx_z",
    "release_spin_rate",
    "release_pos_x",
    "release_pos_z",
    "release_extension",
    "pitch_type",
    "description",
)

# Runs per pitch outcome, seen from the batter.
EVENT_RUNS = {
    "ball": 0.056,
    "blocked_ball": 0.056,
    "pitchout": 0.056,
    "intent_ball": 0.056,
    "called_strike": -0.068,
    "swinging_strike": -0.130,
    "swinging_strike_blocked": -0.130,
    "missed_bunt": -0.130,
    "foul_tip": -0.130,
    "foul": -0.038,
    "foul_bunt": -0.038,
    "foul_pitchout": -0.038,
    "hit_by_pitch": 0.350,
}
IN_PLAY_EVENTS = ("hit_into_play", "hit_into_play_no_out", "hit_into_play_score")
WHIFF_EVENTS = ("swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt")

WOBA_MEAN = 0.320
WOBA_SCALE = 1.157

# Weight of a count, one row per number of balls, one column per strikes.
COUNT_WEIGHTS = (
    (0.87, 0.78, 0.75),
    (0.99, 0.99, 1.00),
    (1.01, 1.25, 1.35),
    (0.67, 1.44, 2.16),
)

# Slowest believable speed per type, mph.
SPEED_FLOORS = {
    "FF": 80.0,
    "SI": 78.0,
    "FC": 75.0,
    "SL": 65.0,
    "CU": 55.0,
    "KC": 55.0,
    "ST": 65.0,
    "SV": 58.0,
    "CH": 65.0,
    "FS": 63.0,
    "FO": 60.0,
}

CLIP_BOUNDS = {
    "release_speed": (50.0, 105.0),
    "pfx_x": (-30.0, 30.0),
    "pfx_z": (-30.0, 30.0),
    "release_spin_rate": (500.0, 3500.0),
    "release_pos_x": (-5.0, 5.0),
    "release_pos_z": (2.5, 8.5),
    "release_extension": (3.0, 8.0),
    "plate_x": (-3.0, 3.0),
    "plate_z": (-1.0, 6.5),
}

PITCH_GROUPS = {
    "fastball": ("FF", "SI", "FC"),
    "breaking": ("SL", "CU", "KC", "SV", "ST"),
    "offspeed": ("CH", "FS", "FO"),
}
FASTBALLS = ("FF", "SI", "FC")
MODEL_TYPES = ("FF", "SI", "SL", "CH", "CU", "FC", "ST", "FS", "KC", "SV")

# Distances from the back of the plate, feet.
TUNNEL_Y = 26.5
PLATE_Y = 1.417
TUNNEL_MIN_DISTANCE = 1e-4
TUNNEL_RATIO_CAP = 60.0

# Spin that turns fully into movement: 18 in at 2400 rpm and 95 mph.
SPIN_REFERENCE_RPM = 2400.0
SPIN_REFERENCE_MPH = 95.0
SPIN_REFERENCE_INCHES = 18.0
SPIN_MIN_MOVEMENT = 0.1
SPIN_EFFICIENCY_BOUNDS = (-0.05, 1.25)

# Model inputs, in the order the model sees them.
MODEL_INPUTS = (
    "release_speed",
    "pfx_x",
    "pfx_z",
    "induced_vertical_break",
    "horz_break",
    "release_spin_rate",
    "spin_axis",
    "release_pos_x",
    "release_pos_z",
    "release_extension",
    "vaa",
    "haa",
    "speed_diff",
    "p_throws_enc",
    "z_release_speed",
    "z_pfx_x",
    "z_pfx_z",
    "z_induced_vertical_break",
    "z_release_spin_rate",
    "z_vaa",
    "z_release_extension",
    "z_horz_break",
    "z_speed_diff",
    "spin_efficiency",
    "z_spin_efficiency",
    "release_consistency",
    "tunnel_dist_nearest",
    "z_tunnel_dist_nearest",
    "tunnel_ratio_nearest",
    "z_tunnel_ratio_nearest",
)

ZSCORE_COLUMNS = (
    "release_speed",
    "pfx_x",
    "pfx_z",
    "induced_vertical_break",
    "release_spin_rate",
    "vaa",
    "release_extension",
    "horz_break",
    "speed_diff",
    "spin_efficiency",
    "tunnel_dist_nearest",
    "tunnel_ratio_nearest",
)

# First and last day of each season.
SEASON_DATES = {
    2015: ("2015-04-05", "2015-11-01"),
    2016: ("2016-04-03", "2016-11-03"),
    2017: ("2017-04-02", "2017-11-02"),
    2018: ("2018-03-29", "2018-10-28"),
    2019: ("2019-03-28", "2019-10-30"),
    2020: ("2020-07-23", "2020-10-27"),
    2021: ("2021-04-01", "2021-11-02"),
    2022: ("2022-04-07", "2022-11-05"),
    2023: ("2023-03-30", "2023-11-04"),
    2024: ("2024-03-20", "2024-10-30"),
    2025: ("2025-03-27", "2025-10-31"),
    2026: ("2026-03-26", "2026-10-31"),
}
TRAIN_SEASONS = (2021, 2022, 2023, 2024, 2025)
CURRENT_SEASON = 2026
# --- end of fixed values ----------------------------------------------------

LABEL = "lw_run_value"
SCORE = "score"
PROFILE_KEYS = ("pitcher", "season", "pitch_type", "pitch_group", "p_throws_enc")
TUNNEL_POSITIONS = ("tunnel_x", "tunnel_z", "plate_x_kin", "plate_z_kin")
TUNNEL_FEATURES = ("tunnel_dist_nearest", "tunnel_ratio_nearest")
# Model inputs that may be null: an arsenal of one pitch has no neighbour.
NULLABLE_INPUTS = TUNNEL_FEATURES + tuple(f"z_{c}" for c in TUNNEL_FEATURES)


@dataclass(frozen=True)
class BoostParams:
    """Boosting parameters of one model size."""

    rounds: int
    depth: int
    learning_rate: float
    min_child_weight: float
    l1: float = 0.0
    l2: float = 1.0
    subsample: float = 0.8
    column_sample: float = 0.8
    patience: int = 30
    bins: int = 256
    seed: int = 42


# Boosting parameters of the method (fixed values).
STANDARD_BOOST = BoostParams(rounds=400, depth=4, learning_rate=0.03, min_child_weight=200, l1=0.1, l2=2.0)
SMALL_BOOST = BoostParams(rounds=200, depth=3, learning_rate=0.05, min_child_weight=50, l1=0.3, l2=4.0)


@dataclass(frozen=True)
class Settings:
    """Everything a caller may tune; the defaults are those of the method."""

    min_pitches_per_season: int = 100
    min_pitches_per_type: int = 50
    board_min_pitches: int = 50
    pitch_groups: dict = field(default_factory=lambda: MappingProxyType(PITCH_GROUPS))
    model_types: tuple = MODEL_TYPES
    train_seasons: tuple = TRAIN_SEASONS
    current_season: int = CURRENT_SEASON
    zscore_columns: tuple = ZSCORE_COLUMNS
    model_inputs: tuple = MODEL_INPUTS
    center: float = 100.0
    scale: float = 10.0
    pfx_scale: float = 1.0
    circular_spin_mean: bool = False
    min_rows_per_model: int = 20
    small_model_below: int = 150
    standard_boost: BoostParams = STANDARD_BOOST
    small_boost: BoostParams = SMALL_BOOST
    min_rank_pairs: int = 15
    low_rank_correlation: float = 0.35


DEFAULTS = Settings()
