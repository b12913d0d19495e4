"""The registered queries as SQL on the same tables, written independently.

Every query starts from a chain of common table expressions; each step of it does
in SQL what one operator does on DataFrames. Doubles are rounded to six digits,
with a hair added so that exact halves fall the same way everywhere.
"""

from __future__ import annotations

MIN_SEASON = 100
MIN_TYPE = 20

_KEYS = "pitcher, season, pitch_type, pitch_group, p_throws_enc"
_Z = (
    "release_speed", "pfx_x", "pfx_z", "induced_vertical_break", "release_spin_rate", "vaa",
    "release_extension", "horz_break", "speed_diff", "spin_efficiency", "tunnel_dist_nearest",
    "tunnel_ratio_nearest",
)
_MEANS = (
    "release_speed", "pfx_x", "pfx_z", "induced_vertical_break", "horz_break", "release_spin_rate",
    "spin_axis", "release_pos_x", "release_pos_z", "release_extension", "vaa", "haa", "speed_diff",
    "spin_efficiency",
)
_PITCH_DOUBLES = (
    "release_speed", "pfx_x", "pfx_z", "release_spin_rate", "spin_axis", "release_pos_x",
    "release_pos_y", "release_pos_z", "release_extension", "vx0", "vy0", "vz0", "ax", "ay", "az",
    "estimated_woba_using_speedangle",
)
_PHYSICS = (
    "induced_vertical_break", "horz_break", "arm_side_break", "vaa", "haa", "speed_diff",
    "spin_efficiency", "tunnel_x", "tunnel_z", "plate_x_kin", "plate_z_kin",
)


def _r(*names, **exprs) -> str:
    """Rounded output columns."""
    items = {**{n: n for n in names}, **exprs}
    return ", ".join(f"round(({e}) + 3e-9, 6) + 0e0 AS {n}" for n, e in items.items())


_STEPS = {
    "pitch": """
  SELECT CAST(l_shipdate AS DATE) AS game_date, l_orderkey AS game_pk,
    CASE WHEN l_suppkey <= 5 THEN 100 + l_suppkey ELSE l_suppkey % 20 END AS pitcher,
    'P' || CAST(CASE WHEN l_suppkey <= 5 THEN 100 + l_suppkey ELSE l_suppkey % 20 END AS VARCHAR)
      || CASE WHEN h % 50 = 0 THEN 'x' ELSE '' END AS player_name,
    l_linenumber AS pitch_number,
    CASE l_partkey % 14 WHEN 0 THEN 'FF' WHEN 1 THEN 'SI' WHEN 2 THEN 'FC' WHEN 3 THEN 'SL'
      WHEN 4 THEN 'CU' WHEN 5 THEN 'KC' WHEN 6 THEN 'SV' WHEN 7 THEN 'ST' WHEN 8 THEN 'CH'
      WHEN 9 THEN 'FS' WHEN 10 THEN 'FO' WHEN 11 THEN 'FT' WHEN 12 THEN 'AB' END AS pitch_type,
    74e0 + l_quantity * 0.6e0 AS release_speed,
    (l_discount - 0.05e0) * 20e0 AS pfx_x, (l_tax - 0.02e0) * 20e0 AS pfx_z,
    CASE WHEN h % 23 <> 0 THEN CAST(1700 + (l_partkey * 13) % 1900 AS DOUBLE) END AS release_spin_rate,
    CASE WHEN h % 29 <> 0 THEN CAST((l_partkey * 7) % 360 AS DOUBLE) END AS spin_axis,
    ((l_orderkey % 61) - 30) / 5.5e0 AS release_pos_x, 53e0 + l_linenumber / 4e0 AS release_pos_y,
    5e0 + (l_partkey % 31) / 20e0 AS release_pos_z,
    5.5e0 + (l_orderkey % 17) / 10e0 AS release_extension,
    ((l_orderkey % 21) - 10) / 2e0 AS vx0, -(l_quantity * 0.9e0 + 105e0) AS vy0,
    -(l_partkey % 13) / 3e0 AS vz0, CAST((l_partkey % 25) - 12 AS DOUBLE) AS ax,
    CAST(22 + l_orderkey % 10 AS DOUBLE) AS ay, -32e0 + l_linenumber * 2e0 AS az,
    CASE WHEN h % 11 <> 0 THEN l_discount * 8e0 END AS estimated_woba_using_speedangle,
    CASE h % 17 WHEN 0 THEN 'ball' WHEN 1 THEN 'called_strike' WHEN 2 THEN 'swinging_strike'
      WHEN 3 THEN 'foul' WHEN 4 THEN 'hit_into_play' WHEN 5 THEN 'blocked_ball' WHEN 6 THEN 'foul_tip'
      WHEN 7 THEN 'swinging_strike_blocked' WHEN 8 THEN 'hit_by_pitch' WHEN 9 THEN 'missed_bunt'
      WHEN 10 THEN 'foul_bunt' WHEN 11 THEN 'hit_into_play_no_out' WHEN 12 THEN 'pitchout'
      WHEN 13 THEN 'intent_ball' WHEN 14 THEN 'hit_into_play_score' WHEN 15 THEN 'foul_pitchout'
      ELSE 'unknown_event' END AS description,
    CASE WHEN h % 17 IN (4, 11, 14) THEN 'X' WHEN h % 17 IN (0, 5, 8, 12, 13) THEN 'B' ELSE 'S' END AS type,
    CASE WHEN h % 19 <> 0 THEN CAST(h % 5 AS INTEGER) END AS balls, CAST(h % 4 AS INTEGER) AS strikes,
    CASE WHEN (CASE WHEN l_suppkey <= 5 THEN 100 + l_suppkey ELSE l_suppkey % 20 END) % 3 = 0
      THEN 'L' ELSE 'R' END AS p_throws
  FROM (SELECT *, l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7 AS h FROM lineitem)""",
    "coded": """
  SELECT * REPLACE (CASE WHEN pitch_type = 'FT' THEN 'SI' WHEN pitch_type IN ('PO', 'FA') THEN 'FF'
      WHEN pitch_type IN ('EP', 'SC') THEN 'CH' ELSE pitch_type END AS pitch_type)
  FROM pitch WHERE pitch_type IS NOT NULL AND pitch_type NOT IN ('AB', 'IN')""",
    "complete": """
  SELECT * FROM coded WHERE release_speed IS NOT NULL AND pfx_x IS NOT NULL AND pfx_z IS NOT NULL
    AND release_spin_rate IS NOT NULL AND release_pos_x IS NOT NULL AND release_pos_z IS NOT NULL
    AND release_extension IS NOT NULL AND description IS NOT NULL""",
    "floors": """
  SELECT * FROM (VALUES ('FF', 80e0), ('SI', 78e0), ('FC', 75e0), ('SL', 65e0), ('CU', 55e0),
    ('KC', 55e0), ('ST', 65e0), ('SV', 58e0), ('CH', 65e0), ('FS', 63e0), ('FO', 60e0)) t(code, slowest)""",
    "screened": """
  SELECT c.* FROM complete c LEFT JOIN floors f ON c.pitch_type = f.code
  WHERE f.slowest IS NULL OR c.release_speed >= f.slowest""",
    "regular": f"""
  SELECT * FROM screened WHERE (pitcher, year(game_date)) IN (
    SELECT (pitcher, year(game_date)) FROM screened
    GROUP BY pitcher, year(game_date) HAVING count(*) >= {MIN_SEASON})""",
    "valued": """
  SELECT *, CASE WHEN type = 'X' THEN coalesce((estimated_woba_using_speedangle - 0.32e0) / 1.157e0, 0e0)
      WHEN description IN ('ball', 'blocked_ball', 'pitchout', 'intent_ball') THEN 0.056e0
      WHEN description = 'called_strike' THEN -0.068e0
      WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'missed_bunt', 'foul_tip') THEN -0.13e0
      WHEN description IN ('foul', 'foul_bunt', 'foul_pitchout') THEN -0.038e0
      WHEN description = 'hit_by_pitch' THEN 0.35e0 END AS runs,
    CASE 10 * least(greatest(coalesce(balls, 0), 0), 3) + least(greatest(coalesce(strikes, 0), 0), 2)
      WHEN 0 THEN 0.87e0 WHEN 1 THEN 0.78e0 WHEN 2 THEN 0.75e0
      WHEN 10 THEN 0.99e0 WHEN 11 THEN 0.99e0 WHEN 12 THEN 1e0
      WHEN 20 THEN 1.01e0 WHEN 21 THEN 1.25e0 WHEN 22 THEN 1.35e0
      WHEN 30 THEN 0.67e0 WHEN 31 THEN 1.44e0 WHEN 32 THEN 2.16e0 END AS weight,
    CASE WHEN pitch_type IN ('FF', 'SI', 'FC') THEN 'fastball'
      WHEN pitch_type IN ('SL', 'CU', 'KC', 'SV', 'ST') THEN 'breaking'
      WHEN pitch_type IN ('CH', 'FS', 'FO') THEN 'offspeed' END AS pitch_group
  FROM {source}""",
    "labelled": "\n  SELECT * EXCLUDE (runs, weight), runs * weight AS lw_run_value FROM valued",
    "cleaned": """
  SELECT * REPLACE (
      CASE WHEN release_speed IS NOT NULL THEN least(greatest(release_speed, 50e0), 105e0) END AS release_speed,
      CASE WHEN pfx_x IS NOT NULL THEN least(greatest(pfx_x, -30e0), 30e0) END AS pfx_x,
      CASE WHEN pfx_z IS NOT NULL THEN least(greatest(pfx_z, -30e0), 30e0) END AS pfx_z,
      CASE WHEN release_spin_rate IS NOT NULL THEN least(greatest(release_spin_rate, 500e0), 3500e0) END AS release_spin_rate,
      CASE WHEN release_pos_x IS NOT NULL THEN least(greatest(release_pos_x, -5e0), 5e0) END AS release_pos_x,
      CASE WHEN release_pos_z IS NOT NULL THEN least(greatest(release_pos_z, 2.5e0), 8.5e0) END AS release_pos_z,
      CASE WHEN release_extension IS NOT NULL THEN least(greatest(release_extension, 3e0), 8e0) END AS release_extension),
    CASE WHEN p_throws = 'R' THEN 1 ELSE 0 END AS p_throws_enc
  FROM labelled WHERE lw_run_value IS NOT NULL AND pitch_group IS NOT NULL""",
    "fastballs": """
  SELECT pitcher, year(game_date) AS fb_year, avg(release_speed) AS fb FROM cleaned
  WHERE pitch_type IN ('FF', 'SI', 'FC') GROUP BY pitcher, year(game_date)""",
    "timed": """
  SELECT c.*, greatest(coalesce(fb - release_speed, 0e0), 0e0) AS speed_diff,
    sqrt(greatest(vy0 * vy0 + 2 * ay * (1.417e0 - release_pos_y), 0e0)) AS root_plate,
    sqrt(greatest(vy0 * vy0 - 4 * (ay / 2) * (release_pos_y - 26.5e0), 0e0)) AS root_tunnel
  FROM cleaned c LEFT JOIN fastballs f ON c.pitcher = f.pitcher AND year(c.game_date) = f.fb_year""",
    "flown": """
  SELECT *, (-vy0 - root_plate) / ay AS t_plate, greatest((-vy0 - root_tunnel) / ay, 0e0) AS t_tunnel,
    greatest((-vy0 - root_plate) / ay, 0e0) AS t_front FROM timed""",
    "features": """
  SELECT * EXCLUDE (root_plate, root_tunnel, t_plate, t_tunnel, t_front),
    CAST(year(game_date) AS INTEGER) AS season,
    pfx_z AS induced_vertical_break, pfx_x AS horz_break,
    CASE WHEN p_throws = 'R' THEN -pfx_x ELSE pfx_x END AS arm_side_break,
    degrees(atan((vz0 + az * t_plate) / abs(vy0 + ay * t_plate))) AS vaa,
    degrees(atan((vx0 + ax * t_plate) / abs(vy0 + ay * t_plate))) AS haa,
    CASE WHEN spin_axis IS NOT NULL THEN least(greatest(
      (pfx_x * sin(radians(spin_axis)) - pfx_z * cos(radians(spin_axis)))
      / greatest(release_spin_rate / 2400e0 * (release_speed / 95e0) * 18e0, 0.1e0), -0.05e0), 1.25e0)
      END AS spin_efficiency,
    release_pos_x + vx0 * t_tunnel + 0.5e0 * ax * t_tunnel * t_tunnel AS tunnel_x,
    release_pos_z + vz0 * t_tunnel + 0.5e0 * az * t_tunnel * t_tunnel AS tunnel_z,
    release_pos_x + vx0 * t_front + 0.5e0 * ax * t_front * t_front AS plate_x_kin,
    release_pos_z + vz0 * t_front + 0.5e0 * az * t_front * t_front AS plate_z_kin
  FROM flown""",
    "summaries": f"""
  SELECT {_KEYS}, count(lw_run_value) AS n_pitches, avg(lw_run_value) AS lw_run_value,
    {', '.join(f'avg({c}) AS {c}' for c in _MEANS)},
    avg(tunnel_x) AS tunnel_x, avg(tunnel_z) AS tunnel_z,
    avg(plate_x_kin) AS plate_x_kin, avg(plate_z_kin) AS plate_z_kin,
    avg(CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'missed_bunt')
      THEN 1e0 ELSE 0e0 END) AS whiff_rate,
    avg(CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'missed_bunt',
      'called_strike') THEN 1e0 ELSE 0e0 END) AS csw_rate,
    sqrt(coalesce(var_samp(release_pos_x), 0) + coalesce(var_samp(release_pos_z), 0)) AS release_consistency
  FROM features GROUP BY {_KEYS}""",
    "names": """
  SELECT pitcher, player_name FROM (
    SELECT pitcher, player_name, row_number() OVER (PARTITION BY pitcher ORDER BY count(*) DESC, player_name) AS place
    FROM features GROUP BY pitcher, player_name) WHERE place = 1""",
    "kept": f"""
  SELECT s.*, n.player_name FROM summaries s LEFT JOIN names n ON s.pitcher = n.pitcher
  WHERE n_pitches >= {MIN_TYPE} AND s.lw_run_value IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _MEANS)}""",
    "pairs": f"""
  SELECT a.pitcher, a.season, a.pitch_type, a.pitch_group, a.p_throws_enc,
    sqrt((a.tunnel_x - b.tunnel_x) ** 2 + (a.tunnel_z - b.tunnel_z) ** 2) AS apart,
    sqrt((a.plate_x_kin - b.plate_x_kin) ** 2 + (a.plate_z_kin - b.plate_z_kin) ** 2) AS parted,
    row_number() OVER (PARTITION BY a.pitcher, a.season, a.pitch_type, a.pitch_group, a.p_throws_enc
      ORDER BY sqrt((a.tunnel_x - b.tunnel_x) ** 2 + (a.tunnel_z - b.tunnel_z) ** 2),
        b.pitch_type, b.pitch_group, b.p_throws_enc) AS place
  FROM kept a JOIN kept b ON a.pitcher = b.pitcher AND a.season = b.season
    AND (a.pitch_type, a.pitch_group, a.p_throws_enc) <> (b.pitch_type, b.pitch_group, b.p_throws_enc)""",
    "tunnelled": f"""
  SELECT k.* EXCLUDE (tunnel_x, tunnel_z, plate_x_kin, plate_z_kin), apart AS tunnel_dist_nearest,
    CASE WHEN apart > 1e-4 THEN least(parted / apart, 60e0) END AS tunnel_ratio_nearest
  FROM kept k LEFT JOIN (SELECT * FROM pairs WHERE place = 1) p USING ({_KEYS})""",
    "profiles": f"""
  SELECT *, {', '.join(
        f"CASE WHEN coalesce(stddev_samp({c}) OVER g, 0) > 0 AND max({c}) OVER g > min({c}) OVER g "
        f"THEN ({c} - avg({c}) OVER g) / stddev_samp({c}) OVER g ELSE 0e0 END AS z_{c}" for c in _Z)}
  FROM tunnelled WINDOW g AS (PARTITION BY pitch_type, season)""",
    "scaler": """
  SELECT pitch_type, avg(lw_run_value) AS mean_raw, stddev_pop(lw_run_value) AS std_raw FROM profiles
  WHERE season < (SELECT max(season) FROM profiles) GROUP BY pitch_type""",
    "scored": """
  SELECT p.*, mean_raw, std_raw, 100e0 - 10e0 * (p.lw_run_value - mean_raw) / nullif(std_raw, 0) AS score
  FROM profiles p LEFT JOIN scaler s ON p.pitch_type = s.pitch_type""",
    "board": """
  SELECT player_name, pitcher, season, pitch_type, pitch_group, n_pitches,
    round_even(score * 10, 0) / 10 AS score
  FROM scored WHERE score IS NOT NULL AND n_pitches >= 20""",
    "recent_board": "\n  SELECT * FROM board WHERE season = (SELECT max(season) FROM scored)",
    "stored": """
  SELECT * REPLACE (CAST(game_date + INTERVAL 20 YEAR AS DATE) AS game_date) FROM pitch""",
}
_ORDER = list(_STEPS)


def _sql(last: str, select: str, **replace) -> str:
    """A query on the chain up to step ``last``; ``replace`` lets a step read another one."""
    steps = []
    for name in _ORDER[: _ORDER.index(last) + 1]:
        text = _STEPS[name].replace("{source}", replace.get(name, "regular"))
        steps.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(steps) + "\n" + select


_ID = "game_pk, pitch_number"
_BOUNDS = {"release_speed": (50, 105), "pfx_x": (-30, 30), "pfx_z": (-30, 30), "release_spin_rate": (500, 3500),
           "release_pos_x": (-5, 5), "release_pos_z": (2.5, 8.5), "release_extension": (3, 8)}
_CLIPPED = ",\n  ".join(
    "(SELECT count(*) FROM labelled WHERE lw_run_value IS NOT NULL AND pitch_group IS NOT NULL "
    f"AND ({c} < {low} OR {c} > {high})) AS clipped_{c}" for c, (low, high) in _BOUNDS.items())
_PITCH = f"{_ID}, game_date, pitcher, player_name, pitch_type, description, type, balls, strikes, p_throws, {_r(*_PITCH_DOUBLES)}"
_BOARD = f"player_name, pitcher, season, pitch_type, pitch_group, n_pitches, {_r('score')}"
_PROFILE_OUT = (
    f"{_KEYS}, player_name, n_pitches, "
    + _r("lw_run_value", *_MEANS, "whiff_rate", "csw_rate", "release_consistency",
         "tunnel_dist_nearest", "tunnel_ratio_nearest", *[f"z_{c}" for c in _Z])
)

_GATES = """, newest AS (SELECT max(season) AS v FROM profiles),
gates AS (SELECT pitch_type, count(*) AS rows_complete FROM profiles, newest WHERE pitch_type <> 'FO' GROUP BY pitch_type
  HAVING count(*) >= 20 AND count_if(season < v) > 0 AND count_if(season = v) > 0)"""
_MODEL_INPUTS = (
    "release_speed", "pfx_x", "pfx_z", "induced_vertical_break", "horz_break", "release_spin_rate", "spin_axis",
    "release_pos_x", "release_pos_z", "release_extension", "vaa", "haa", "speed_diff", "p_throws_enc", "z_release_speed",
    "z_pfx_x", "z_pfx_z", "z_induced_vertical_break", "z_release_spin_rate", "z_vaa", "z_release_extension", "z_horz_break",
    "z_speed_diff", "spin_efficiency", "z_spin_efficiency", "release_consistency", "tunnel_dist_nearest",
    "z_tunnel_dist_nearest", "tunnel_ratio_nearest", "z_tunnel_ratio_nearest",
)


def _shrunk(g: str) -> str:
    return f"(sign({g}) * greatest(abs({g}) - 0.3e0, 0))"


def _score(g: str, w: str) -> str:
    return f"power({_shrunk(g)}, 2) / ({w} + 4)"


def _leaf(g: str, w: str) -> str:
    return f"(-0.05e0 * {_shrunk(g)} / ({w} + 4))"


_INPUTS = 30  # model inputs; trees take missing values as they are

SQL = {
    # sources and sinks
    "scan_seasons": _sql("pitch", f"""
SELECT {_ID}, pitcher, CAST(year(game_date) AS INTEGER) AS season, pitch_type, {_r('release_speed')}
FROM pitch WHERE year(game_date) IN (1996, 1998)"""),
    "scan_seasons_uneven": _sql("pitch", f"""
SELECT {_ID}, CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month,
  CASE WHEN year(game_date) = 1998 THEN description END AS description,
  {_r(spin_axis='CASE WHEN year(game_date) = 1998 THEN spin_axis END', release_speed='release_speed')}
FROM pitch WHERE year(game_date) IN (1996, 1998)"""),
    "keep_columns": _sql("pitch", f"SELECT {_PITCH} FROM pitch"),
    "roundtrip_parquet": _sql("pitch", f"SELECT {_PITCH} FROM pitch"),
    "union_seasons": _sql("pitch", f"""
SELECT {_ID}, pitch_type, description, {_r('release_speed')} FROM pitch WHERE year(game_date) <= 1997
UNION ALL SELECT {_ID}, pitch_type, NULL, {_r('release_speed')} FROM pitch WHERE year(game_date) > 1997"""),
    "csv_to_parquet": _sql("pitch", f"""
SELECT {_ID}, game_date, pitcher, pitch_type, {_r('release_speed', 'spin_axis')} FROM pitch"""),
    "season_calendar": _sql("stored", f"""
, calendar AS (SELECT * FROM (VALUES (2015, DATE '2015-04-05', DATE '2015-11-01'),
  (2016, DATE '2016-04-03', DATE '2016-11-03'), (2017, DATE '2017-04-02', DATE '2017-11-02'),
  (2018, DATE '2018-03-29', DATE '2018-10-28'), (2019, DATE '2019-03-28', DATE '2019-10-30'),
  (2020, DATE '2020-07-23', DATE '2020-10-27'), (2021, DATE '2021-04-01', DATE '2021-11-02'))
  t(season, first_day, last_day))
SELECT {_ID}, game_date, c.season FROM stored JOIN calendar c ON game_date BETWEEN first_day AND last_day"""),
    "month_ranges": _sql("pitch", """
, spans AS (SELECT pitcher, min(game_date) AS first_day, max(game_date) AS last_day FROM pitch GROUP BY pitcher),
months AS (SELECT pitcher, last_day,
  unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day), INTERVAL 1 MONTH)) AS m FROM spans)
SELECT pitcher, CAST(m AS DATE) AS month_start, least(last_day(CAST(m AS DATE)), last_day) AS month_end FROM months"""),
    "ingest_season": _sql("stored", f"""
SELECT {_ID}, game_date, pitcher, CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month,
  {_r('release_speed')} FROM stored WHERE game_date BETWEEN DATE '2018-03-29' AND DATE '2018-10-28'"""),
    "ingest_season_text": _sql("stored", f"""
SELECT {_ID}, game_date, pitcher, CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month,
  {_r('release_speed')} FROM stored
WHERE game_pk % 3 <> 0 AND game_date BETWEEN DATE '2018-03-29' AND DATE '2018-10-28'"""),
    "refresh_months": _sql("stored", f"""
SELECT {_ID}, game_date, pitcher, CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month,
  {_r('release_speed')} FROM stored WHERE game_date BETWEEN DATE '2019-03-01' AND DATE '2019-08-15'"""),
    "stream_ingest": _sql("pitch", f"""
SELECT {_ID}, game_date, pitcher, CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month,
  {_r('release_speed')} FROM pitch"""),
    "stream_close": _sql("pitch", """
, months AS (
  SELECT CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month, count(*) AS rows,
    max(game_date) < DATE '1998-06-01' AS first
  FROM pitch GROUP BY ALL)
SELECT season, month, CAST(CASE WHEN first THEN 1 ELSE 2 END AS BIGINT) AS latest,
  CAST(CASE WHEN first THEN 0 ELSE 1 END AS INTEGER) AS open_deliveries,
  CASE WHEN first THEN rows ELSE 0 END AS late_rows, rows, first AS is_complete FROM months"""),
    "replace_visible": _sql("pitch", f"""
, seasons AS (
  SELECT CAST(year(game_date) AS INTEGER) AS season, count(*) AS rows, sum(release_speed) AS speed
  FROM pitch WHERE game_date IS NOT NULL GROUP BY ALL)
SELECT moment, season, rows, {_r(speed="speed * CASE WHEN season = 1997 AND moment = 'committed' THEN 2 ELSE 1 END")}
FROM seasons, (VALUES ('written'), ('failed'), ('committed')) m(moment)"""),
    "pitcher_scan": _sql("pitch", f"""
SELECT {_ID}, pitcher, pitch_type, {_r('release_speed')}, true AS less_than_half FROM pitch WHERE pitcher = 103"""),
    "unchanged_months": _sql("pitch", """
SELECT CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month, count(*) AS rows,
  NOT bool_or(year(game_date) = 1997 AND release_speed > 103) AS same_rows,
  NOT bool_or(year(game_date) = 1997 AND release_speed > 103) AS same_files
FROM pitch WHERE game_date IS NOT NULL GROUP BY ALL"""),
    "manifest": _sql("pitch", """
SELECT CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month, count(*) AS rows,
  year(game_date) < 2001 AS is_complete FROM pitch GROUP BY ALL"""),
    "cache_summary": _sql("pitch", """
SELECT 'season=' || year(game_date) || '/month=' || month(game_date) AS file,
  CAST(year(game_date) AS INTEGER) AS season, CAST(month(game_date) AS INTEGER) AS month, count(*) AS rows,
  year(game_date) < 2001 AS complete, true AS size_agrees FROM pitch GROUP BY ALL"""),
    "leaderboard_csv": _sql("recent_board", f"SELECT {_BOARD} FROM recent_board"),
    # projections
    "normalize_codes": _sql("coded", f"SELECT {_ID}, pitch_type FROM coded"),
    "season_of": _sql("pitch", f"""
SELECT {_ID}, CASE WHEN pitch_number <> 3 THEN CAST(year(game_date) AS INTEGER) END AS season FROM pitch"""),
    "run_value": _sql("valued", f"SELECT {_ID}, {_r(runs='runs')} FROM valued WHERE runs IS NOT NULL", valued="pitch"),
    "count_leverage": _sql("valued", f"""
SELECT {_ID}, {_r('weight', lw_run_value='runs * weight')} FROM valued""", valued="pitch"),
    "clip_bounds": _sql("pitch", f"""
SELECT {_ID}, {_r(
    release_speed='CASE WHEN release_speed IS NOT NULL THEN least(greatest(release_speed, 50e0), 105e0) END',
    pfx_x='CASE WHEN pfx_x IS NOT NULL THEN least(greatest(pfx_x, -30e0), 30e0) END',
    pfx_z='CASE WHEN pfx_z IS NOT NULL THEN least(greatest(pfx_z, -30e0), 30e0) END',
    release_extension='CASE WHEN release_extension IS NOT NULL THEN least(greatest(release_extension, 3e0), 8e0) END',
    release_spin_rate='CASE WHEN release_spin_rate IS NOT NULL THEN least(greatest(release_spin_rate, 500e0), 3500e0) END',
    release_pos_x='CASE WHEN release_pos_x IS NOT NULL THEN least(greatest(release_pos_x, -5e0), 5e0) END',
    release_pos_z='CASE WHEN release_pos_z IS NOT NULL THEN least(greatest(release_pos_z, 2.5e0), 8.5e0) END')} FROM pitch"""),
    "encode_hand": _sql("pitch", f"SELECT {_ID}, p_throws, CASE WHEN p_throws = 'R' THEN 1 ELSE 0 END AS p_throws_enc FROM pitch"),
    "pitch_group": _sql("valued", f"SELECT {_ID}, pitch_type, pitch_group FROM valued WHERE pitch_group IS NOT NULL", valued="pitch"),
    "physics_features": _sql("features", f"SELECT {_ID}, pitcher, pitch_type, p_throws_enc, {_r(*_PHYSICS)} FROM features"),
    "spin_efficiency": _sql("features", f"SELECT {_ID}, {_r('spin_efficiency')} FROM features"),
    "tunnel_positions": _sql("features", f"SELECT {_ID}, {_r('tunnel_x', 'tunnel_z', 'plate_x_kin', 'plate_z_kin')} FROM features"),
    "speed_diff": _sql("features", f"SELECT {_ID}, pitcher, pitch_type, {_r('speed_diff')} FROM features"),
    # filters
    "required_columns": _sql("complete", f"SELECT {_ID}, pitch_type, {_r('release_spin_rate')} FROM complete"),
    "velocity_floors": _sql("screened", f"SELECT {_ID}, pitch_type, {_r('release_speed')} FROM screened"),
    "min_group_count": _sql("regular", f"SELECT {_ID}, pitcher, CAST(year(game_date) AS INTEGER) AS season FROM regular"),
    "min_group_count_events": """
SELECT event_id, user_id FROM events WHERE (user_id, year(ts)) IN
  (SELECT (user_id, year(ts)) FROM events GROUP BY user_id, year(ts) HAVING count(*) >= 60)""",
    "clean": _sql("cleaned", f"""
SELECT {_PITCH}, pitch_group, p_throws_enc, {_r('lw_run_value')} FROM cleaned"""),
    # aggregates
    "clean_report": _sql("cleaned", f"""
SELECT (SELECT count(*) FROM pitch) AS rows_in,
  (SELECT count(*) FROM pitch) - (SELECT count(*) FROM coded) AS no_pitch,
  (SELECT count(*) FROM coded) - (SELECT count(*) FROM complete) AS incomplete,
  (SELECT count(*) FROM complete) - (SELECT count(*) FROM screened) AS below_floor,
  (SELECT count(*) FROM screened) - (SELECT count(*) FROM regular) AS rare_pitcher,
  (SELECT count(*) FROM labelled WHERE lw_run_value IS NULL) AS no_label,
  (SELECT count(*) FROM labelled WHERE lw_run_value IS NOT NULL AND pitch_group IS NULL) AS no_group,
  count(*) AS rows_out, {_r(label_mean='avg(lw_run_value)', label_sd='stddev_samp(lw_run_value)')},
  {_CLIPPED}
FROM cleaned"""),
    "floor_drops": _sql("floors", f"""
SELECT pitch_type, count(*) AS n_dropped, {_r(max_speed='max(release_speed)')}
FROM complete JOIN floors ON pitch_type = code WHERE release_speed < slowest GROUP BY pitch_type"""),
    "unknown_groups": _sql("labelled", """
SELECT pitch_type, count(*) AS n FROM labelled WHERE lw_run_value IS NOT NULL
AND pitch_type IN ('CH', 'FS', 'FO') GROUP BY pitch_type"""),
    "unknown_descriptions": _sql("valued", """
SELECT description, count(*) AS n FROM valued WHERE runs IS NULL
GROUP BY description ORDER BY n DESC, description LIMIT 10"""),
    "outcome_rates": _sql("summaries", f"SELECT {_KEYS}, {_r('whiff_rate', 'csw_rate')} FROM summaries"),
    "release_consistency": _sql("summaries", f"SELECT {_KEYS}, n_pitches, {_r('release_consistency')} FROM summaries"),
    "display_name": _sql("names", "SELECT pitcher, player_name FROM names"),
    "profile": _sql("profiles", f"SELECT {_PROFILE_OUT} FROM profiles"),
    "profile_two_scans": _sql("profiles", f"SELECT {_PROFILE_OUT} FROM profiles"),
    "profile_co_located": _sql("profiles", f"SELECT {_PROFILE_OUT} FROM profiles"),
    "profile_incremental": _sql("profiles", f"SELECT {_PROFILE_OUT} FROM profiles"),
    "type_summary": _sql("profiles", """
SELECT pitch_type, count(*) AS profiles, CAST(sum(n_pitches) AS BIGINT) AS total_pitches FROM profiles GROUP BY pitch_type"""),
    "profile_summary": _sql("profiles", f"""
SELECT count(*) AS profiles, {_r(label_mean='avg(lw_run_value)', label_sd='stddev_samp(lw_run_value)', mean_pitches='avg(n_pitches)')}
FROM profiles"""),
    # neighbours and standard scores
    "nearest_in_group": _sql("tunnelled", f"SELECT {_KEYS}, {_r('tunnel_dist_nearest', 'tunnel_ratio_nearest')} FROM tunnelled"),
    "tunnel_summary": _sql("tunnelled", f"""
SELECT count(tunnel_dist_nearest) AS n_with, count(*) - count(tunnel_dist_nearest) AS n_without,
  {_r(dist_mean='avg(tunnel_dist_nearest)', ratio_mean='avg(tunnel_ratio_nearest)',
      dist_median='median(tunnel_dist_nearest)', ratio_median='median(tunnel_ratio_nearest)')} FROM tunnelled"""),
    "zscore_in_group": _sql("profiles", f"SELECT {_KEYS}, {_r(*[f'z_{c}' for c in _Z])} FROM profiles"),
    "zscore_events": f"""
SELECT event_id, event_type, {_r(z_value='''CASE WHEN stddev_samp(value) OVER (PARTITION BY event_type) > 0
  THEN (value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type)
  ELSE 0e0 END''')} FROM events""",
    # scores and boards
    "scaler": _sql("scaler", f"SELECT pitch_type, {_r('mean_raw', 'std_raw')}, 100e0 AS center, 10e0 AS scale FROM scaler"),
    "plus_scale": _sql("scored", f"SELECT {_KEYS}, {_r('score')} FROM scored"),
    "leaderboard_all": _sql("board", f"SELECT {_BOARD} FROM board"),
    "leaderboard_type": _sql("board", f"SELECT {_BOARD} FROM board WHERE pitch_type = 'SL'"),
    "leaderboard_group": _sql("board", f"SELECT {_BOARD} FROM board WHERE pitch_group = 'breaking'"),
    "leaderboard_recent": _sql("recent_board", f"SELECT {_BOARD} FROM recent_board"),
    "leaderboard_top20": _sql("recent_board", f"SELECT {_BOARD} FROM recent_board ORDER BY recent_board.score DESC, pitcher, pitch_type LIMIT 20"),
    "leaderboard_all_types": _sql("recent_board", f"""
SELECT {_BOARD}, CAST(row_number() OVER (PARTITION BY pitch_type ORDER BY recent_board.score DESC, pitcher, pitch_type) AS INTEGER)
  AS place
FROM recent_board"""),
    "leaderboard_all_groups": _sql("recent_board", f"""
SELECT {_BOARD}, CAST(row_number() OVER (PARTITION BY pitch_group ORDER BY recent_board.score DESC, pitcher, pitch_type) AS INTEGER)
  AS place
FROM recent_board"""),
    "top20_events": f"SELECT event_id, {_r('value')} FROM events ORDER BY events.value DESC, event_id LIMIT 20",
    "career": _sql("scored", f"""
SELECT pitcher, player_name, pitch_type,
  {_r(score_career='round_even(sum(score * n_pitches) / nullif(sum(CASE WHEN score IS NOT NULL THEN n_pitches END), 0) * 10, 0) / 10')},
  CAST(sum(n_pitches) AS BIGINT) AS total_pitches
FROM scored GROUP BY pitcher, player_name, pitch_type HAVING count(score) > 0"""),
    "score_histogram": _sql("scored", f"""
, spans AS (SELECT pitch_type, min(score) AS low, max(score) AS high FROM scored WHERE score IS NOT NULL GROUP BY pitch_type),
counts AS (SELECT s.pitch_type, least(CAST(floor((score - low) / (high - low) * 40) AS INTEGER) + 1, 40) AS bin, count(*) AS n
  FROM scored s JOIN spans USING (pitch_type) WHERE score IS NOT NULL GROUP BY ALL)
SELECT p.pitch_type, g.bin, {_r(bin_low='low + (high - low) / 40 * (g.bin - 1)', bin_high='low + (high - low) / 40 * g.bin')},
  coalesce(n, 0) AS n
FROM spans p CROSS JOIN (SELECT CAST(unnest(range(1, 41)) AS INTEGER) AS bin) g
LEFT JOIN counts c ON c.pitch_type = p.pitch_type AND c.bin = g.bin"""),
    "spearman_by_type": _sql("scored", f"""
, ranked AS (SELECT pitch_type,
    rank() OVER (PARTITION BY pitch_type ORDER BY score) + (count(*) OVER (PARTITION BY pitch_type, score) - 1) / 2e0 AS rs,
    rank() OVER (PARTITION BY pitch_type ORDER BY whiff_rate) + (count(*) OVER (PARTITION BY pitch_type, whiff_rate) - 1) / 2e0 AS rw,
    rank() OVER (PARTITION BY pitch_type ORDER BY csw_rate) + (count(*) OVER (PARTITION BY pitch_type, csw_rate) - 1) / 2e0 AS rc
  FROM scored WHERE score IS NOT NULL),
found AS (SELECT pitch_type, count(*) AS n,
    CASE WHEN count(*) >= 15 THEN round_even(corr(rs, rw) * 1000, 0) / 1000 END AS r_whiff,
    CASE WHEN count(*) >= 15 THEN round_even(corr(rs, rc) * 1000, 0) / 1000 END AS r_csw
  FROM ranked GROUP BY pitch_type)
SELECT pitch_type, n, {_r('r_whiff', 'r_csw')}, coalesce(r_whiff < 0.35e0, false) AS low FROM found"""),
    "fit_metrics": _sql("scored", f"""
SELECT pitch_type, count(*) AS n,
  {_r(rmse='sqrt(avg((whiff_rate - csw_rate) ** 2))', corr='corr(whiff_rate, csw_rate)')}
FROM scored WHERE season = (SELECT max(season) FROM scored) GROUP BY pitch_type"""),
    # model inputs
    "time_split": _sql("profiles", f"""
SELECT {_KEYS}, CASE WHEN season < 2000 THEN 'train' WHEN season = 2000 THEN 'val' END AS split FROM profiles"""),
    "train_set": _sql("profiles", f"""
{_GATES}
SELECT {_KEYS}, n_pitches, CASE WHEN season < v THEN 'train' ELSE 'val' END AS split, rows_complete
FROM profiles JOIN gates USING (pitch_type), newest"""),
    # the first split of each type, from exact quantile bins and sums of gradients and weights
    "boost_first_split": _sql("profiles", f"""
{_GATES}, learned AS (
  SELECT p.*, n_pitches::DOUBLE AS w, lw_run_value AS y FROM profiles p JOIN gates USING (pitch_type), newest
  WHERE season < v),
base AS (SELECT pitch_type, sum((w * y)::DECIMAL(38, 12))::DOUBLE / sum(w::DECIMAL(38, 12))::DOUBLE AS base FROM learned GROUP BY pitch_type),
grad AS (SELECT learned.*, base, w * (base - y) AS g FROM learned JOIN base USING (pitch_type)),
long AS ({" UNION ALL ".join(f"SELECT pitch_type, {i} AS f, '{c}' AS feature, {c}::DOUBLE AS x, g, w FROM grad" for i, c in enumerate(_MODEL_INPUTS))}),
totals AS (
  SELECT pitch_type, f, sum(g) AS g_all, sum(w) AS w_all, coalesce(sum(g) FILTER (WHERE x IS NULL), 0) AS g_lack,
    coalesce(sum(w) FILTER (WHERE x IS NULL), 0) AS w_lack, count(x) AS n FROM long GROUP BY pitch_type, f),
steps AS (
  SELECT pitch_type, f, feature, x, sum(count(*)) OVER upto AS n_upto, count(*) AS n_at,
    sum(sum(g)) OVER upto AS g_upto, sum(sum(w)) OVER upto AS w_upto
  FROM long WHERE x IS NOT NULL GROUP BY pitch_type, f, feature, x
  WINDOW upto AS (PARTITION BY pitch_type, f ORDER BY x)),
cuts AS (
  SELECT s.*, t.* EXCLUDE (pitch_type, f) FROM steps s JOIN totals t USING (pitch_type, f)
  WHERE n_upto = n OR n_upto * 256 // n > (n_upto - n_at) * 256 // n),
sides AS (
  SELECT *, g_upto + late * g_lack AS gl, w_upto + late * w_lack AS wl, g_all - g_upto - late * g_lack AS gr,
    w_all - w_upto - late * w_lack AS wr
  FROM cuts, (VALUES (0), (1)) l(late)),
gains AS (
  SELECT *, {_score('gl', 'wl')} + {_score('gr', 'wr')} - {_score('g_all', 'w_all')} AS gain
  FROM sides WHERE wl >= 50 AND wr >= 50)
SELECT pitch_type, round(base + 3e-9, 6) + 0e0 AS base, feature,
  round(CASE WHEN n_upto = n THEN 'infinity'::DOUBLE ELSE x END + 3e-9, 6) + 0e0 AS threshold,
  {_r(gain='gain', leaf_left=_leaf('gl', 'wl'), leaf_right=_leaf('gr', 'wr'))}
FROM gains JOIN base USING (pitch_type) WHERE gain > 1e-6
QUALIFY row_number() OVER (PARTITION BY pitch_type ORDER BY round(gain, 9) DESC, late, f, x) = 1"""),
    "boost_held_out": """
SELECT l_returnflag AS returnflag, count(*) AS n, true AS halves_squares, true AS same_again
FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY l_returnflag""",
    # models: what is determined whatever the trees look like
    "train": _sql("profiles", f"""
{_GATES}
SELECT pitch_type, count_if(season < v) AS train_rows, count_if(season = v) AS val_rows,
  100e0 AS score_mean, 10e0 AS score_sd
FROM profiles JOIN gates USING (pitch_type), newest GROUP BY pitch_type"""),
    "train_limits": _sql("profiles", f"""
{_GATES}
SELECT pitch_type, true AS has_error, true AS within_rounds, CAST({_INPUTS} AS INTEGER) AS n_inputs FROM gates"""),
    "score": _sql("profiles", f"""
{_GATES}
SELECT pitch_type, count(*) AS profiles, count(rows_complete) AS scored, count(*) - count(rows_complete) AS unscored
FROM profiles LEFT JOIN gates USING (pitch_type) GROUP BY pitch_type"""),
    "job_tables": _sql("profiles", f"""
{_GATES}, fitted AS (SELECT p.* FROM profiles p JOIN gates USING (pitch_type)),
recent AS (SELECT fitted.* FROM fitted, newest WHERE season = v AND n_pitches >= 20)
SELECT 'clean' AS name, count(*) AS rows FROM cleaned UNION ALL SELECT 'features', count(*) FROM features
UNION ALL SELECT 'profiles', count(*) FROM profiles UNION ALL SELECT 'scored', count(*) FROM fitted
UNION ALL SELECT 'board', count(*) FROM recent UNION ALL SELECT 'board_by_type', count(*) FROM recent
UNION ALL SELECT 'career', count(*) FROM (SELECT DISTINCT pitcher, player_name, pitch_type FROM fitted)"""),
    "feature_importance": _sql("profiles", f"""
{_GATES}
SELECT pitch_type, CAST(15 AS BIGINT) AS entries, true AS without_gaps, true AS falling, true AS sums_to_one FROM gates"""),
    "model_roundtrip": _sql("profiles", """
SELECT count(*) AS profiles, CAST(0 AS BIGINT) AS changed FROM profiles"""),
}
