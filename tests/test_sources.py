import os
import time
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchrank.operators import boards as B
from pitchrank.schema import KEEP_COLUMNS, as_pitches, ensure_columns, keep_columns, nan_to_null
from pitchrank.sources import calendar as K
from pitchrank.sources import landing as L
from pitchrank.sources import tables as S
from pitchrank.sources import versions as V
from pitchrank.streaming.ingest import finish_deliveries, follow_landing, late_rows, month_states


def days(*isos, first=0, **other):
    return [{"game_pk": first + i, "game_date": date.fromisoformat(d), **other} for i, d in enumerate(isos)]


def ids(df):
    return sorted(r.game_pk for r in df.select("game_pk").collect())


def test_schema_helpers(spark):
    assert len(KEEP_COLUMNS) == 42
    df = spark.createDataFrame([(1.0, "x", float("nan"))], "vx0 double, other string, game_pk double")
    assert keep_columns(df).columns == ["game_pk", "vx0"]
    assert as_pitches(df.drop("game_pk")).columns == ["vx0"]
    assert nan_to_null(df).first().game_pk is None
    more = ensure_columns(df, {"vx0": "int", "zone": "int"})
    assert more.schema["zone"].dataType.simpleString() == "int" and more.first().vx0 == 1.0


def test_tables_written_by_pandas(spark, tmp_path):
    pd.DataFrame({"game_date": pd.to_datetime(["2021-04-05 13:00", None]).astype("datetime64[ns]"),
                  "game_pk": [1.0, 2.0], "release_speed": [95.5, float("nan")], "balls": ["2", "many"]}
                 ).to_parquet(tmp_path / "p.parquet")
    out = as_pitches(spark.read.parquet(str(tmp_path / "p.parquet"))).orderBy("game_pk").collect()
    assert [tuple(r[c] for c in ("game_date", "game_pk", "release_speed", "balls")) for r in out] == \
        [(date(2021, 4, 5), 1, 95.5, 2), (None, 2, None, None)]


def test_seasons(spark, pitches, tmp_path):
    root = str(tmp_path / "raw")
    df = pitches(days("2020-08-01", "2021-05-01", "2022-05-01", "2026-05-01"))
    S.write_table(df.withColumn("season", F.year("game_date")), root, partition_by=["season"])
    assert ids(S.load_seasons(spark, root, [2021, 2022])) == [1, 2]
    with pytest.raises(FileNotFoundError, match="2019"):
        S.load_seasons(spark, root, [2019, 2021])
    out = S.load_seasons(spark, root, [2020, 2026, 2026], include_current=True, columns=["game_pk", "absent", "season"])
    assert ids(out) == [0, 3] and out.columns == ["game_pk", "season"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan or "season#" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        S.write_table(df, root, codec="rar")


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2.5, 2)], "d double, i int")
    assert sorted(map(tuple, S.union_tables(a, b).collect()), key=str) == [(1, "x", None), (2, None, 2.5)]


def test_csv_cache_follows_the_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n")
    assert S.read_csv_cached(spark, str(path)).collect() == [(1, "x")]
    old = os.path.getmtime(path)
    path.write_text("a,b\n2,y\n")
    os.utime(path, (old - 3600, old - 3600))
    assert S.read_csv_cached(spark, str(path)).first().a == 1  # the copy is newer
    future = time.time() + 3600
    os.utime(path, (future, future))
    assert S.read_csv_cached(spark, str(path)).first().a == 2


def test_board_csv_keeps_the_order(spark, tmp_path):
    rows = [("A", i, 2026, "FF" if i % 3 else "SL", "g", 60, float(i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, ("player_name string, pitcher long, season int, pitch_type string, "
                                      "pitch_group string, n_pitches long, score double"))
    S.save_board(B.leaderboard(df), str(tmp_path / "b"))
    files = sorted(f for f in os.listdir(tmp_path / "b") if f.endswith(".csv"))
    lines = [ln.split(",") for f in files for ln in (tmp_path / "b" / f).read_text().splitlines()[1:]]
    assert [(float(x[6]), int(x[1])) for x in lines] == sorted(((float(i % 17), i) for i in range(200)), key=lambda p: (-p[0], p[1]))
    S.save_board(B.leaderboards_by(df, "pitch_type"), str(tmp_path / "t"), "pitch_type")
    assert {d for d in os.listdir(tmp_path / "t") if "=" in d} == {"pitch_type=FF", "pitch_type=SL"}


def test_calendar(spark, pitches):
    assert K.season_range(2020) == (date(2020, 7, 23), date(2020, 10, 27))
    with pytest.raises(ValueError):
        K.season_range(1990)
    df = pitches(days("2021-03-31", "2021-04-01", "2021-11-02", "2021-11-03", "1990-06-01"))
    assert [(r.game_pk, r.season) for r in K.in_season(df).orderBy("game_pk").collect()] == [(1, 2021), (2, 2021)]
    months = K.season_months(2026, date(2026, 5, 10))
    assert months == [(date(2026, 3, 1), date(2026, 3, 31)), (date(2026, 4, 1), date(2026, 4, 30)), (date(2026, 5, 1), date(2026, 5, 10))]
    assert K.season_months(2025, date(2026, 1, 3))[-1] == (date(2026, 1, 1), date(2026, 1, 3))
    one = spark.sql("SELECT DATE '2023-11-20' AS a, DATE '2024-02-10' AS b")
    got = [(r.month_start, r.month_end) for r in K.month_ranges(one, F.col("a"), F.col("b")).collect()]
    assert got == [(date(2023, 11, 1), date(2023, 11, 30)), (date(2023, 12, 1), date(2023, 12, 31)),
                   (date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 10))]


def test_season_is_taken_once(spark, pitches, tmp_path):
    root = str(tmp_path / "raw")
    landing = pitches(days("2021-04-10", "2021-05-10", "2021-12-01", "2022-05-01"))
    today = date(2022, 6, 1)
    assert ids(L.ingest_season(spark, landing, root, 2021, today=today)) == [0, 1]
    rest = pitches(days("2021-07-01", first=50))
    assert ids(L.ingest_season(spark, rest, root, 2021, today=today)) == [0, 1]  # complete, so not looked at
    assert ids(L.ingest_season(spark, rest, root, 2021, force=True, today=today)) == [50]  # months gone are gone
    m = L.read_manifest(spark, root).collect()
    assert [(r.season, r.month, r.rows, r.is_complete) for r in m] == [(2021, 7, 1, True)]
    assert m[0].size_bytes > 0 and m[0].fetched_at is not None
    # the running season stays open and is read again
    assert ids(L.ingest_season(spark, landing, root, 2022, today=today)) == [3]
    more = pitches(days("2022-05-01", "2022-05-02", first=3))
    assert ids(L.ingest_season(spark, more, root, 2022, today=today)) == [3, 4]
    # an empty landing area leaves the store alone
    assert L.ingest_season(spark, more.limit(0), root, 2022, today=today).count() == 0
    assert ids(S.read_store(spark, root)) == [3, 4, 50]
    shown = L.cache_summary(L.read_manifest(spark, root)).collect()
    assert [r.file for r in shown] == ["season=2021/month=7", "season=2022/month=5"]


def test_months_are_refreshed_until_complete(spark, pitches, tmp_path):
    root = str(tmp_path / "raw")
    first = pitches(days("2026-03-30", "2026-04-05", "2026-04-20", "2025-05-01"))
    assert ids(L.refresh_months(spark, first, root, 2026, date(2026, 4, 10))) == [0, 1]  # not the days to come
    later = pitches(days("2026-03-31", "2026-04-05", "2026-04-20", "2026-05-02", first=10))
    # March is complete; April was open and is replaced
    assert ids(L.refresh_months(spark, later, root, 2026, date(2026, 5, 3))) == [0, 11, 12, 13]
    state = {r.month: r.is_complete for r in L.read_manifest(spark, root).collect()}
    assert state == {3: True, 4: True, 5: False}
    assert ids(L.refresh_months(spark, later, root, 2026, date(2026, 5, 3), force=True)) == [10, 11, 12, 13]
    # the same again changes nothing, and months without rows stay
    assert ids(L.refresh_months(spark, later.limit(0), root, 2026, date(2026, 5, 3))) == [10, 11, 12, 13]
    assert L.refresh_months(spark, later.limit(0), str(tmp_path / "new"), 2026, date(2026, 5, 3)).count() == 0


def test_streamed_deliveries(spark, pitches, tmp_path):
    landing, root, marks = (str(tmp_path / n) for n in ("landing", "raw", "marks"))
    schema = pitches([{}]).schema

    def deliver(rows, delivery, today, force=False, files=1, finished=()):
        (pitches(rows).withColumn("delivery", F.lit(delivery)).repartition(files, "game_pk")
         .write.mode("append").partitionBy("delivery").parquet(landing))
        follow_landing(spark, landing, root, marks, today, force, files_per_batch=1, schema=schema,
                       finished=finished)
        return ids(S.read_store(spark, root))

    march = days("2026-03-27", "2026-03-28", "2026-03-29", "2026-03-30")
    assert deliver(march, 1, date(2026, 3, 31), files=3) == [0, 1, 2, 3]  # several batches, no row lost
    # the month again, one row fewer, together with the next
    assert deliver(march[:3] + days("2026-04-02", "2026-04-03", first=20), 2, date(2026, 4, 4), files=2) == [0, 1, 2, 20, 21]
    # March is over, but the delivery may go on: what lands later is not lost
    assert deliver(days("2026-03-31", first=25), 2, date(2026, 4, 4)) == [0, 1, 2, 20, 21, 25]
    assert not any(r.is_complete for r in L.read_manifest(spark, root).collect())
    # a finished delivery closes it: late rows are ignored, unless forced
    assert deliver(march[:2], 3, date(2026, 4, 5), finished=[3]) == [0, 1, 20, 21]
    late = days("2026-03-27", first=30)
    assert deliver(late, 4, date(2026, 4, 5)) == [0, 1, 20, 21]
    assert deliver(days("2026-03-26", first=40), 5, date(2026, 4, 5), force=True) == [20, 21, 40]
    # nothing new: nothing changes
    follow_landing(spark, landing, root, marks, date(2026, 4, 6), schema=schema)
    assert ids(S.read_store(spark, root)) == [20, 21, 40]
    assert {(r.month, r.rows) for r in L.read_manifest(spark, root).collect()} == {(3, 1), (4, 2)}


def test_months_close_without_new_files(spark, pitches, tmp_path):
    landing, root, marks = (str(tmp_path / n) for n in ("landing", "raw", "marks"))
    schema = pitches([{}]).schema

    def land(rows, delivery):
        pitches(rows).withColumn("delivery", F.lit(delivery)).write.mode("append").partitionBy("delivery").parquet(landing)

    def follow(today, **how):
        follow_landing(spark, landing, root, marks, today, schema=schema, **how)
        return {r.month: (r.latest, r.open_deliveries, r.late_rows, r.rows, r.is_complete)
                for r in month_states(spark, root, marks).collect()}

    march, april = days("2026-03-27", "2026-03-28"), days("2026-04-02", first=20)
    land(march + april, 1)
    assert follow(date(2026, 4, 10)) == {3: (1, 1, 0, 2, False), 4: (1, 1, 0, 1, False)}
    # the delivery is over: March closes, April runs on
    assert follow(date(2026, 4, 10), finished=(1,)) == {3: (1, 0, 0, 2, True), 4: (1, 0, 0, 1, False)}
    # the calendar alone closes April
    assert follow(date(2026, 5, 1)) == {3: (1, 0, 0, 2, True), 4: (1, 0, 0, 1, True)}
    # late rows of March lie aside; May is open until the mark comes, before or after its files
    land(days("2026-03-30", first=30) + days("2026-05-02", first=40), 2)
    assert follow(date(2026, 6, 2)) == {3: (1, 0, 1, 2, True), 4: (1, 0, 0, 1, True), 5: (2, 1, 0, 1, False)}
    assert [(r.game_pk, r.delivery) for r in late_rows(spark, marks, schema).collect()] == [(30, 2)]
    land(days("2026-05-03", first=41), 2)
    finish_deliveries(spark, landing, 2, 2)
    assert follow(date(2026, 6, 2), files_per_batch=1)[5] == (2, 0, 0, 2, True)
    assert ids(S.read_store(spark, root)) == [0, 1, 20, 40, 41]
    # forced rows open a month again
    land(days("2026-04-09", first=50), 3)
    assert follow(date(2026, 6, 2), force=True)[4] == (3, 1, 0, 1, False)
    assert follow(date(2026, 6, 2), finished=(3,))[4] == (3, 0, 0, 1, True)


def test_replacement_is_seen_at_once(spark, pitches, tmp_path):
    root = str(tmp_path / "raw")
    L.replace_months(spark, pitches(days("2026-03-27", "2026-03-28", "2026-04-01")), root, date(2026, 5, 1))
    reader = S.read_store(spark, root)
    staged = L.stage_months(spark, pitches(days("2026-03-29", first=10)), root)
    assert ids(S.read_store(spark, root)) == [0, 1, 2] and len(staged.rows) == 1  # written, not visible
    with pytest.raises(Exception, match="no such pitch"):
        bad = pitches(days("2026-03-30", "2026-04-02", first=20)).repartition(2, "game_pk")
        L.stage_months(spark, bad.withColumn("release_speed", F.when(F.col("game_pk") == 21, F.raise_error(F.lit("no such pitch")))
                                             .otherwise(F.lit(90.0)).cast("double")), root, skip_same=False)
    assert ids(S.read_store(spark, root)) == [0, 1, 2]
    L.commit_months(spark, staged, F.lit(True))
    assert ids(S.read_store(spark, root)) == [2, 10]
    assert ids(reader) == [0, 1, 2]  # a reader that had begun goes on with what it saw
    # nothing is removed that is listed; of the rest all that is older
    assert V.remove_unlisted(spark, root, 0) == 0
    assert V.remove_unlisted(spark, root, 1 << 60) > 0
    assert ids(S.read_store(spark, root)) == [2, 10] and ids(S.load_seasons(spark, root, [2026])) == [2, 10]


def test_writers_that_meet_lose_nothing(spark, pitches, tmp_path):
    root = str(tmp_path / "raw")
    march, april = (L.stage_months(spark, pitches(days(d, first=n)), root) for n, d in enumerate(("2026-03-27", "2026-04-01")))
    met = []

    def change(old):
        if not met:
            met.append(1)
            L.commit_months(spark, april, F.lit(True))  # another writer comes in between
        return old.unionByName(spark.createDataFrame([(1, 1, None, False, 2026, 3, march.version, None)], old.schema))

    V.commit(spark, root, change)
    assert ids(S.read_store(spark, root)) == [0, 1]
    assert {(r.month, r.is_complete) for r in L.read_manifest(spark, root).collect()} == {(3, False), (4, True)}


def test_unchanged_months_are_not_written_again(spark, pitches, tmp_path):
    root, today = str(tmp_path / "raw"), date(2026, 6, 1)
    rows = pitches(days("2026-03-27", "2026-03-28", "2026-04-01"))

    def files():
        return {f for _, _, names in os.walk(root) for f in names if f.endswith(".parquet")}

    L.replace_months(spark, rows, root, today)
    before, listed = files(), L.read_manifest(spark, root).select("month", "version", "fingerprint").collect()
    # the same rows in other files, another order and with other types
    other = rows.repartition(3, "game_pk").withColumn("game_date", F.col("game_date").cast("string"))
    L.replace_months(spark, other.select(*reversed(other.columns)), root, today)
    assert files() == before
    assert sorted(L.read_manifest(spark, root).select("month", "version", "fingerprint").collect()) == sorted(listed)
    # one value moves to another column: its month is written, the other is not
    moved = rows.withColumns({"ax": F.when(F.col("game_pk") == 0, F.col("az")).otherwise(F.col("ax")),
                              "az": F.when(F.col("game_pk") == 0, F.col("ax")).otherwise(F.col("az"))})
    L.replace_months(spark, moved, root, today)
    now = {r.month: r.version for r in L.read_manifest(spark, root).collect()}
    old = {r.month: r.version for r in listed}
    assert now[4] == old[4] and now[3] != old[3] and files() > before
    # a repeated row counts
    L.replace_months(spark, S.union_tables(rows, rows.where("game_pk = 2")), root, today)
    assert ids(S.read_store(spark, root)) == [0, 1, 2, 2]
    L.replace_months(spark, rows.limit(0), root, today)
    assert ids(S.read_store(spark, root)) == [0, 1, 2, 2]


def test_clustered_months_are_skipped_by_pitcher_and_by_type(spark, pitches, tmp_path):
    rows = spark.range(40000).select(F.date_add(F.lit("2026-03-27").cast("date"), (F.col("id") % 40).cast("int")).alias("game_date"),
                                     F.col("id").alias("game_pk"), (400000 + F.pmod(F.xxhash64("id"), F.lit(400))).alias("pitcher"),
                                     F.element_at(F.array(*[F.lit(t) for t in ("FF", "SL", "CH", "CU", "??")]),
                                                  (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) + 1).cast("int")).alias("pitch_type"))
    share = {}
    for name, layout in (("plain", {}), ("clustered", {"clustered": True, "page_rows": 200})):
        root = str(tmp_path / name)
        L.replace_months(spark, rows.repartition(3), root, date(2026, 6, 1), **layout)
        stored = S.read_store(spark, root)
        assert ids(stored) == list(range(40000))
        for wanted in ("pitcher = 400123", "pitch_type = 'CU'"):
            found = stored.where(wanted)
            assert found.count() == rows.where(wanted).count()
            share[name, wanted] = S.rows_scanned(found.select("game_pk", "pitcher", "pitch_type")) / 40000
    assert share["plain", "pitcher = 400123"] > 0.9
    assert share["clustered", "pitcher = 400123"] < 0.15 and share["clustered", "pitch_type = 'CU'"] < 0.5
    key = spark.range(1).select(S.interleaved(F.lit(0b101), F.lit(0b011), bits=3)).first()[0]
    assert key == 0b100111
    L.replace_months(spark, rows.limit(0), str(tmp_path / "none"), date(2026, 6, 1), skip_same=False, clustered=True)
