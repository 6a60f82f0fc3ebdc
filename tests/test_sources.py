import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetlens.params import load_params
from fleetlens.sources import feeds, trips

A_HEAD = ",".join(trips.ERA_A)
B_HEAD = ",".join(trips.ERA_B)


def test_eras():
    assert trips.detect_era(trips.ERA_A) == "A" and trips.detect_era(trips.ERA_B) == "B"
    with pytest.raises(ValueError):
        trips.detect_era(["a", "b"])


def test_mixed_eras_and_rules(spark, tmp_path):
    row = "{},2020-01-01 10:00:00.1230,2020-01-01 {},{},A,40.7,-74.0,{},B,40.8,-74.1,7,{},1980,1"
    (tmp_path / "a.csv").write_text("\n".join([
        A_HEAD, row.format(300, "10:05:00.1230", "5406.02", "9", "Subscriber"), row.format(30, "10:00:30.1230", "5406.02", "9", "Customer"),
        row.format(90, "10:01:30.1230", "9", "9", "Customer"), row.format(200, "10:03:20.1230", "9", "9", "Other"),
    ]))
    (tmp_path / "b.csv").write_text("\n".join([
        B_HEAD, "r1,classic,2025-01-01 00:00:00.123,2025-01-01 00:10:00.123,A,1,B,2,40.7,-74.0,40.8,-74.1,member",
        "r2,classic,2025-01-01 00:00:00.123,2025-01-01 00:10:00.123,A,1,,,40.7,-74.0,,,casual", "r3,classic,2025-01-01 00:00:00.123,2025-01-01 00:00:45.123,A,1,B,2,,,,,casual",
        "r4,classic,garbage,2025-01-01 00:00:45.123,A,1,B,2,,,,,casual",
    ]))
    raw = trips.read_trips(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert raw.count() == 8
    assert {r.rule: r.n for r in trips.quality_counts(raw).collect()} == {"kept": 3, "too_short": 2, "short_self_loop": 1, "null_station": 1, "null_timestamp": 1}
    kept = trips.keep_valid(raw)
    got = {(r.start_station_id, r.end_station_id, r.member_casual) for r in kept.collect()}
    assert got == {("5406.02", "9", "member"), ("9", "9", None), ("1", "2", "member")}
    trips.assert_clean(kept)
    with pytest.raises(AssertionError):
        trips.assert_clean(raw)
    assert {r.month_key: r.n_trips for r in trips.monthly_totals(kept).collect()} == {"2020-01": 2, "2025-01": 1}


def test_feeds(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"last_updated": 1, "data": {"stations": [{"station_id": "x", "short_name": "5406.02", "name": "n", "lat": 1.0, "lon": 2.0, "capacity": 3}] * 2}}))
    stations = feeds.read_stations(spark, str(tmp_path / "s.json"))
    assert stations.first().station_id == "5406.02" and stations.first().lng == 2.0
    assert feeds.duplicate_stations(stations).first().n == 2
    (tmp_path / "w.json").write_text(json.dumps({"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": [1.0, None], "precipitation": [0.0, 1.0], "wind_speed_10m": [2.0, 3.0], "relative_humidity_2m": [50.0, 60.0]}}))
    w = feeds.read_weather(spark, str(tmp_path / "w.json"))
    assert [r.temp_c for r in w.orderBy("timestamp").collect()] == [1.0, None]
    t = spark.sql("SELECT timestamp_ntz '2025-01-01 05:00:00' AS started_at")
    assert feeds.covers_range(w, t).first().covered
    (tmp_path / "r").mkdir()
    (tmp_path / "r/report-2025-03.txt").write_text("In March we rebalanced a total of 12,345 bikes across the city.")
    got = feeds.read_reports(spark, str(tmp_path / "r")).first()
    assert got.rebalanced_bikes_total == 12345 and got.month_start == dt.date(2025, 3, 1)
    assert feeds.read_reports(spark, str(tmp_path / "r/report-2025-03.txt")).count() == 1
    (tmp_path / "r/report-2025-04.txt").write_text("Ridership may rise. Staff rebalanced 7 bicycles during the month of April, 2025. In March it was less.")
    assert sorted(r.rebalanced_bikes_total for r in feeds.read_reports(spark, str(tmp_path / "r")).collect()) == [7, 12345]
    (tmp_path / "r/report-2025-05.txt").write_text("In April 2025 we rebalanced 5 bikes.")
    with pytest.raises(Exception, match="report-2025-05.txt: the report is about April"):
        feeds.read_reports(spark, str(tmp_path / "r")).collect()
    for name, text, fault in (("x-2025-05.txt", "nothing here", "no rebalancing sentence"), ("x-2025-05.txt", "rebalanced 5 bikes", "names no month"), ("x-2025-05.txt", "In May 2024 we rebalanced 5 bikes", "about May 2024"), ("x.txt", "In May we rebalanced 5 bikes", "in the file's name")):
        with pytest.raises(ValueError, match=fault):
            feeds.parse_report(text, name)


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    rows = [("a", "2025-01-05 10:00:00", "2025-01-05 10:20:00", "1", "2"), ("b", None, "2025-01-05 10:20:00", "1", "2"), ("c", "2025-01-05 10:00:00", "2025-01-05 10:20:00", None, "2"), ("d", "2025-01-05 10:00:00", "2025-01-05 10:00:30", "1", "2"), ("e", "2025-02-05 10:00:00", "2025-02-05 10:01:30", "1", "1"), ("f", "2025-02-05 10:00:00", "2025-02-05 10:30:00", "1", "1")]
    raw = spark.createDataFrame(rows, "ride_id string, started_at string, ended_at string, start_station_id string, end_station_id string")
    raw = raw.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    counts = trips.write_counted(raw.withColumn("ride_id", passed("ride_id")), str(tmp_path / "t"))
    assert counts == {"rows": 6, "null_timestamp": 1, "null_station": 1, "too_short": 1, "short_self_loop": 1, "kept": 2, "null_started_at": 0, "null_ended_at": 0, "null_start_station": 0, "null_end_station": 0, "ends_before_start": 0}
    assert sorted(r.ride_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "f"] and seen.value <= 7  # one scan, and a look at whether there are any rows
    assert trips.write_counted(raw.filter("ride_id = 'zz'"), str(tmp_path / "none"))["rows"] == 0


def test_params(tmp_path):
    (tmp_path / "p.yaml").write_text("allocation: {budget: 5, payouts: [1, 2]}\n")
    assert load_params(tmp_path / "p.yaml").allocation.payouts == (1, 2) and load_params().allocation.budget == 10_000
    (tmp_path / "q.yaml").write_text("allocation: {nonsense: 5}\n")
    with pytest.raises(KeyError):
        load_params(tmp_path / "q.yaml")


def test_months_are_replaced_and_parts_found(spark, tmp_path):
    one = lambda *days: spark.createDataFrame([(f"r{d}", d) for d in days], "ride_id string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    folder = str(tmp_path / "trips")
    trips.write_trips(one("2025-01-05", "2025-02-01"), folder)
    trips.write_trips(one("2025-02-03", "2025-02-04"), folder)
    assert sorted(r.ride_id for r in trips.read_parts(spark, folder, "none").collect()) == ["r2025-01-05", "r2025-02-03", "r2025-02-04"]
    one("2025-03-01").write.parquet(str(tmp_path / "single.parquet"))
    assert trips.read_parts(spark, str(tmp_path / "missing"), str(tmp_path / "single.parquet")).count() == 1


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import json

    from fleetlens import __main__ as cli

    lines = ["ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual"]
    lines += [f"r{i},b,2025-01-{1 + i % 20:02d} {i % 24:02d}:05:00,2025-01-{1 + i % 20:02d} {i % 24:02d}:35:00,A,{i % 3},B,{(i + 1) % 3},1,1,1,1,member" for i in range(600)]
    (tmp_path / "trips.csv").write_text("\n".join(lines))
    spark.createDataFrame([(str(i), 3, 40.7, -74.0 + i / 1000, "z") for i in range(3)], "station_id string, capacity int, lat double, lng double, zone_agg string").write.parquet(str(tmp_path / "stations"))
    hours = [f"2025-01-{d:02d}T{h:02d}:00" for d in range(1, 22) for h in range(24)]
    (tmp_path / "weather.json").write_text(json.dumps({"hourly": {"time": hours} | {c: [1.0] * len(hours) for c in ("temperature_2m", "precipitation", "wind_speed_10m", "relative_humidity_2m")}}))
    (tmp_path / "params.yaml").write_text("demand:\n  holdout_start: '2025-01-15'\n  runs_each: 3\n  min_bias_n: 2\n")
    monkeypatch.setattr(cli, "get_session", lambda *_: spark)
    arguments = ["unmet", "--trips", str(tmp_path / "trips.csv"), "--stations", str(tmp_path / "stations"), "--weather", str(tmp_path / "weather.json"), "--first", "2025-01-01", "--last", "2025-01-31", "--out", str(tmp_path / "out"), "--params", str(tmp_path / "params.yaml"), "--kind", "poisson"]
    cli.main(arguments)
    got = spark.read.parquet(str(tmp_path / "out/unmet/2025-01"))
    assert {"dep_gross_unmet", "arr_gross_unmet", "dep_D_hat"} <= set(got.columns) and got.count() == spark.read.parquet(str(tmp_path / "out/inventory")).count()
    cli.main(["ingest", "--trips", str(tmp_path / "trips.csv"), "--out", str(tmp_path / "clean")])
    assert json.loads(capsys.readouterr().out)["kept"] == 600 and spark.read.parquet(str(tmp_path / "clean")).count() == 600
    (tmp_path / "trips.csv").write_text(lines[0])  # what is written isn't made again
    cli.main(arguments)
    assert spark.read.parquet(str(tmp_path / "out/unmet/2025-01")).count() == got.count()


def test_allocate_command(spark, tmp_path, monkeypatch, capsys):
    """Trips of one's own, with ids that are text, up to funded moves; a second run makes nothing again."""
    import json

    from fleetlens import __main__ as cli

    lines = ["ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual"]
    lines += [f"r{i},b,2025-01-{6 + i % 21:02d} {(i * 7) % 24:02d}:{i % 4 * 15:02d}:00,2025-01-{6 + i % 21:02d} {(i * 7) % 24:02d}:{i % 4 * 15 + 10:02d}:00,A,{'s0' if i % 3 else 's1'},B,{'s1' if i % 5 else 's2'},1,1,1,1,member" for i in range(900)]
    (tmp_path / "trips.csv").write_text("\n".join(lines))
    spark.createDataFrame([(f"s{i}", 3, 40.7, -74.0 + i / 1000, "z") for i in range(3)], "station_id string, capacity int, lat double, lng double, zone_agg string").write.parquet(str(tmp_path / "stations"))
    (tmp_path / "params.yaml").write_text("demand:\n  holdout_start: '2025-01-20'\n  runs_each: 3\n  min_bias_n: 2\nvalue:\n  min_weeks: 2\n  low_inventory: 1.0\nallocation:\n  budget: 5.0\n  origin_max_low: 0.5\n")
    monkeypatch.setattr(cli, "get_session", lambda *_: spark)
    arguments = ["allocate", "--trips", str(tmp_path / "trips.csv"), "--stations", str(tmp_path / "stations"), "--out", str(tmp_path / "out"), "--params", str(tmp_path / "params.yaml")]
    cli.main(arguments)
    counts = json.loads(capsys.readouterr().out)
    assert set(counts) == {"moves", "ranking", "funded", "tops", "stability", "core"} and counts["moves"] > 0 and counts["funded"] <= counts["ranking"] <= counts["moves"]
    (tmp_path / "trips.csv").write_text(lines[0])
    cli.main(arguments)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == counts
