"""Landed formats, sinks, incremental load, streams and the contract of the entry file."""

import gzip
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hydroseries.session import cut_lineage, shared_folder
from hydroseries.sources import documents, files, gauge_text, ingest, rain_grid
from hydroseries.streaming import ingest as stream

# Readings and limits in the format of the gauges.
POINTS = ";".join(f"2026-09-06 0{i // 6}.{i % 6}0.00,{v}" for i, v in enumerate([491, 496, 488, 492, 493, 494, 491, 491, 491, 491]))
RAW = POINTS + ";|9500;8500;7500|\n\n<html>\n</html>\n"


def parse(spark, raw, **kw):
    return gauge_text.parse_gauge_text(spark.createDataFrame([("122", raw)], "series_id string, raw string"), ["series_id"], **kw)


def test_raw_text(spark):
    g = parse(spark, RAW)
    rows = g.points.orderBy("ts").collect()
    assert len(rows) == 10 and rows[0].value == 491.0 and rows[0].series_id == "122" and rows[9].ts == datetime(2026, 9, 6, 1, 30)
    assert tuple(g.limits.first())[1:] == (950.0, 850.0, 750.0) and g.rejects.count() == 0


def test_empty_data_part_still_has_limits(spark):
    g = parse(spark, "|9500;8500;7500|")
    assert g.points.count() == 0 and g.limits.first().limit1 == 950.0


@pytest.mark.parametrize("raw", ["nothing here", "2026-09-06 00.00.00,abc;|1;2;3|"])
def test_bad_text_is_rejected_or_fails(spark, raw):
    assert parse(spark, raw).rejects.count() == 1
    with pytest.raises(Exception, match="bad data point|unexpected text"):
        parse(spark, raw, mode="strict").points.collect()


@pytest.mark.parametrize("part", ["9500;8500", "9500;x;7500", ""])
def test_unusable_limits_are_null(spark, part):
    assert tuple(parse(spark, f"|{part}|").limits.first())[1:] == (None, None, None)


def test_station_config_both_formats(spark, tmp_path):
    limits = {"siaga1": 950.0, "siaga2": None, "siaga3": None}
    doc = {"stations": [{"id": 1, "nama": "A", "ambang_siaga_cm": limits, "koordinat": {"lat": -6.1, "lon": 106.8, "sumber": "s"}},
                        {"id": 2, "nama": "B", "ambang_siaga_cm": limits}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    rows = documents.read_stations(spark, str(tmp_path / "s.json")).orderBy("station_id").collect()
    assert rows[0].lat == -6.1 and rows[1].lat is None and rows[1].limit1 == 950.0
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(doc))
    assert documents.read_stations(spark, str(tmp_path / "s.yaml")).orderBy("station_id").collect() == rows


def test_pages_reports_and_ways(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"meta": {"title": "t"}, "rows": [{"rn": 1, "a": 5, "b": "x"}]}, indent=1))
    (tmp_path / "p" / "2.json").write_text(json.dumps({"meta": {}, "rows": [{"rn": 2, "a": 6}]}))
    rows = documents.read_pages(spark, str(tmp_path / "p")).orderBy("a").collect()
    assert [r.asDict() for r in rows] == [{"a": "5", "b": "x"}, {"a": "6", "b": None}]
    feature = {"properties": {"pkey": "7", "created_at": "2026-01-12T03:00:00Z", "disaster_type": "flood", "report_data": None, "tags": {"city": "c"}},
               "geometry": {"coordinates": [106.8, -6.1]}}
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    r = documents.read_reports(spark, str(tmp_path / "r.json")).first()
    assert len(r) == 11 and r.lon == 106.8 and r.flood_depth_cm is None and r.created_at == datetime(2026, 1, 12, 3)
    way = {"type": "way", "id": 5, "nodes": [1, 2], "geometry": [{"lat": 0, "lon": 1}, {"lat": 2, "lon": 3}], "tags": {"waterway": "river"}}
    (tmp_path / "w.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1}, way]}))
    w = documents.read_ways(spark, str(tmp_path / "w.json")).first()
    assert w.waterway == "river" and [p.node for p in w.path] == [1, 2]


def test_binary_grid_files(spark, tmp_path):
    grid = np.arange(200, dtype="<f4").reshape(10, 20)
    grid[2, 3] = -1
    (tmp_path / "rain.20240101.0500.dat.gz").write_bytes(gzip.compress(grid.tobytes()))
    (tmp_path / "rain.20240101.0600.dat.gz").write_bytes(b"broken")
    cells = rain_grid.read_hourly_grids(spark, str(tmp_path), (59.65, 59.75, 0.35, 0.45), shape=(10, 20)).orderBy("lat", "lon").collect()
    assert [(r.ts, r.mm) for r in cells] == [(datetime(2024, 1, 1, 5), v) for v in (63.0, 64.0, None, 44.0)]
    days = spark.createDataFrame([(datetime(2024, 1, 1).date(),)], "day date")
    _, missing = rain_grid.expected_hours(rain_grid.read_hourly_grids(spark, str(tmp_path), (59.65, 59.75, 0.35, 0.45), shape=(10, 20)), days)
    assert missing.count() == 23


def test_events_csv_and_views(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_id,start,end,type,a,b,c,d,e,f,status,notes\nE1,2025-01-28,2025-01-29,pluvial+tidal,3-4 over 5 days,44,0.53,5,10-100,low,candidate,\"a, b\"\n")
    row = files.read_events(spark, str(tmp_path / "e.csv")).first()
    assert str(row.start) == "2025-01-28" and row.tide_max_m == 0.53 and row.notes == "a, b"
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert files.register_views(spark, {"v_t": str(tmp_path / "t"), "v_none": str(tmp_path / "none")}) == ["v_none"]
    assert files.view_sizes(spark, ["v_t"]).first().n == 3
    assert files.markdown_table(spark.range(2)).splitlines()[2:] == ["| 0 |", "| 1 |"]


def points(spark, hours, value=1.0, start=datetime(2024, 3, 1)):
    rows = [("s", start + timedelta(minutes=10 * i), value + i % 3) for i in range(hours * 6)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def test_repeated_ingest_changes_nothing_and_stored_rows_win(spark, tmp_path):
    p, h = str(tmp_path / "p"), str(tmp_path / "h")
    ingest.ingest(spark, points(spark, 5), p, h)
    first = sorted(map(tuple, spark.read.parquet(h).collect()))
    ingest.ingest(spark, points(spark, 5, value=100.0), p, h)
    assert sorted(map(tuple, spark.read.parquet(h).collect())) == first
    ingest.ingest(spark, points(spark, 7), p, h)
    assert spark.read.parquet(h).count() == 7


def test_stream_of_raw_files_reads_each_file_once(spark, tmp_path):
    raw, state = tmp_path / "raw", str(tmp_path / "state")
    (raw / "122").mkdir(parents=True)
    (raw / "122" / "2026-09-06_2026-09-06.txt").write_text(RAW)
    p, h = str(tmp_path / "p"), str(tmp_path / "h")
    for extra in (None, RAW.replace("09-06", "09-07")):
        if extra:
            (raw / "122" / "2026-09-07_2026-09-07.txt").write_text(extra)
        stream.ingest_stream(stream.raw_file_stream(spark, str(raw)).points, p, h, state).awaitTermination()
    assert spark.read.parquet(p).count() == 20


def test_checkpoint_goes_to_the_named_folder(spark):
    assert shared_folder(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_every_query_with_sql_exists():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["k", "start", "end", "n", "mean_share"] and out.count() == 5


def test_raw_folder_to_tables_keeps_ids_and_the_first_value(spark, tmp_path):
    raw, p, h = tmp_path / "raw", str(tmp_path / "p"), str(tmp_path / "h")

    def put(series, day, text):
        (raw / series).mkdir(parents=True, exist_ok=True)
        (raw / series / f"{day}_{day}.txt").write_text(text + "|900;800;700|")

    put("0140", "2024-03-01", "2024-03-01 00.10.00,9;2024-03-01 00.20.00,9;2024-03-01 00.20.00,3;oops")
    put("140", "2024-03-01", "2024-03-01 00.20.00,1")
    first = ingest.ingest_incremental(spark, f"{raw}/*/*.txt", p, h)
    assert first.rejects.count() == 1 and first.limits.count() == 2
    put("0140", "2024-03-02", "2024-03-01 00.20.00,4;2024-03-02 00.20.00,5")
    ingest.ingest_incremental(spark, f"{raw}/*/*.txt", p, h)
    stored = ingest.stored(spark, p)
    assert sorted((r.series_id, r.ts.day, r.ts.minute, r.value) for r in stored.collect()) == [
        ("0140", 1, 10, 9.0), ("0140", 1, 20, 9.0), ("0140", 2, 20, 5.0), ("140", 1, 20, 1.0)
    ]
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["series_id=0140", "series_id=140"]


def test_only_touched_partitions_are_read_and_nothing_stays_cached(spark, tmp_path):
    from hydroseries import session

    p, h = str(tmp_path / "p"), str(tmp_path / "h")
    before = len(session._shared)
    for year in (2022, 2023, 2024):
        ingest.ingest(spark, points(spark, 5, start=datetime(year, 3, 1)), p, h)
    assert len(session._shared) == before
    read = ingest.touched(ingest.stored(spark, p), points(spark, 2, start=datetime(2023, 3, 1)), "series_id", "ts")
    assert read.count() == 30
    plan = read._jdf.queryExecution().toString()
    assert "year" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0] and "2023" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_stream_keeps_the_first_value_in_file_order(spark, tmp_path):
    """Of several values of one time the first in the order of files and places stays, as in the batch load."""
    raw = tmp_path / "raw" / "0140"
    raw.mkdir(parents=True)
    (raw / "2024-01-02_2024-01-02.txt").write_text("2024-01-01 00.10.00,3;2024-01-01 00.20.00,1;|1;2;3|")
    (raw / "2024-01-01_2024-01-01.txt").write_text("2024-01-01 00.10.00,9;2024-01-01 00.10.00,2;2024-01-01 00.20.00,8;|1;2;3|")
    made = []
    for name in ("batch", "stream"):
        p, h, state = (str(tmp_path / name / x) for x in ("points", "hourly", "state"))
        if name == "batch":
            ingest.ingest_incremental(spark, f"{tmp_path}/raw/*/*.txt", p, h)
        else:
            points = stream.raw_file_stream(spark, str(tmp_path / "raw")).points
            stream.ingest_stream(points, p, h, state, trigger={"once": True}).awaitTermination()
        made.append(sorted((r.series_id, r.ts, r.value) for r in ingest.stored(spark, p).collect()))
    assert made[0] == made[1] and [v for _, _, v in made[0]] == [9.0, 8.0]


def test_shelves_of_many_series_replace_only_the_series_years_written(spark, tmp_path):
    p = str(tmp_path / "p")

    def put(ids, years, value):
        rows = [(f"{i:04d}", datetime(y, m, 1), value) for i in ids for y in years for m in (1, 2)]
        files.write_series(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double"), p, ["series_id"], "ts", shelves=4)

    put(range(300), (2023, 2024), 1.0)
    put(range(0, 300, 2), (2024,), 2.0)
    put(range(300, 303), (2025,), 3.0)
    got = {(r.series_id, r.ts): r.value for r in spark.read.parquet(p).collect()}
    want = {(f"{i:04d}", datetime(y, m, 1)): 2.0 if y == 2024 and i % 2 == 0 else 1.0 for i in range(300) for y in (2023, 2024) for m in (1, 2)}
    want.update({(f"{i:04d}", datetime(2025, m, 1)): 3.0 for i in range(300, 303) for m in (1, 2)})
    assert got == want and spark.read.parquet(p).count() == len(want)
    assert all(x.name.startswith("shelf=") for x in (tmp_path / "p").iterdir() if x.is_dir())
