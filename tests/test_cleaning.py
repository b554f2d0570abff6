import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gustline import schemas
from gustline.functions import scalar
from gustline.operators import clean, joins
from gustline.session import scratch
from gustline.sources import readers, sinks

HOUR = datetime(2024, 5, 1, 10)


def raw(spark, source, **kw):
    return spark.createDataFrame([tuple(kw.get(f.name) for f in schemas.RAW_SCHEMAS[source].fields)], schemas.RAW_SCHEMAS[source])


def test_openaq_record(spark):
    r = clean.normalize(raw(spark, "openaq", station_id="openaq-1", parameter="no2", value=4.0, datetime_utc="2024-05-01T10:42:00Z"), "openaq").first()
    assert (r.timestamp, r.no2, r.pm25, r.source, r.error) == (HOUR, 4.0, None, "openaq", None)


def test_unmapped_parameter_keeps_the_row(spark):
    r = clean.normalize(raw(spark, "openaq", station_id="a", parameter="voc", value=4.0, datetime_utc="2024-05-01T10:42:00Z"), "openaq").first()
    assert r.error is None and all(r[c] is None for c in schemas.POLLUTANTS)


def test_weather_record(spark):
    r = clean.normalize(raw(spark, "envcanada", station_id="swob-1", datetime_utc="2024-05-01T10:00:00Z", latitude=1.0, longitude=2.0, air_temp=3.0,
                            rel_hum=4.0, wind_speed=5.0, wind_dir=6.0, pressure=7.0, dew_point=8.0), "envcanada").first()
    assert (r.latitude, r.longitude, r.temperature, r.humidity, r.wind_speed, r.wind_dir, r.pressure, r.dew_point) == tuple(map(float, range(1, 9)))


def test_city_record(spark):
    assert clean.normalize(raw(spark, "iqair", station_id="c", datetime_utc="2024-05-01T10:00:00", pm25=9.0), "iqair").first().pm25 == 9.0


@pytest.mark.parametrize("source,kw,word", [
    ("iqair", {"datetime_utc": "2024-05-01T10:00:00"}, "station_id"), ("iqair", {"station_id": "c"}, "datetime_utc"),
    ("iqair", {"station_id": "c", "datetime_utc": "soon"}, "datetime_utc"),
])
def test_rejects_keep_reason_and_payload(spark, source, kw, word):
    df = raw(spark, source, **kw).withColumn("offset", F.lit(7))
    bad = clean.rejects(df, source, "raw.iqair").first()
    assert word in bad.error and (bad.source_topic, bad.offset) == ("raw.iqair", 7)
    assert json.loads(base64.b64decode(bad.value_b64)) == kw


def test_unknown_source(spark):
    df = raw(spark, "iqair", station_id="c", datetime_utc="2024-05-01T10:00:00")
    assert "unknown source" in clean.normalize(df, "other").first().error


def measurements(spark, *recs):
    data = [(s, "openaq", HOUR, datetime(2024, 5, 1, 10, i), i, *v) for i, (s, *v) in enumerate(recs)]
    return spark.createDataFrame(data, "station_id string, source string, timestamp timestamp, ingested_at timestamp, event_id long, pm25 double, no2 double, o3 double")


def test_last_non_null_wins_and_parameters_merge(spark):
    df = measurements(spark, ("a", 1.0, None, None), ("a", None, 2.0, None), ("a", 3.0, None, None), ("b", None, None, 5.0))
    out = {r.station_id: r for r in clean.collapse_same_hour(df).collect()}
    assert (out["a"].pm25, out["a"].no2, out["a"].o3) == (3.0, 2.0, None) and out["b"].o3 == 5.0
    assert out["a"].ingested_at == datetime(2024, 5, 1, 10, 2)


def test_sink_upserts_per_key_in_its_date(spark):
    path = scratch(spark, "sink")
    sinks.upsert_by_date(measurements(spark, ("a", 1.0, None, None), ("b", 9.0, None, None)), path)
    sinks.upsert_by_date(measurements(spark, ("a", None, 2.0, None)), path)
    other = measurements(spark, ("a", 4.0, None, None)).withColumn("timestamp", F.lit(datetime(2024, 5, 2, 1)))
    sinks.upsert_by_date(other, path)
    got = sinks.read_by_date(spark, path)
    assert rows(got, "station_id", "pm25", "no2") == sorted([("a", 1.0, 2.0), ("a", 4.0, None), ("b", 9.0, None)], key=repr)
    assert {str(r[0]) for r in got.select("date").distinct().collect()} == {"2024-05-01", "2024-05-02"}
    assert got.filter("no2 = 2").first().dedup_key == "a|openaq|2024-05-01T10:00:00+00:00"


def test_readers_see_the_snapshot_before_or_after_an_upsert(spark, monkeypatch):
    path = scratch(spark, "sink")
    two_days = lambda *r: measurements(spark, *r).unionByName(measurements(spark, *r).withColumn("timestamp", F.lit(datetime(2024, 5, 2, 1))))
    seen = lambda: rows(sinks.read_by_date(spark, path), "date", "station_id", "pm25", "no2")
    sinks.upsert_by_date(two_days(("a", 1.0, None, None)), path, version=0)
    before = seen()
    with monkeypatch.context() as m:  # both dates are written, the manifest is not
        m.setattr(sinks, "write_state", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sinks.upsert_by_date(two_days(("a", 5.0, 2.0, None)), path, version=1)
    assert seen() == before == [("2024-05-01", "a", 1.0, None), ("2024-05-02", "a", 1.0, None)]
    for _ in range(2):  # the batch is repeated, then once more
        sinks.upsert_by_date(two_days(("a", 5.0, 2.0, None)), path, version=1)
        assert seen() == [("2024-05-01", "a", 5.0, 2.0), ("2024-05-02", "a", 5.0, 2.0)]
    for v in range(2, 8):
        sinks.upsert_by_date(measurements(spark, ("b", float(v), None, None)), path, version=v)
    assert ("2024-05-01", "b", 7.0, None) in seen() and ("2024-05-02", "a", 5.0, 2.0) in seen()
    assert len(sinks._versions(spark, f"{path}/rows")) <= sinks.KEPT_VERSIONS + 1
    nothing = sinks.read_by_date(spark, scratch(spark, "none"), sinks.keyed(measurements(spark, ("a", 1.0, None, None))).schema)
    assert nothing.count() == 0


def test_rows_without_a_time_are_kept(spark):
    path = scratch(spark, "sink")
    sinks.upsert_by_date(measurements(spark, ("a", 1.0, None, None)).withColumn("timestamp", F.lit(None).cast("timestamp")), path)
    sinks.upsert_by_date(measurements(spark, ("b", 2.0, None, None)), path)
    assert rows(sinks.read_by_date(spark, path), "date", "station_id") == [("2024-05-01", "b"), (None, "a")]


def test_state_latest_wins_and_missing_is_empty(spark):
    path = scratch(spark, "state")
    df = measurements(spark, ("a", 1.0, None, None), ("a", 2.0, None, None), ("b", 3.0, None, None))
    assert sinks.read_state(spark, path, "alerts", df.schema).count() == 0
    sinks.upsert_latest(df, path, "alerts", 0, ["ingested_at"])
    sinks.upsert_latest(measurements(spark, ("b", 8.0, None, None)).withColumn("ingested_at", F.lit(datetime(2025, 1, 1))), path, "alerts", 1, ["ingested_at"])
    for _ in range(2):
        assert rows(sinks.read_state(spark, path, "alerts", df.schema), "station_id", "pm25") == [("a", 2.0), ("b", 8.0)]
        sinks.upsert_latest(measurements(spark, ("b", 8.0, None, None)).withColumn("ingested_at", F.lit(datetime(2025, 1, 1))), path, "alerts", 1, ["ingested_at"])
    with pytest.raises(ValueError):
        sinks.read_state(spark, path, "other", df.schema)


def payload(spark, obj, **cols):
    return spark.createDataFrame([(json.dumps(obj), *cols.values())], ["payload", *cols])


def test_sensor_payloads(spark):
    locations = payload(spark, {"results": [{"id": 7, "coordinates": {"latitude": 1.5, "longitude": 2.5}, "sensors": [
        {"id": 1, "parameter": {"name": "pm25"}}, {"id": 2, "parameter": {"name": "o3"}}, {"id": 3, "parameter": {}}]}]})
    sensors = readers.sensor_map(locations)
    assert rows(sensors, "sensor_id", "parameter") == [(1, "pm25"), (2, "o3")]
    latest = payload(spark, {"results": [{"sensorsId": 1, "value": 9.0, "datetime": {"utc": "2024-05-01T10:00:00Z"}}, {"sensorsId": 2, "value": 3.0},
                                         {"sensorsId": 99, "value": 1.0}]}, location_id=7)
    assert rows(readers.latest_to_raw(latest, sensors), "station_id", "parameter", "value", "datetime_utc", "latitude") == [
        ("openaq-7", "o3", 3.0, None, 1.5), ("openaq-7", "pm25", 9.0, "2024-05-01T10:00:00Z", 1.5)]


def test_first_per_key_keeps_null_keys_equal(spark):
    df = spark.createDataFrame([(None, "t", 1), (None, "t", 2), (5, "t", 3)], "sensor_id long, datetime_utc string, seq int")
    assert rows(clean.first_per_key(df, ["sensor_id", "datetime_utc"], ["seq"]), "seq") == [(1,), (3,)]


def test_feature_collection_quality_gate(spark):
    props = {"clim_id-value": "615", "date_tm-value": "2024-05-01T10:00:00Z", "air_temp": 12.5, "rel_hum-value": "bad", "rel_hum": "55",
             "avg_wnd_spd_10m_pst1mt-value": "3", "avg_wnd_spd_10m_pst1mt-qa": "10", "avg_wnd_spd_10m_pst10mts": "4", "dwpt_temp-value": None, "dwpt_temp": "9"}
    df = payload(spark, {"features": [{"geometry": {"coordinates": [-79.5, 43.5, 100.0]}, "properties": props}, {"geometry": None, "properties": {}}]})
    out = {r.station_id: r for r in readers.collection_to_raw(df, min_qa=50).collect()}
    r = out["swob-615"]
    assert (r.latitude, r.longitude, r.air_temp, r.wind_speed, r.rel_hum, r.dew_point) == (43.5, -79.5, 12.5, 4.0, None, None)
    assert out["swob-None"].latitude is None
    assert readers.collection_to_raw(df).filter("station_id = 'swob-615'").first().wind_speed == 3.0


def test_parallel_arrays_are_padded(spark):
    df = payload(spark, {"hourly": {"time": ["2024-05-01T10:00", "2024-05-01T11:00"], "temperature_2m": [1.0], "windspeed_10m": [2.0, 3.0]}}, met_id="m", lat=1.0, lon=2.0)
    got = readers.arrays_to_hours(df).orderBy("hour").collect()
    assert [(r.temperature, r.wind_speed, r.humidity) for r in got] == [(1.0, 2.0, None), (None, 3.0, None)]
    assert readers.arrays_to_hours(payload(spark, {"hourly": {"time": []}}, met_id="m", lat=1.0, lon=2.0)).count() == 0


def test_archive_prunes_and_drops_bad_rows(spark):
    root = scratch(spark, "archive")
    df = spark.createDataFrame([("2024-05-01T10:00:00Z", "pm25", "5", 1, 2024, 5), ("2024-04-30T10:00:00Z", "pm25", "6", 1, 2024, 4),
                                ("2024-05-02T10:00:00Z", "pm25", "x", 1, 2024, 5), ("2024-05-02T10:00:00Z", "pm25", "7", 2, 2024, 5)],
                               "datetime string, parameter string, value string, locationid int, year int, month int")
    df.write.partitionBy("locationid", "year", "month").option("compression", "gzip").csv(root, header=True)
    out = readers.read_archive(spark, root, 1, "2024-05-01")
    assert rows(out, "value") == [(5.0,)]
    assert "PartitionFilters: [" in out._jdf.queryExecution().toString() and "locationid" in out._jdf.queryExecution().toString()


def test_codec_round_trip_and_bad_messages(spark):
    df = measurements(spark, ("a", 1.0, None, 2.0))
    good, bad = readers.decode(readers.encode(df).unionByName(spark.createDataFrame([("k", "{broken")], "key string, value string")), df.schema, "t")
    assert rows(good) == rows(df) and base64.b64decode(bad.first().value_b64) == b"{broken"


def test_keep_columns_and_aliases(spark):
    df = spark.createDataFrame([(1.0, "x", 3.0)], ["precip. amount definition MM", "junk", "PM25"])
    out = clean.keep_columns(clean.alias_headers(df))
    assert tuple(out.columns) == clean.KEEP_COLUMNS
    r = out.first()
    assert (r["Precip. Amount Definition mm"], r["pm2"], r["o3"]) == (1.0, 3.0, None)


def test_hourly_table_needs_a_timestamp(spark):
    with pytest.raises(ValueError):
        clean.hourly_table(spark.range(1))
    r = clean.hourly_table(spark.createDataFrame([("2024-05-01 10:20:00", "7", "x")], "timestamp string, pm2 string, o3 string")).first()
    assert (r.timestamp, r.pm2, r.o3) == (HOUR, 7.0, None)


def test_slice_is_half_open_and_ordered(spark):
    df = spark.createDataFrame([(datetime(2024, 5, d),) for d in (3, 1, 2)], "timestamp timestamp")
    assert [r[0].day for r in readers.replay(df, "timestamp", "2024-05-01", "2024-05-03").collect()] == [1, 2]


def test_latest_by_station_keeps_both_sides(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "station_id string, p double")
    a = spark.createDataFrame([("b", "warning"), ("c", "normal")], "station_id string, level string")
    assert rows(joins.latest_by_station(p, a), "station_id", "p", "level") == [("a", 1.0, None), ("b", 2.0, "warning"), ("c", None, "normal")]


def test_feature_map_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert df.select(clean.feature_map(["a", "b"]).alias("f")).first().f == {"a": 1.0}


def test_model_features_default_to_zero(spark):
    df = spark.createDataFrame([(10.0, 90.0, None)], "wind_speed double, wind_dir double, pm25 double")
    r = df.select(*[c.alias(n) for n, c in clean.model_features(df).items()]).first()
    assert r["wind_u"] == pytest.approx(0.0, abs=1e-9) and r["wind_v"] == pytest.approx(10.0)
    assert r["pm25"] == 0.0 and r["temp definition °c"] == 0.0


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert rows(clean.finite_only(df, ["v"])) == [(1.0,)] and scalar.number is not None


def test_old_versions_of_a_state_are_deleted(spark, tmp_path):
    schema = "station_id string, timestamp timestamp, event_id long, v int"
    for version in range(12):
        batch = spark.createDataFrame([("a", datetime(2024, 1, 1, version), version, version)], schema)
        sinks.upsert_latest(batch, str(tmp_path), "measurements", version)
    kept = sorted(p.name for p in (tmp_path / "measurements").iterdir())
    assert kept == [f"v={v:09d}" for v in (9, 10, 11)]
    assert rows(sinks.read_state(spark, str(tmp_path), "measurements", batch.schema), "v") == [(11,)]


def test_schemas_are_checked_and_resolved(spark):
    from pyspark.sql import types as T
    ddl = T.StructType.fromDDL
    old = ddl("id int, name string, at struct<lat: float, gone: int>, tags array<int>, score float")
    new = ddl("id bigint, at struct<lat: double, lon: double>, tags array<bigint>, score double, kind string")
    defaults = {"kind": "plain", "at.lon": 0.5}
    assert readers.incompatibilities(old, new, defaults) == []
    assert readers.incompatibilities(new, old) == ["id: bigint cannot be read as int", "at.lat: double cannot be read as float", "tags[]: bigint cannot be read as int", "score: double cannot be read as float"]
    must = T.StructType([T.StructField("id", T.LongType()), T.StructField("must", T.StringType(), False)])
    assert readers.incompatibilities(old, must) == ["must: added without a default"] and readers.incompatibilities(old, must, {"must": "x"}) == []
    with pytest.raises(ValueError, match="schema 1, id: bigint cannot be read as int"):
        readers.decode_versions(spark.createDataFrame([], "value string, schema int"), {1: new}, old, "t")
    rows_ = [('{"id": 1, "name": "a", "at": {"lat": 1.5, "gone": 3}, "tags": [1, 2], "score": 2.5}', 1, 10), ('{"id": 5000000000, "at": null, "tags": null, "score": 1.0, "kind": "k"}', 2, 11),
             ('{"id": ', 1, 12), ('{"id": 1}', 7, 13), (None, 1, 14), ('{"id": 2}', None, 15)]
    good, bad = readers.decode_versions(spark.createDataFrame(rows_, "value string, schema int, offset long"), {1: old, 2: new}, new, "t", defaults)
    got = sorted((tuple(r) for r in good.collect()), key=lambda r: r[0])
    assert good.schema.simpleString() == new.simpleString()
    assert got == [(1, (1.5, 0.5), [1, 2], 2.5, "plain"), (5_000_000_000, None, None, 1.0, "k")]
    assert sorted((r["offset"], r["error"]) for r in bad.collect()) == [(12, "message does not match the schema"), (13, "unknown schema"), (14, "message does not match the schema"), (15, "unknown schema")]
