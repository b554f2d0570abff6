"""Stateful flows: results against batch, state held and written, late rows, restart after a stop."""

import random
import time
from datetime import datetime, timedelta

import pytest

from gustline.streaming import state

BASE = datetime(2024, 1, 1)
READING = "station_id string, source string, ts timestamp, event_id long, ingested_at timestamp, pm25 double"


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def append(spark, rows, schema, path, files=1):
    for i in range(files):
        spark.createDataFrame(rows[i::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path, **options):
    return spark.readStream.schema(schema).options(**options).parquet(path)


def readings(n, hours, seed=1, stations=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = BASE + timedelta(seconds=rng.randrange(hours * 3600))
        out.append((f"s{rng.randrange(stations)}", "x", ts, i, ts, None if i % 5 == 0 else float(i)))
    return out


def collapsed(rows, closed):
    hours = {}
    for s, source, ts, i, _, v in rows:
        hour = ts.replace(minute=0, second=0)
        if hour + timedelta(hours=1) <= closed:
            n, best = hours.get((s, source, hour), (0, None))
            if v is not None and (best is None or (ts, i) > best[:2]):
                best = (ts, i, v)
            hours[s, source, hour] = (n + 1, best)
    return {k: (n, best and best[2]) for k, (n, best) in hours.items()}


def hours_of(spark, out):
    found = spark.read.parquet(out).collect()
    got = {(r["station_id"], r["source"], r["timestamp"]): (r["n"], r["pm25"]) for r in found}
    assert len(got) == len(found)
    return got


def test_closed_hours_late_rows_and_bounded_state(spark, folder):
    rows = readings(600, 48)
    early, late = [r for r in rows if r[2] < BASE + timedelta(hours=24)], [r for r in rows if r[2] >= BASE + timedelta(hours=24)]
    flow = lambda: state.closed_hours(state.believable(stream(spark, READING, folder("in"))), ["pm25"])
    ahead = ("s0", "x", BASE + timedelta(days=900), 10_000, BASE, 1.0)  # must not move the watermark
    append(spark, [*early, ahead], READING, folder("in"))
    first = state.drain(flow(), folder("cp"), folder("out"))
    assert hours_of(spark, folder("out")) == collapsed(early, max(r[2] for r in early) - timedelta(hours=2))
    assert first[-1].held <= 3 * 4  # three stations, hours not yet closed
    behind = ("s0", "x", BASE + timedelta(hours=2), 10_001, BASE + timedelta(hours=2), 5.0)
    append(spark, [*late, behind], READING, folder("in"))
    second = state.drain(flow(), folder("cp"), folder("out"))
    assert hours_of(spark, folder("out")) == collapsed(rows, max(r[2] for r in rows) - timedelta(hours=2))
    assert sum(p.dropped for p in second) == 1 and second[-1].held <= 3 * 4


def test_a_stopped_query_goes_on_where_it_was(spark, folder):
    rows = sorted(readings(300, 30, seed=2), key=lambda r: r[2])
    for i in range(0, 300, 50):
        append(spark, rows[i : i + 50], READING, folder("in"))
        time.sleep(0.01)
    flow = lambda: state.closed_hours(stream(spark, READING, folder("in"), maxFilesPerTrigger=1), ["pm25"])
    running = flow().writeStream.option("checkpointLocation", folder("cp")).option("path", folder("out")).format("parquet").trigger(processingTime="0 seconds").start()
    until = time.time() + 60
    while not (running.lastProgress and running.lastProgress["batchId"] >= 1) and time.time() < until:
        time.sleep(0.05)
    running.stop()
    state.drain(flow(), folder("cp"), folder("out"))
    assert hours_of(spark, folder("out")) == collapsed(rows, max(r[2] for r in rows) - timedelta(hours=2))


RECORD = "station_id string, timestamp timestamp, pm25 double"


def test_histories_write_only_touched_stations(spark, folder):
    many = [(f"s{i}", BASE + timedelta(hours=h), float(100 * i + h)) for i in range(300) for h in range(3)]
    flow = lambda: state.histories(stream(spark, RECORD, folder("in")), length=4)
    append(spark, many, RECORD, folder("in"))
    first = state.drain(flow(), folder("cp"), folder("out"))
    assert first[-1].held == 300
    append(spark, [("s7", BASE + timedelta(hours=h), float(700 + h)) for h in (4, 3)] + [(None, BASE, None)], RECORD, folder("in"))
    second = state.drain(flow(), folder("cp"), folder("out"))
    assert sum(p.written for p in second) == 2 and second[-1].held == 301
    got = {(r["station_id"], r["timestamp"]): list(r["history"]) for r in spark.read.parquet(folder("out")).collect()}
    assert got["s7", BASE + timedelta(hours=4)] == [701.0, 702.0, 703.0, 704.0]
    assert got["s7", BASE + timedelta(hours=3)] == [700.0, 701.0, 702.0, 703.0]
    assert got["s9", BASE + timedelta(hours=1)] == [900.0, 901.0] and len(got) == 903


def test_first_deliveries_with_null_keys(spark, folder):
    schema = "k string, qa int, ts timestamp, v int"
    at = lambda m: BASE + timedelta(minutes=m)
    flow = lambda: state.first_deliveries(stream(spark, schema, folder("in")), ["k", "qa"])
    append(spark, [("a", None, at(0), 1), ("a", 1, at(1), 2), ("b", None, at(2), 3), (None, None, at(3), 4)], schema, folder("in"))
    state.drain(flow(), folder("cp"), folder("out"))
    append(spark, [("a", None, at(10), 5), (None, None, at(11), 6), ("a", 2, at(12), 7), ("c", None, at(600), 8)], schema, folder("in"))
    state.drain(flow(), folder("cp"), folder("out"))
    append(spark, [("a", 1, at(605), 9)], schema, folder("in"))
    last = state.drain(flow(), folder("cp"), folder("out"))
    assert sorted(r["v"] for r in spark.read.parquet(folder("out")).collect()) == [1, 2, 3, 4, 7, 8, 9]
    assert last[-1].held == 2  # the rest is behind the watermark and forgotten


def test_as_of_does_not_depend_on_the_order_of_arrival(spark, folder):
    rng = random.Random(11)
    minute = lambda: BASE + timedelta(minutes=rng.randrange(2000))
    ticks = {(rng.choice("ab"), minute()) for _ in range(120)}
    reports = {(rng.choice("ab"), minute(), rng.randrange(3)): float(rng.randrange(1000)) for _ in range(60)}
    rows = [(k, t, None, None) for k, t in ticks] + [(k, t, r, v) for (k, t, r), v in reports.items()]
    want = {}
    closed = max(t for _, t, *_ in rows) - timedelta(hours=2)
    for k, t in ticks:
        past = [(r, at, v) for (key, at, r), v in reports.items() if key == k and at <= t]
        if past and t <= closed:
            rank = min(r for r, _, _ in past)
            want[k, t] = max((at, v) for r, at, v in past if r == rank)
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(115)))
    schema = "station_id string, timestamp timestamp, rank int, v double"
    for i in range(0, len(rows), 45):
        append(spark, rows[i : i + 45], schema, folder("in"))

        def flow():
            s = stream(spark, schema, folder("in"))
            return state.as_of(s.filter("rank IS NULL"), s.filter("rank IS NOT NULL"), ["v"])
        done = state.drain(flow(), folder("cp"), folder("out"))
    found = spark.read.parquet(folder("out")).collect()
    assert {(r["station_id"], r["timestamp"]): (r["report_at"], r["v"]) for r in found} == want and len(found) == len(want)
    assert sum(p.dropped for p in done) == 0
