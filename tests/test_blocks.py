"""Scans and paths over blocks, against plain loops; blocks are small here, so that states cross many of them."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemill import scratch
from tidemill.operators import backtest, events, order, running, signatures

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("block", "most"), [(7, 4096), (1, 4096), (1000, 4096), (1, 9)])
def test_running_median_against_plain_medians(spark, monkeypatch, block, most):
    monkeypatch.setattr(running, "MOST", most)
    rng = random.Random(block)
    series = {
        "few": [rng.choice([1.0, 2.0, None, 2.5]) for _ in range(60)],
        "up": [float(i) for i in range(80)],
        "down": [float(-i) for i in range(70)],
        "mixed": [rng.choice([None, float("nan"), rng.gauss(0, 1), 0.0]) for _ in range(90)],
        "none": [None] * 12,
    }
    rows = [(a, i, x) for a, own in series.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "asset string, i long, v double").repartition(4)
    got = {(r.asset, r.i): r.m for r in running.expanding_median(df, "v", "m", block).collect()}
    assert len(got) == len(rows)
    for a, i, _ in rows:
        own = [v for v in series[a][: i + 1] if v is not None and v == v]
        assert got[a, i] == (pytest.approx(float(np.median(own))) if own else None), (a, i)


def test_running_median_of_an_empty_series(spark):
    assert running.expanding_median(spark.createDataFrame([], "asset string, i long, v double"), "v", "m").collect() == []


@pytest.mark.parametrize("block", [1, 4, 16, 65_536])
@pytest.mark.parametrize("cooldown", [0, 6])
def test_acceptance_over_blocks_against_a_loop(spark, block, cooldown):
    rng = np.random.default_rng(block)
    rows, expected = [], set()
    for asset in ("A", "B"):
        free, last = None, -100
        for i in map(int, np.flatnonzero(rng.random(200) < 0.4)):
            s, e = T0 + dt.timedelta(minutes=5 * i), T0 + dt.timedelta(minutes=5 * i + int(rng.integers(0, 6)))
            x = e + dt.timedelta(minutes=int(rng.choice([0, 3, 20, 300])))
            rows.append((asset, s, e, x, i))
            if (free is None or (s >= free and e > free)) and i - last >= cooldown:
                expected.add((asset, i))
                free, last = x, i
    found = spark.createDataFrame(rows, "asset string, signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, bar long").repartition(3)
    assert {(r.asset, r.bar) for r in backtest.accepted(found, cooldown, block=block).collect()} == expected
    assert backtest.accepted(found.limit(0), cooldown, block=block).collect() == []


@pytest.mark.parametrize("mode", ["exclude", "bridge", "reset"])
@pytest.mark.parametrize("block", [3, 40, 65_536])
def test_events_over_blocks_against_one_scan(spark, monkeypatch, mode, block):
    rng = random.Random(block)
    price, rows = 100.0, []
    for i in range(300):
        price *= 1 + rng.gauss(0, 0.01 if i < 150 or i > 240 else 0.0001)
        rows.append(("A", "s", i, T0 + dt.timedelta(minutes=i), price, rng.choice([None, 0.02, 0.03]), 0.4 + i / 1000, rng.random() < 0.1, 0.025, 5))
    df = spark.createDataFrame(rows, "asset string, scale string, i long, ts timestamp_ntz, close double, theta_dynamic double, hurst double, sampler_gap boolean, base double, first long")
    monkeypatch.setattr(events, "metrics", lambda *a: df)
    gaps = events.Gaps(mode)
    scan, expected = events.Scan(gaps, 0.025), []
    for _, _, i, ts, close, theta, hurst, gap, _, first in rows:
        if i >= first and (e := scan.step(close, i, ts, hurst, theta, gap)):
            expected.append((*e, gap))
    own = events.directional_changes(df, [], gaps, block=block)
    found = sorted(tuple(r)[2:] for r in own.collect())
    assert len(found) > 10 and found == sorted(expected)
    assert own.columns == ["asset", "scale", "ts", "price", "type", "theta_dynamic", "hurst_snapshot", "is_gap_event"]


def test_running_greatest(spark):
    rng = random.Random(1)
    rows = [(a, T0 + dt.timedelta(hours=7 * i), rng.random()) for a in "xy" for i in range(40)]
    got = order.running_max(spark.createDataFrame(rows, "asset string, ts timestamp_ntz, v double"), order.F.col("v"), "m").collect()
    for r in got:
        assert r.m == max(v for a, ts, v in rows if a == r.asset and ts <= r.ts)


@pytest.mark.parametrize("lengths", [(2,), (7,), (3, 5, 10, 12), (1, 4), (40,)])
def test_window_signatures_from_shared_products(lengths):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(25, 2)).cumsum(axis=0)
    points[4:8] = points[4]
    for depth in (2, 3):
        found = signatures.window_log_signatures(points, lengths, depth)
        for length, rows in found.items():
            assert len(rows) == max(0, len(points) - length + 1)
            for start, row in enumerate(rows):
                x = points[start : start + length]
                x = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0) + 1e-8)
                k = np.arange(2 * length - 1)
                path = np.concatenate([x[k // 2], x[(k + 1) // 2]], axis=1)
                expected = signatures.log_signature(path[None], depth)[0] if length > 1 else np.zeros(len(row))
                assert np.allclose(row, expected, atol=1e-9)


def test_windows_of_all_lengths_over_blocks(spark):
    rng = random.Random(4)
    rows = [("A", s, i, T0 + dt.timedelta(minutes=i), rng.random(), rng.random(), rng.random(), rng.random()) for s, n in (("a", 30), ("b", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, scale string, i long, ts timestamp_ntz, p double, sigma double, h double, u double")
    got = signatures.signature_windows(df, (3, 6), 2, stride=2, batch=5).collect()
    assert sorted((r.scale, r.length, r.start_idx) for r in got) == sorted((s, n, i) for s, size in (("a", 30), ("b", 4)) for n in (3, 6) for i in range(0, size - n + 1, 2))
    for r in got:
        assert r.end_idx == r.start_idx + r.length - 1 and r.end_ts == T0 + dt.timedelta(minutes=r.end_idx)
        x = np.array([row[4:] for row in rows if row[1] == r.scale][r.start_idx : r.end_idx + 1])
        assert np.allclose(r.signature, signatures.window_log_signatures(x, (r.length,), 2)[r.length][0])


def test_prepared_tables_meet_without_an_exchange(spark):
    rows = [(a, T0 + dt.timedelta(minutes=i), float(i)) for a in ("A", "B", None) for i in range(50)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, v double")
    one, two = scratch.prepared(df), scratch.prepared(df.withColumnRenamed("v", "w").where("w < 30"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = one.join(two, ["asset", "ts"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted((r.asset, r.v, r.w) for r in both.collect()) == sorted((a, v, v) for a, _, v in rows if a and v < 30)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
