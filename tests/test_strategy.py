import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest, events, folds, joins, ou, regression, signatures, spread
from tidemill.streaming import live

T0 = dt.datetime(2024, 1, 1)


def minutes(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), *map(float, x)) for m, x in rows], "asset string, ts timestamp_ntz, open double, high double, low double, close double")


def features(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(minutes=5 * i), i, s, 0.001, z, "ranging") for i, s, z in rows], "asset string, ts timestamp_ntz, i long, signal int, sigma_hat double, z_score double, regime string")


def test_exits_and_their_priority(spark):
    quiet = (1000, 1000.1, 999.9, 1000)
    bars = [(m, quiet) for m in range(0, 60)]
    bars[7] = (7, (1000, 1002, 998, 1000))  # both stop and target: the stop wins
    found = {r.bar: r for r in backtest.candidates(features(spark, [(0, 1, -2.0), (1, -1, 2.0), (2, 0, 0.0), (3, 1, -2.0), (10, 1, -2.0), (40, 1, 0.0)]), minutes(spark, bars), flat=0.1, h=4, z_exit=None).collect()}
    assert sorted(found) == [0, 1, 3, 10]  # bar 40 has no entry minute
    assert found[0].exit_reason == "stop_loss" and found[0].exit_time == T0 + dt.timedelta(minutes=7)
    assert found[0].entry_price == pytest.approx(1000.05) and found[0].exit_price == pytest.approx(1000.05 * 0.999 - 0.05)
    assert found[1].exit_reason == "time_stop" and found[1].exit_time == T0 + dt.timedelta(minutes=25)
    assert found[10].exit_reason == "end_of_data" and found[10].exit_time == T0 + dt.timedelta(minutes=59)
    reverted = backtest.candidates(features(spark, [(1, 1, -2.0), (3, 0, 0.5)]), minutes(spark, bars), flat=0.1, h=4, z_exit=0.0).first()
    assert reverted.exit_reason == "z_revert" and reverted.exit_time == T0 + dt.timedelta(minutes=15)
    wide = backtest.candidates(features(spark, [(1, 1, -2.0)]), minutes(spark, bars), flat=5.0, h=4).first()
    assert wide.entry_price - wide.stop_price == pytest.approx(10.0)


def test_acceptance_against_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [("A", T0 + dt.timedelta(minutes=5 * i), T0 + dt.timedelta(minutes=5 * i + 5), T0 + dt.timedelta(minutes=5 * i + 5 + int(rng.integers(1, 60))), int(i)) for i in map(int, np.flatnonzero(rng.random(300) < 0.3))]
    found = spark.createDataFrame(rows, "asset string, signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, bar long")
    kept, free, last = [], None, -100
    for _, s, e, x, i in rows:
        if (free is None or (s >= free and e > free)) and i - last >= 6:
            kept.append(i)
            free, last = x, i
    assert sorted(r.bar for r in backtest.accepted(found, 6).collect()) == kept


def test_metrics(spark):
    trades = spark.createDataFrame([("A", T0 + dt.timedelta(hours=20 * i), T0 + dt.timedelta(hours=20 * i + 1), p, "time_stop" if p > 0 else "stop_loss", 60.0, 0.1) for i, p in enumerate([1.0, -2.0, 3.0, -0.5])], "asset string, signal_time timestamp_ntz, exit_time timestamp_ntz, pnl_usd double, exit_reason string, duration_min double, spread_usd double")
    m = backtest.metrics(trades).first()
    assert (m.total_trades, m.win_rate, m.total_pnl_usd, m.profit_factor, m.max_drawdown_usd) == (4, 0.5, 1.5, pytest.approx(1.6), -2.0)
    daily = [-1.0, 3.0, -0.5]
    assert m.daily_sharpe == pytest.approx(np.mean(daily) / np.std(daily, ddof=1) * math.sqrt(252))
    assert backtest.reasons_map(trades).first().exit_reasons == {"stop_loss": 2, "time_stop": 2}


def scan(prices, thetas=None, gaps=(), mode="exclude", theta=0.1):
    state = events.Scan(events.Gaps(mode), theta)
    found = [state.step(float(p), i, i, 0.5, (thetas or [theta] * len(prices))[i], i in gaps) for i, p in enumerate(prices)]
    return [(f[0], f[1], f[2]) for f in found if f]


def test_directional_change_scan():
    assert scan([100, 105, 111, 123, 124, 110, 98]) == [(2, 111.0, "upturn"), (3, 123.0, "upturn"), (5, 110.0, "downturn"), (6, 98.0, "downturn")]
    assert scan([100, 120, 108, 130], gaps={2}, mode="reset") == [(1, 120.0, "upturn"), (3, 130.0, "upturn")]
    assert scan([100, 112, 125], gaps={2}, mode="bridge", theta=0.11) == [(1, 112.0, "upturn")]  # leap of 11.6 %: starts anew
    assert scan([100, 112, 121], gaps={2}, mode="bridge", theta=0.06) == [(1, 112.0, "upturn")]  # 8 % is under 1.5 x 6 %
    assert scan([100, 95, 89, 100]) == [(2, 89.0, "downturn"), (3, 100.0, "upturn")]
    assert scan([100, 111], thetas=[None, 0.0]) == [(1, 111.0, "upturn")]


def test_lyndon_words_and_log_signatures():
    assert [sum(len(w) == k for w in signatures.lyndon(8, 4)) for k in (1, 2, 3, 4)] == [8, 28, 168, 1008]
    assert all(w < w[i:] + w[:i] for w in signatures.lyndon(3, 4) for i in range(1, len(w)))
    rng = np.random.default_rng(1)
    path = rng.normal(size=(2, 6, 3)).cumsum(axis=1)
    sig = signatures.log_signature(path, 3)
    assert np.allclose(sig[:, :3], path[:, -1] - path[:, 0])
    x, dx = path[:, :-1] - path[:, :1], np.diff(path, axis=1)
    areas = [0.5 * (x[:, :, a] * dx[:, :, b] - x[:, :, b] * dx[:, :, a]).sum(axis=1) for a, b in itertools.combinations(range(3), 2)]
    assert np.allclose(sig[:, 3:6], np.stack(areas, axis=1))
    assert np.allclose(signatures.log_signature(path[:, ::-1], 3), -sig)  # reversal
    doubled = np.repeat(path, 2, axis=1)
    assert np.allclose(signatures.log_signature(doubled, 3), sig)  # standing still adds nothing
    line = np.linspace(0, 1, 5)[None, :, None] * np.array([1.0, 2.0, 3.0])
    assert np.allclose(signatures.log_signature(line, 3)[:, 3:], 0)


def test_windows_lead_lag_and_signatures(spark):
    rows = [("A", "s", i, T0 + dt.timedelta(minutes=i * i), 100.0 + i % 4, 0.002 + 0.0001 * i, 0.4 + 0.01 * i) for i in range(12)]
    found = spark.createDataFrame(rows, "asset string, scale string, i long, ts timestamp_ntz, price double, theta_dynamic double, hurst_snapshot double")
    states = signatures.state_channels(found)
    first = states.orderBy("i").first()
    assert first.p == 0.0 and first.u == pytest.approx(math.log(1 + 1e-6), abs=1e-6)
    cut = signatures.windows(states, 5, 2)
    assert [(r.start_idx, r.end_idx) for r in cut.orderBy("start_idx").collect()] == [(0, 4), (2, 6), (4, 8), (6, 10)]
    paths = signatures.lead_lag(signatures.min_max(cut))
    path = np.array(paths.orderBy("start_idx").first().path)
    assert path.shape == (9, 8) and np.allclose(path[0, :4], path[0, 4:]) and np.allclose(path[1, :4], path[0, :4]) and np.allclose(path[1, 4:], path[2, :4])
    full = {r.start_idx: r.signature for r in signatures.log_signatures(states, 5, 2, 2).collect()}
    two = {r.start_idx: list(r)[3:] for r in signatures.level_two(paths).collect()}
    assert full.keys() == two.keys()
    assert all(np.allclose(full[k], two[k], atol=1e-5) for k in two)
    assert signatures.invalid(signatures.log_signatures(states, 5, 2), 2).count() == 0


def test_spread_of_simulated_ticks(spark):
    rng = np.random.default_rng(3)
    rows, price = [], 100.0
    for i in range(1500):
        steps = price * np.exp(np.cumsum(rng.normal(0, 0.0005, 60)))
        price = steps[-1]
        seen = steps * (1 + 0.005 * rng.choice([-1, 1], 60))
        rows.append(("A", i, T0 + dt.timedelta(minutes=i), seen[0], seen.max(), seen.min(), seen[-1]))
    bars = spark.createDataFrame([(a, i, t, *map(float, x)) for a, i, t, *x in rows], "asset string, i long, ts timestamp_ntz, open double, high double, low double, close double")
    assert spread.edge(bars, 1400).where("spread is not null").agg(F.avg("spread")).first()[0] == pytest.approx(0.01, rel=0.1)


def test_kernel_search_reaches_a_grid(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.001, 900)
    y = 0.001 + 0.4 * folds.filtered(r, 1.5, 3.0, 40) + 0.6 * np.sqrt(np.maximum(folds.filtered(r**2, 0.8, 10.0, 40), 0))
    assert np.allclose(folds.filtered(r, 1.2, 2.0, 40), np.convolve(r, np.r_[0.0, folds.weights(1.2, 2.0, 40)])[: len(r)])
    best = folds.search(r, y, 40, seed=1, rounds=12)[2]
    grid = max(folds.solve(folds.design(r, np.array(p, float), 40)[40:], y[40:])[1] for p in itertools.product((0.5, 1.5, 3), (1, 3, 30), (0.5, 0.8, 2), (1, 10, 100)))
    assert best >= grid - 1e-3


def test_plane_against_numpy(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 2 * x1 - 3 * x2 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "g int, a double, b double, y double")
    got = regression.plane(df, ["g"], "y", "a", "b").first()
    beta, r2 = folds.solve(np.column_stack([np.ones(80), x1, x2]), y)
    assert (got.b0, got.b1, got.b2, got.in_r2) == pytest.approx((*beta, r2)) and got.b1_sign == 1


def test_as_of_and_waits(spark):
    left = spark.createDataFrame([("A", T0 + dt.timedelta(hours=h), h) for h in (0, 5, 30, 80)], "asset string, ts timestamp_ntz, h int")
    right = spark.createDataFrame([("A", T0 + dt.timedelta(hours=h), v) for h, v in ((5, 1.0), (29, None), (50, 2.0))], "asset string, ts timestamp_ntz, v double")
    assert {r.h: r.v for r in joins.as_of(left, right, "v", default=-1.0).collect()} == {0: -1.0, 5: 1.0, 30: 1.0, 80: 2.0}
    plan = spark.createDataFrame([("m", "a", 3), ("m", "a", 7), ("n", "b", 9)], "Model string, Transition string, Wait int")
    own = spark.createDataFrame([("a",), ("b",)], "transition string")
    assert {r.transition: r.wait for r in joins.waits(plan, "m", own).collect()} == {"a": 7, "b": 5}


def test_short_segments(spark):
    regimes = "eee" + "r" + "ee" + "rrr" + "e" + "rrrrrr" + "eeee"
    prices = [100, 101, 100, 102, 101, 100, 103, 101, 102, 100, 104, 102, 103, 102.5, 102.8, 102.6, 100, 101, 99, 102]
    rows = [("A", i, T0 + dt.timedelta(minutes=5 * i), {"e": "expansion", "r": "ranging"}[g], float(p)) for i, (g, p) in enumerate(zip(regimes, prices, strict=True))]
    df = spark.createDataFrame(rows, "asset string, i long, ts timestamp_ntz, regime string, close double")
    found = {r.run: r for r in ou.segment_speeds(df).collect()}
    assert {k: r.n_prices for k, r in found.items()} == {3: 1, 4: 2, 6: 3, 9: 1, 10: 6, 16: 4}
    p = np.array(prices[10:16])
    assert found[10].slope == pytest.approx(np.polyfit(p[:-1], p[1:], 1)[0]) and all(found[k].theta is None for k in (3, 4, 6, 9, 16))


def test_streams_give_what_batches_give(spark, tmp_path):
    rng = np.random.default_rng(4)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, 400)))
    rows = [("A", T0 + dt.timedelta(minutes=i), i, float(p)) for i, p in enumerate(price)]
    schema = "asset string, ts timestamp, event_id long, price double"
    batch = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.bars(stream).writeStream.format("memory").queryName("live_bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    from tidemill.operators.bars import resample

    expected = {r.ts: r.close for r in resample(batch).collect()}
    got = {r.ts: r.close for r in spark.table("live_bars").collect()}
    assert len(got) >= len(expected) - 4 and all(expected[k] == v for k, v in got.items())
    marked = stream.select("asset", "ts", F.col("price").alias("close"), F.lit(0.01).alias("theta_dynamic"), F.lit(False).alias("is_gap"))
    live.directional_changes(marked, 0.01).writeStream.format("memory").queryName("live_events").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    whole = scan(price, theta=0.01)
    assert [(r.price, r.type) for r in spark.table("live_events").orderBy("ts").collect()] == [(p, k) for _, p, k in whole]
