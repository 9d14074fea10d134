import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemill.operators import bars, order, regime, rolling
from tidemill.sources import ticks as sources

T0 = dt.datetime(2023, 1, 6, 16, 50)


@pytest.fixture(scope="module")
def weekend(spark):
    friday = [("A", T0 + dt.timedelta(minutes=i), 1800.0, 1801.0, 1799.0, 1800.5) for i in range(6)]
    sunday = [("A", dt.datetime(2023, 1, 8, 18) + dt.timedelta(minutes=i), 1820.0, 1821.0, 1819.0, 1820.5) for i in range(11)]
    return spark.createDataFrame(friday + sunday, "asset string, ts timestamp_ntz, open double, high double, low double, close double")


def series(spark, values, name="gk_var"):
    return spark.createDataFrame([("A", i, T0 + dt.timedelta(minutes=5 * i), float(v) if v is not None else None) for i, v in enumerate(values)], f"asset string, i long, ts timestamp_ntz, {name} double")


def test_gap_returns_and_variance(weekend):
    rows = {r.ts: r for r in bars.enriched(bars.resample_bars(weekend)).collect()}
    assert all(r.gk_var >= 0 and r["return"] is not None for r in rows.values())
    sunday = rows[dt.datetime(2023, 1, 8, 18)]
    assert sunday.is_gap and sunday.return_c2c_raw == pytest.approx(math.log(1820.5 / 1800.5)) and sunday["return"] == pytest.approx(math.log(1820.5 / 1820.0))
    assert [r.i for r in sorted(rows.values(), key=lambda r: r.ts)] == list(range(len(rows)))


@pytest.mark.parametrize("alpha", [0.5, 1.0, 1.8])
@pytest.mark.parametrize("delta", [0.1, 1.0, 10.0])
def test_power_law_weights(spark, alpha, delta):
    for n in (50, 500):
        own = spark.range(1).select(rolling.power_law(alpha, delta, n)).first()[0]
        assert sum(own) == pytest.approx(1) and min(own) > 0 and own[0] > own[-1]
        assert own == pytest.approx(rolling.weights(alpha, delta, n))


def test_kernels_leave_the_present_out(spark):
    r = [0.01, -0.02, 0.015, -0.005, 0.03, 0.01, -0.01]
    one, two = ([(x.r1, x.r2) for x in rolling.kernel_features(series(spark, v, "return"), 1, 1, 1, 1, 10).orderBy("i").collect()] for v in (r, [*r[:4], 999.0, *r[5:]]))
    assert one[0] == (0.0, 0.0) and one[:5] == two[:5] and one[5] != two[5]


def test_golden_volatilities(spark):
    rows = rolling.with_rolling(series(spark, [1, 4, 9, 16, 25]), 2, 2, **rolling.realized(2)).orderBy("i").collect()
    assert [r.rv_fwd for r in rows] == [pytest.approx(math.sqrt(13)), 5, pytest.approx(math.sqrt(41)), None, None]
    assert [r.rv_trail for r in rows] == [None, pytest.approx(math.sqrt(5)), pytest.approx(math.sqrt(13)), 5, pytest.approx(math.sqrt(41))]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_do_not_change_results(spark, monkeypatch, block):
    values = series(spark, [math.sin(i) * i for i in range(40)])
    w = rolling.frame(-4, 2)
    own = order.unblocked(order.blocked(values, 4, 2, block=max(block, 4)).select("*", F.sum("gk_var").over(w).alias("s")))
    found = [r.s for r in own.orderBy("i").collect()]
    v = [math.sin(i) * i for i in range(40)]
    assert found == pytest.approx([sum(v[max(0, i - 4) : i + 3]) for i in range(40)])
    sparse = values.withColumn("x", F.when(F.col("i") % 9 == 4, F.col("gk_var")))
    carried = [r.c for r in order.carried(sparse, F.col("x"), "c", block=block).orderBy("i").collect()]
    assert carried == [v[(i - 4) // 9 * 9 + 4] if i >= 4 else None for i in range(40)]


def test_running_total_and_positions(spark):
    rows = spark.createDataFrame([(a, T0 + dt.timedelta(hours=i), i) for a in "AB" for i in range(60)], "asset string, ts timestamp_ntz, v long")
    found = order.indexed(order.running_total(rows, F.col("v"), "t")).collect()
    assert all(r.i == r.v and r.t == r.v * (r.v + 1) // 2 for r in found) and len(found) == 120


def test_gate_is_left_open_and_warms_up(spark):
    days = [0, 1, 2, 3, 6]
    rows = spark.createDataFrame([("A", i, dt.datetime(2023, 1, 1) + dt.timedelta(days=d), float(v)) for i, (d, v) in enumerate(zip(days, [100, 1, 2, 3, 2]))], "asset string, i long, ts timestamp_ntz, sigma_hat double")
    found = [(r.regime_threshold, r.regime) for r in regime.gate(rows, days=3, least=2, share=0.5).orderBy("i").collect()]
    assert found == [(None, "expansion"), (50.5, "ranging"), (2.0, "ranging"), (2.0, "expansion"), (None, "expansion")]


def test_causality(spark):
    """A change at one bar leaves every earlier feature as it was."""
    def features(values):
        own = series(spark, values, "close").withColumns({"return": F.col("close") / 100, "gk_var": F.abs("close")})
        own = rolling.with_rolling(own, 5, z=rolling.zscore(5), m=rolling.moving_average("close", 5))
        own = rolling.kernel_features(rolling.fractal_metrics(own, window=5, ref=10), 1, 1, 2, 2, 8)
        return [tuple(r) for r in own.select("z", "m", "r1", "r2", "theta_dynamic", "hurst").orderBy("i").collect()]

    base = [100 + math.sin(i * 1.7) * 3 for i in range(40)]
    one, two = features(base), features([*base[:30], 500.0, *base[31:]])
    assert one[:30] == two[:30] and one[31:] != two[31:]
    assert [r[2:] for r in one[:31]] == [r[2:] for r in two[:31]]  # lagged ones are the same at the bar itself


def test_files(spark, tmp_path, weekend):
    plain = tmp_path / "m.csv"
    plain.write_text("Datetime,Open,High,Low,Close\n2023-01-06 16:50:00,1,2,0.5,1.5\n2023-01-06 16:50:00,9,9,9,9\n2023-01-06 16:51:00,1,2,0.5,1.5\n")
    assert sorted((r.ts.minute, r.open) for r in sources.minute_csv(spark, str(plain)).collect()) == [(50, 1.0), (51, 1.0)]
    vendor = tmp_path / "v.csv"
    vendor.write_text("<Date>\t<Time>\t<Open>\t<High>\t<Low>\t<Close>\t<Extra>\n2023.01.06\t16:50:00\t1\t2\t0.5\t1.5\tx\n")
    raw = sources.vendor_csv(spark, str(vendor))
    assert raw.columns == list(sources.STANDARD)
    row = sources.with_time(raw).first()
    assert (row.ts, row.close, row.vol, row.spread) == (T0, 1.5, 1_000_000, 0)
    back = sources.write_bars(weekend, str(tmp_path / "bars"))
    assert sources.between_days(back, "2023-01-06", "2023-01-06").count() == 6
    assert sources.cached(spark, str(tmp_path / "c"), lambda: weekend).count() == 17
    wrong = weekend.unionByName(weekend.limit(1).withColumns({"high": F.lit(1.0), "open": F.lit(None).cast("double")}))
    report = bars.validate(wrong).first()
    assert (report.n_rows, report.n_null, report.n_high_low, report.n_high_body) == (18, 1, 1, 1)


def test_model_files(spark, tmp_path):
    for name in ("x", "y"):
        spark.createDataFrame([(1.0, 0.2, 0.8), (2.0, 0.5, 0.5)], "close double, regime_a_prob double, regime_b_prob double").coalesce(1).write.parquet(str(tmp_path / f"regime_probs_max_dc_train_{name}.parquet"))
    found = regime.likeliest(sources.model_files(spark, str(tmp_path)), ["regime_a_prob", "regime_b_prob"])
    assert sorted((r.model, r.close, r.regime) for r in found.collect()) == [(m, c, g) for m in "xy" for c, g in ((1.0, "b"), (2.0, "a"))]


def test_a_folder_of_vendor_files_in_one_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "EURUSD_M1.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2024.01.02\t00:00:00\t1\t2\t0.5\t1.5\t7\n\n2024.01.02\t00:01:00\t1\tx\t0.5\t1.5\t7\n2024.01.02\t00:02:00\t1\n")
    (tmp_path / "deep" / "XAUUSD.csv").write_text("Date,Time,Close,Open,Low,High,Spread,More\r\n2024.01.03,10:00:00,9,8,7,10,3,?\r\n")
    (tmp_path / "none.csv").write_text("1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    rows = sources.vendor_folder(spark, str(tmp_path)).collect()
    good = {r.asset: (r.DATE, r.TIME, r.OPEN, r.HIGH, r.LOW, r.CLOSE, r.TICKVOL, r.VOL, r.SPREAD) for r in rows if r.bad is None}
    assert good == {"EURUSD": ("2024.01.02", "00:00:00", 1.0, 2.0, 0.5, 1.5, 7, 1_000_000, 0), "XAUUSD": ("2024.01.03", "10:00:00", 8.0, 10.0, 7.0, 9.0, 1, 1_000_000, 3)}
    assert sorted(r.bad for r in rows if r.bad is not None) == ["1,2,3", "2024.01.02\t00:01:00\t1\tx\t0.5\t1.5\t7", "2024.01.02\t00:02:00\t1"]
    one = sources.with_time(sources.vendor_folder(spark, str(tmp_path)).where("bad is null"))
    assert {str(r.ts) for r in one.collect()} == {"2024-01-02 00:00:00", "2024-01-03 10:00:00"}


def test_scales_from_a_file(spark, tmp_path):
    (tmp_path / "scales.json").write_text('{"small_dc": {"theta_base": 0.001, "window": 20, "lambda_aggression": 1.0}, "plain": {}}')
    small, plain = sources.scales(spark, str(tmp_path / "scales.json"))
    assert (small.name, small.theta, small.window, small.aggression) == ("small_dc", 0.001, 20, 1.0)
    assert (plain.theta, plain.window) == (0.005, 50)
