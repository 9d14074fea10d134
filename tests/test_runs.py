import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill import scratch
from tidemill.operators import events, folds, ou, regime, running, runs, signatures
from tidemill.plans import catalog  # first: it registers the modules of queries
from tidemill.plans import bar_queries
from tidemill.sources import ticks as sources


def test_moving_quantile_against_plain_windows():
    rng = random.Random(2)
    for share in (0.5, 0.3333, 1.0):
        us = np.sort(np.array([rng.randint(0, 400) for _ in range(200)]))
        values = np.array([rng.choice([np.nan, 1.0, 2.0, rng.random()]) for _ in us])
        found = regime._moving_quantile(us, values, 60, 5, share)
        for now, got in zip(us, found, strict=True):
            held = values[(us > now - 60) & (us <= now)]
            held = held[~np.isnan(held)]
            assert got is None if len(held) < 5 else got == pytest.approx(np.quantile(held, share))


def test_expanding_median_against_plain_medians(spark):
    rng = random.Random(3)
    values = [None if rng.random() < 0.2 else rng.choice([1.0, rng.random()]) for _ in range(120)]
    rows = spark.createDataFrame([(a, i, x, "c") for a in ("x", "y") for i, x in enumerate(values)], "asset string, i long, v double, x string").repartition(3)
    for r in running.expanding_median(rows, "v", "m").collect():
        own = [v for v in values[: r.i + 1] if v is not None]
        assert r.m == (pytest.approx(float(np.median(own))) if own else None)


def test_frozen_parameters_are_those_of_the_last_fold(spark):
    folds = spark.createDataFrame([("x", 0, 1.0, 1.0, 1.0), ("x", 3, 0.001, -0.5, 0.1), ("x", 2, 9.0, 9.0, 9.0)], "asset string, fold int, b0 double, b1 double, b2 double")
    rows = spark.createDataFrame([("x", 0.001, 0.02), ("x", 1.0, 0.0)], "asset string, r1 double, root_r2 double")
    got = [(r.sigma_hat, r.beta1_sign) for r in runs.frozen(rows, folds).orderBy("r1").collect()]
    assert got == [(pytest.approx(0.0025), -1), (5e-4, -1)]


def test_fallback_rows_and_their_summary(spark, tmp_path):
    bars = spark.createDataFrame([("calm", i, 100.0 + i, "ranging") for i in range(30)] + [("both", i, 100.0 + (i * 7) % 5, "ranging" if i % 10 < 5 else "expansion") for i in range(60)], "asset string, i long, close double, regime string")
    batch = ou.batch_priors(bars.withColumn("ts", F.timestamp_seconds("i")))
    found = {(r.model, r.source): r for r in batch.collect()}
    assert found.keys() == {(m, s) for m in ("calm", "both") for s in ("ranging", "expansion")}
    calm = found["calm", "ranging"]
    assert (calm.n_regimes, calm.theta, calm.vol_ratio_median, calm.n_segments, calm.theta_fallback_used) == (1, 0.35, 0.70, 0, True) and found["both", "ranging"].n_segments == 6
    assert [r.model for r in ou.fallback_summary(batch).orderBy("worst").collect()][0] == "calm"
    ou.written(batch, str(tmp_path / "priors"))
    lines = [json.loads(x) for f in (tmp_path / "priors").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and {x["model"] for x in lines} == {"calm", "both"}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.workdir(Session())


def test_warm_start_and_max_folds(spark):
    assert catalog.QUERIES
    rows = bar_queries.rich(spark, "/root/testdata/sf0.01")
    options = {"h": 24, "n": 50, "train": "10 days", "test": "2 days", "least": (450, 100), "rounds": 1}
    warm = folds.walk_forward(rows, max_folds=2, warm_start=True, **options).select("fold", "alpha1", "in_sample_r2").distinct().orderBy("fold").collect()
    cold = folds.walk_forward(rows, max_folds=2, **options).select("fold", "alpha1", "in_sample_r2").distinct().orderBy("fold").collect()
    assert [r.fold for r in warm] == [r.fold for r in cold] == [0, 1] and warm[0] == cold[0] and warm[1].in_sample_r2 > 0


def test_converter_checks_and_preconditions(spark, tmp_path):
    good = tmp_path / "x.csv"
    good.write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\n2024.01.02\t10:00:00\t1\t2\t0.5\t1.5\n2024.01.02\t10:01:00\t1\t0.8\t0.5\t1.5\n")
    found = sources.converted(spark, str(good), str(tmp_path / "out"), "X")
    assert (found["n_rows"], found["n_high_body"], found["n_null"]) == (2, 1, 0) and spark.read.parquet(str(tmp_path / "out")).count() == 2
    bad = tmp_path / "y.csv"
    bad.write_text("DATE,TIME,OPEN,HIGH,LOW,CLOSE\n2024.01.02,10:00:00,a,2,0.5,1.5\n")
    with pytest.raises(Exception, match="."):
        sources.converted(spark, str(bad), str(tmp_path / "no"), "Y")
    assert not (tmp_path / "no").exists()
    with pytest.raises(FileNotFoundError, match="absent"):
        sources.converted(spark, str(tmp_path / "absent.csv"), str(tmp_path / "no"), "Y")
    frame = spark.createDataFrame([("2024-01-02 10:00:00", "1")], "Datetime string, Close string")
    with pytest.raises(ValueError, match="Close: string"):
        sources.remapped(frame, "Datetime", "Close")
    assert sources.remapped(frame.withColumn("Close", F.lit(2)), "Datetime", "Close").first().close == 2.0


def test_an_unfinished_write_is_no_cache(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "c"))
    (tmp_path / "c" / "_SUCCESS").unlink()
    assert sources.cached(spark, str(tmp_path / "c"), lambda: spark.range(5)).count() == 5 == sources.cached(spark, str(tmp_path / "c"), lambda: spark.range(7)).count()


def test_scales_by_configuration_features_and_least_events(spark, tmp_path):
    assert events.Scale.of("a", {}) == events.Scale("a", 0.005, 50, 2.0) and events.Scale.of("a", {"window": 30}).window == 30
    assert events.causal_features(bar_queries.rich(spark, "/root/testdata/sf0.001")).columns == ["asset", "ts", "hurst", "energy_v", "fractal_f", "theta_dynamic", "sigma_local"]
    few = spark.createDataFrame([("x", "mid_dc", 1)], "asset string, scale string, i long")
    with pytest.raises(ValueError, match="x mid_dc: 1"):
        signatures.enough(few, 10)
    back = sources.write_signatures(few.withColumn("signature", F.array(F.lit(1.0))), str(tmp_path / "s"))
    assert back.count() == 1
