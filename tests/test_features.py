"""Motion, mobility, sleep, cleaning, statistics and models."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna.functions import geo, values
from diurna.operators import merging, mobility, modelling, motion, screening, secondary, sleep

START = datetime(2024, 1, 1, 12)


def no_zones(spark):
    return spark.createDataFrame([], "participantid string, timezone_id string, start_time timestamp, end_time timestamp")


def test_accelerometer_points(spark):
    rows = [(1, "a", START, 0.4, 0.0, 0.0), (2, "a", START + timedelta(seconds=1), 0.4, 0.3, 0.0), (3, "a", START + timedelta(seconds=2), 20.1, 0.0, 0.0), (4, "a", START + timedelta(seconds=3), None, 0.0, 0.0), (1, "a", START, 0.4, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "_id long, participantid string, measuredat timestamp, acc_x double, acc_y double, acc_z double")
    got = motion.accelerometer_points(p, no_zones(spark)).orderBy("_id").collect()
    assert [(r._id, r.euclidean_norm_g, r.euclidean_distance_g, r.vigorous_pa) for r in got] == [(1, 0.4, None, 1), (2, 0.5, 0.3, 1)]
    day = motion.daily_accelerometer(motion.accelerometer_points(p.where("_id = 1"), no_zones(spark))).first()
    assert (day.total_active_seconds, day.afternoon_pa_seconds, float(day.activity_variability), day.weekday_local) == (1, 1, 0.0, "Monday")


def test_coordinates(spark):
    texts = ["44.1 | -63.2 | 10", "44 | -63", "44.1", "None", "95.5 | 10.0", None, "x 12.5|-7 y", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", geo.strict_coordinate(F.col("t"), 0).alias("a"), geo.lenient_coordinates(F.col("t")).alias("c"), geo.spaced_coordinate(F.col("t"), 0).alias("s"))
    rows = df.orderBy("i").collect()
    assert [r.a for r in rows] == [44.1, None, 44.1, None, 95.5, None, None, None]
    assert [(r.c.lat, r.c.lon) for r in rows] == [(44.1, -63.2), (44.0, -63.0), (None, None), (None, None), (None, None), (None, None), (12.5, -7.0), (None, None)]
    assert [r.s for r in rows][:4] == [44.1, 44.0, 44.1, None]


def test_mobility(spark):
    rows = [(1, "a", START, "44.0 | -63.0 | 0", "UTC"), (2, "a", START + timedelta(seconds=599), "44.0 | -63.0 | 0", "UTC"), (3, "a", START + timedelta(seconds=1199), "44.1 | -63.0 | 0", "UTC"), (4, "b", START, "1.5 | 1.5", None)]
    loc = spark.createDataFrame(rows, "_id long, participantid string, measuredat timestamp, location_decrypted string, timezone_id string")
    got = {r.participantid: r for r in mobility.daily_gps(loc).collect()}
    assert got["a"].number_of_stay_points == 1 and got["a"].total_time_at_clusters_seconds == 600 and got["a"].location_entropy == 0.0
    assert abs(got["a"].total_haversine_meters - 11119) <= 1
    assert got["b"].location_variance is None and got["b"].radius_of_gyration_meters == 0.0


def test_entropy_equals_its_definition(spark):
    dwell = [600, 700, 1800, 0]
    got = spark.createDataFrame([(x,) for x in dwell], "x long").agg(mobility.dwell_entropy(F.col("x")).alias("e")).first().e
    total = sum(dwell)
    assert math.isclose(got, -sum(x / total * math.log(x / total) for x in dwell if x), rel_tol=1e-9)


def test_sleep_windows_equal_rows(spark):
    random.seed(3)
    rows = [(str(i % 3), START + timedelta(seconds=random.randrange(5 * 86400)), random.choice(["on", "off", "unknown"])) for i in range(600)]
    e = spark.createDataFrame(rows, "participantid string, measuredat timestamp, event_type string")
    n = sleep.night_events(e, no_zones(spark))
    a, b = (sorted(map(tuple, f(n).collect())) for f in (sleep.nightly, sleep.nightly_by_rows))
    assert a == b and a


def test_conditional_zeros_and_caps(spark):
    df = spark.createDataFrame([(None, 5), (None, None), (21600, 1), (21601, 1)], "morning_pa_seconds int, total int")
    assert [r[0] for r in values.zero_if_observed(df, ["morning_pa_seconds"], "total").collect()] == [0, None, 21600, 21601]
    assert [r[0] for r in values.capped(df, values.CAPS["activity", "ios"]).collect()] == [None, None, 21600, None]


@pytest.mark.parametrize(("score", "value", "expected"), [("emo_symptoms", 3, "normal"), ("emo_symptoms", 5, "borderline"), ("emo_symptoms", 6, "abnormal"), ("emo_symptoms", 11, None), ("emo_symptoms", -1, None), ("prosocial", 5, "abnormal"), ("prosocial", 7, "normal"), ("conduct_probs", 3, "borderline"), ("hyperactivity", 8, "abnormal"), ("peer_probs", None, None)])
def test_categories(spark, score, value, expected):
    assert spark.createDataFrame([(value,)], "x int").select(values.category(score, F.col("x"))).first()[0] == expected


def test_merge_and_complete_days(spark):
    a = spark.createDataFrame([("1", 1, 10), ("1", 2, 20)], "participantid string, date_local int, n int")
    b = spark.createDataFrame([("1", 2, 5), ("2", 1, 6)], "participantid string, date_local int, n int")
    m = merging.merge_days({"gps": a, "call": b})
    assert m.count() == 3 and merging.complete_days(m).collect()[0].asDict() == {"participantid": "1", "date_local": 2, "gps_n": 20, "call_n": 5}
    plan = merging.complete_days(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "FullOuter" not in plan
    assert merging.with_enough_days(a, 2).count() == 2 and merging.with_enough_days(a, 3).count() == 0


def test_statistics(spark):
    x = [1.0, 4.0, 2.0, 2.0, None, 9.0]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(x)] + [("q", 0, 5.0), ("z", 0, 0.0), ("z", 1, 0.0)], "participantid string, date_local int, v double")
    got = {r.participantid: r for r in secondary.statistics(secondary.long_form(df, ["v"])).collect()}
    known = np.array([v for v in x if v is not None])
    p = got["p"]
    assert math.isclose(p.median, np.median(known)) and math.isclose(p.sd, known.std(ddof=1)) and math.isclose(p.iqr, np.percentile(known, 75) - np.percentile(known, 25))
    assert math.isclose(p.rmssd, math.sqrt((np.diff(known) ** 2).mean())) and math.isclose(p.mad, 1.4826 * np.median(np.abs(known - np.median(known))))
    assert (p.above_median, p.below_median, p.range) == (2, 1, 8.0)
    assert got["q"].sd is None and got["q"].rmssd is None and got["z"].cv is None and got["z"].entropy == 0.0


def test_histogram_breaks(spark):
    v = spark.createDataFrame([("p", "f", float(i)) for i in range(0, 11)], "participantid string, feature string, x double")
    # breaks 0, 1, ..., 10: closed on the right, the lowest included
    counts = [2] + [1] * 9
    expected = -sum(c / 11 * math.log2(c / 11) for c in counts)
    assert math.isclose(secondary.histogram_entropy(v, ["participantid", "feature"]).first().entropy, expected, rel_tol=1e-9)


def test_prepared_days(spark):
    day = lambda i: datetime(2024, 1, 1 + i).date()
    keys = "participantid string, date_local date, "
    frame = lambda rows, columns: spark.createDataFrame(rows, keys + columns)
    days = {"A1": range(6), "B": range(5), "C": range(6), "D": range(6), "E": range(4)}
    every = [(p, day(i)) for p, own in days.items() for i in own]
    gps = frame([(p, d, d, 3e6 if (p, d) == ("A1", day(5)) else 10.0) for p, d in every] + [("B", day(4), day(5), 20.0)], "date_utc date, total_haversine_meters double")
    sleep_days = frame([(p, d, 1) for p, d in every], "total_night_screen_minutes int")
    columns = [f"{n}_screen_time_in_seconds" for n in ("morning", "afternoon", "evening", "nighttime")] + [f"num_of_events_{n}" for n in ("morning", "afternoon", "evening", "nighttime")]
    screen = frame([(p, d, "Mon", 30000, 4, 0, None if d == day(0) else 30000 * (p == "B"), 0, 0, 0, 0, 0, 0) for p, d in every if p != "D"], "weekday_local string, total_screen_time_in_seconds int, num_of_events_total int, " + ", ".join(f"{c} int" for c in columns))
    call = frame([(p, d, None) for p, d in every if p != "D"], "num_all_calls int")
    call = call.withColumns({c: F.lit(None).cast("int") for c in merging.CALL_COLUMNS if c != "num_all_calls"})
    activity = frame([(p, d, 5) for p, d in every if p != "D"], "total_active_seconds int")
    of = lambda ids: {n: f.where(F.col("participantid").isin(*ids)) for n, f in (("screen", screen), ("call", call), ("activity", activity))}
    scores = spark.createDataFrame([("a1", 3)], "participantid string, emo_symptoms_baseline int")
    got = merging.prepared_days(gps, sleep_days, of(["A1", "C"]), of(["B", "C", "E"]), scores).collect()
    # C is on both platforms, D on none, E has four days; one day of A1 is too far
    assert sorted((r.participantid, r.date_local, r.device_type, r.gps_total_haversine_meters, r.call_num_all_calls, r.emo_symptoms_baseline) for r in got) == [
        *(("A1", day(i), "android", 10.0, 0, 3) for i in range(5)), *(("B", day(i), "ios", 20.0 if i == 4 else 10.0, 0, None) for i in range(5))]
    assert not [c for c in got[0].asDict() if c.endswith(("weekday_local", "_device_type"))]


@pytest.mark.parametrize("most", [10**6, 300, 5])
def test_quantiles_of_many_values(spark, monkeypatch, most):
    monkeypatch.setattr(secondary, "RANKED", most)
    rng = np.random.default_rng(most)
    for x in (rng.normal(size=5001), rng.integers(0, 3, 4000).astype(float), np.zeros(1000), np.arange(400.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert np.allclose(secondary.quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]), np.quantile(x, [0, 0.25, 0.5, 0.75, 1]))
    assert secondary.quantiles(df.limit(0), "x", [0.5]) == [None] and secondary.iqr_outliers(df.limit(0), "x", []).count() == 0


def test_kruskal_with_ties(spark):
    groups = {"a": [1, 2, 2, 3], "b": [2, 4, 5, 5], "c": [6, 7, 7, 8]}
    v = spark.createDataFrame([("f", g, float(x)) for g, xs in groups.items() for x in xs], "feature string, outcome string, x double")
    allx = pd.Series([x for xs in groups.values() for x in xs])
    ranks = allx.rank()
    n, at, s = 12, 0, 0.0
    for xs in groups.values():
        s += ranks[at : at + len(xs)].sum() ** 2 / len(xs)
        at += len(xs)
    ties = sum(c**3 - c for c in allx.value_counts())
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    r = screening.kruskal(v).first()
    assert math.isclose(r.h, h) and math.isclose(r.p, math.exp(-h / 2)) and math.isclose(r.epsilon2, max(0, (h - 2) / 11))
    assert math.isclose(screening.kruskal(v, compat=True).first().epsilon2, (h + 1) / 11)
    d = {(r.a, r.b): r for r in screening.dunn(v).collect()}
    means = [ranks[:4].mean(), ranks[4:8].mean(), ranks[8:].mean()]
    sigma = math.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / 4 + 1 / 4))
    for (a, b), (i, j) in {("a", "b"): (0, 1), ("a", "c"): (0, 2), ("b", "c"): (1, 2)}.items():
        z = (means[i] - means[j]) / sigma
        assert math.isclose(d[a, b].z, z) and math.isclose(d[a, b].p, math.erfc(abs(z) / math.sqrt(2)) / 2)


def test_rank_sums_of_pairs(spark):
    groups = {"a": [1.0, 2, 2, 3], "b": [2.0, 4, 5, 5, 9], "c": [7.0]}
    v = spark.createDataFrame([("f", g, float(x)) for g, xs in groups.items() for x in xs] + [("same", g, 1.0) for g in "ab"], "feature string, outcome string, x double")
    got = {(r.feature, r.a, r.b): r for r in screening.wilcoxon_pairs(v).collect()}
    assert set(got) == {("f", "a", "b"), ("f", "a", "c"), ("f", "b", "c"), ("same", "a", "b")} and got["same", "a", "b"].p is None
    both = pd.Series(groups["a"] + groups["b"])
    w = both.rank()[:4].sum() - 10
    ties = sum(c**3 - c for c in both.value_counts())
    z = (w - 10 + 0.5) / math.sqrt(20 / 12 * (10 - ties / 72))
    assert got["f", "a", "b"].w == w and math.isclose(got["f", "a", "b"].p, math.erfc(abs(z) / math.sqrt(2)))
    ps = sorted(got["f", a, b].p for a, b in (("a", "b"), ("a", "c"), ("b", "c")))
    assert math.isclose(min(r.q for k, r in got.items() if k[0] == "f"), min(1, ps[0] * 3, ps[1] * 1.5, ps[2]))


@pytest.mark.parametrize("n", [3, 4, 31, 50])
def test_bootstrap_medians_are_those_of_resamples(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    v = spark.createDataFrame([("f", float(a)) for a in x] + [("few", 1.0), ("few", 3.0)], "feature string, x double")
    got = {r.feature: r for r in screening.bootstrap_medians(v, ["feature"], 20_000).collect()}
    assert (got["few"].median, got["few"].low, got["few"].high) == (2.0, None, None)
    medians = np.median(x[rng.integers(0, n, (20_000, n))], axis=1)
    share = [np.mean(medians <= got["f"][c] + 1e-12) for c in ("low", "median", "high")]
    below = [np.mean(medians < got["f"][c] - 1e-12) for c in ("low", "median", "high")]
    assert all(b - 0.01 <= p <= a + 0.01 for a, b, p in zip(share, below, (0.025, 0.5, 0.975), strict=True))


def test_chi2_tails():
    assert math.isclose(screening.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(screening.chi2_sf(7.814727903251179, 3), 0.05, rel_tol=1e-6)
    assert math.isclose(screening.chi2_sf(9.487729036781154, 4), 0.05, rel_tol=1e-6)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r.p: r.q for r in screening.bh_adjusted(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    assert np.allclose([got[x] for x in p], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_clusters():
    c = pd.DataFrame([("a", "b", 0.95), ("a", "c", 0.1), ("b", "c", 0.1)], columns=["a", "b", "rho"])
    numbers = screening.clusters(c, ["a", "b", "c"])
    assert numbers == {"a": 0, "b": 0, "c": 1} and screening.representatives(numbers, ["a", "b", "c"]) == ["a", "c"]


def test_binomial_interval():
    low, high = screening.binomial_interval(8, 10)
    assert math.isclose(low, 0.4439045, rel_tol=1e-5) and math.isclose(high, 0.9747893, rel_tol=1e-5)
    assert screening.binomial_interval(0, 10)[0] == 0 and screening.binomial_interval(10, 10)[1] == 1
    for hits, n in ((1, 3), (17, 40), (39, 40)):  # against the binomial tails themselves
        low, high = screening.binomial_interval(hits, n)
        tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)  # noqa: B023, E731
        assert math.isclose(tail(low, range(hits, n + 1)), 0.025, rel_tol=1e-9) and math.isclose(tail(high, range(hits + 1)), 0.025, rel_tol=1e-9)
    low, high = screening.binomial_interval(752_500, 1_000_000)
    half = 1.959964 * math.sqrt(0.7525 * 0.2475 / 1e6)
    assert math.isclose(low, 0.7525 - half, abs_tol=2e-6) and math.isclose(high, 0.7525 + half, abs_tol=2e-6)


def test_intervals_of_means(spark):
    assert math.isclose(screening.t_quantile(0.975, 9), 2.2621571627, rel_tol=1e-9) and math.isclose(screening.t_quantile(0.975, 1), 12.7062047362, rel_tol=1e-9)
    df = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("a", None), ("b", 0.4)], "model string, accuracy double")
    got = {r.model: r for r in screening.mean_intervals(df, "accuracy", ["model"]).collect()}
    half = 12.7062047362 * np.std([0.5, 0.7], ddof=1) / math.sqrt(2)
    assert got["a"].n == 2 and math.isclose(got["a"].low, 0.6 - half, rel_tol=1e-9) and math.isclose(got["a"].high, 0.6 + half, rel_tol=1e-9) and got["b"].low is None


def test_huber_and_folds(spark):
    assert modelling.huber(np.array([1.0, 2.0]))[0] == 1.5
    mu, s = modelling.huber(np.array([1.0, 2, 3, 4, 100]))
    assert 2.5 < mu < 4 and math.isclose(s, 1.4826)
    df = spark.createDataFrame([(str(i), "x" if i % 3 else "y") for i in range(60)], "participantid string, outcome string")
    sizes = [r["count"] for r in modelling.folds(df, ["outcome"], 5, seed=1).groupBy("fold", "outcome").count().collect()]
    assert max(sizes) - min(sizes) <= 4 and sum(sizes) == 60
    w = {r.outcome: r.weight for r in modelling.class_weights(df).collect()}
    assert math.isclose(w["x"] + w["y"], 2.0) and math.isclose(w["y"] / w["x"], 2.0)
    up = modelling.upsampled(df, ["outcome"])
    assert {r.outcome: r["count"] for r in up.groupBy("outcome").count().collect()} == {"x": 40, "y": 40}


def matrix(spark, n=80):
    rng = np.random.default_rng(4)
    rows = [(str(i), "ios" if i % 2 else "android", "high" if i % 4 < 2 else "low", float(i % 4 < 2) * 3 + rng.normal(), rng.normal(), rng.normal()) for i in range(n)]
    return spark.createDataFrame(rows, "participantid string, device_type string, outcome string, a double, b double, c double")


def test_models_learn_and_leak_nothing(spark):
    m = matrix(spark)
    out = modelling.cross_validated(m, ["a", "b", "c"], [("net", modelling.elastic_net(0.5, 0.01))], k=2, top=(2,))
    assert out.count() == 80 and modelling.evaluation(out).first().accuracy > 0.75
    ready = modelling.prepare(m.where("cast(participantid as int) < 40"), m.where("cast(participantid as int) >= 40").withColumn("a", F.col("a") * 1000), ["a", "b", "c"])
    assert ready.test.agg(F.max(F.abs("a"))).first()[0] == 3.0 and ready.train.agg(F.max(F.abs("a"))).first()[0] <= 3.0


def test_two_stage_forest_and_strength(spark):
    ready = modelling.prepare(matrix(spark), matrix(spark), ["a", "b", "c"])
    _, chosen = modelling.two_stage_forest(ready.train, ready.columns, modelling.random_forest(5, "sqrt"), 2, 0.5, 1)
    assert chosen[0] == "a"
    path = modelling.strengths(1.0, 3)
    assert len(path) == 3 and modelling.best_strength(ready.train, ready.columns, 0.5, path, 2) in path
