"""Queries on statistics, screening and preparation for models."""

from __future__ import annotations

from .catalogue import *  # noqa: F403
from .catalogue import EV, LONG, F, Window, day_values, grids, long_values, modelling, motion, outcome_values, query, screening, secondary, values, views

STATS = """q AS (SELECT participantid, feature, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, max(x) - min(x) AS range FROM lv GROUP BY 1, 2),
r AS (SELECT participantid, feature, sqrt(avg(dx * dx)) AS rmssd FROM (SELECT *, x - lag(x) OVER (PARTITION BY participantid, feature ORDER BY d) AS dx FROM lv) GROUP BY 1, 2),
m AS (SELECT participantid, feature, 1.4826 * quantile_cont(abs(x - median), 0.5) AS mad, count(*) FILTER (x > median) AS above_median, count(*) FILTER (x < median) AS below_median FROM lv JOIN q USING (participantid, feature) GROUP BY 1, 2)"""


HIST = """hs AS (SELECT participantid, feature, min(x) AS lo, max(x) AS hi FROM lv GROUP BY 1, 2),
hr AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 10 WHEN greatest(abs(lo), abs(hi)) > 0 THEN greatest(abs(lo), abs(hi)) / 10 ELSE 0.1 END AS raw FROM hs),
hb AS (SELECT *, power(10.0, floor(log10(raw))) AS b FROM hr),
hp AS (SELECT *, CASE WHEN 10 * b - raw < 1.5 * (raw - 5 * b) THEN 10 * b WHEN 5 * b - raw < 2.75 * (raw - 2 * b) THEN 5 * b WHEN 2 * b - raw < 1.5 * (raw - b) THEN 2 * b ELSE b END AS step FROM hb),
hc AS (SELECT participantid, feature, greatest(ceil(x / step - 1e-7) - 1, floor(lo / step + 1e-7)) AS bin, count(*) AS n FROM lv JOIN hp USING (participantid, feature) GROUP BY 1, 2, 3)"""


@query(
    "e13_secondary_statistics",
    f"WITH {LONG}, {STATS}, {HIST}, en AS (SELECT participantid, feature, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM hc GROUP BY 1, 2) SELECT participantid, feature, CAST(CAST(CAST(mean AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS mean, CAST(CAST(CAST(median AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS median, CAST(CAST(CAST(sd AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS sd, CAST(CAST(CAST(iqr AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS iqr, CAST(CAST(CAST(CASE WHEN mean <> 0 THEN sd / mean END AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS cv, CAST(CAST(CAST(rmssd AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS rmssd, CAST(CAST(CAST(mad AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS mad, CAST(CAST(CAST(range AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS range, above_median, below_median, CAST(CAST(CAST(entropy AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS entropy FROM q JOIN r USING (participantid, feature) JOIN m USING (participantid, feature) JOIN en USING (participantid, feature)",
)
def e13(spark, d):
    out = secondary.statistics(long_values(spark, d))
    return out.select(*(motion.numeric(F.col(c)).alias(c) if t == "double" else c for c, t in out.dtypes))


@query("m07_hist_entropy", f"WITH {LONG}, {HIST} SELECT participantid, feature, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM hc GROUP BY 1, 2")
def m07(spark, d):
    return secondary.histogram_entropy(long_values(spark, d), ["participantid", "feature"])


@query(
    "o12_participant_features",
    f"WITH {LONG}, {STATS}, u AS (SELECT participantid, count(*) AS available_days FROM dayval GROUP BY 1) SELECT participantid, available_days, "
    + ", ".join(f"CAST(CAST(CAST(max({s}) FILTER (feature = '{c}') AS DECIMAL(20, 12)) AS DECIMAL(12, 4)) AS DOUBLE) AS {c}_{s}" for c in ("total", "level") for s in ("mean", "median", "mad"))
    + ", (CAST(participantid AS BIGINT) * 3) % 11 AS emo_symptoms_baseline, CASE WHEN (CAST(participantid AS BIGINT) * 3) % 11 <= 3 THEN 'normal' WHEN (CAST(participantid AS BIGINT) * 3) % 11 <= 5 THEN 'borderline' ELSE 'abnormal' END AS emo_symptoms_baseline_cat FROM u JOIN q USING (participantid) JOIN m USING (participantid, feature) GROUP BY participantid, available_days",
)
def o12(spark, d):
    days = day_values(spark, d).join(views.scores(spark, d).select("participantid", "emo_symptoms_baseline"), "participantid", "left")
    out = secondary.with_categories(secondary.participant_features(days, ["total", "level"]))
    return out.select("participantid", "available_days", *(motion.numeric(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in ("total", "level") for s in ("mean", "median", "mad")), "emo_symptoms_baseline", "emo_symptoms_baseline_cat")


@query("m08_first_known", f"WITH {EV} SELECT participantid, arg_min(value, ts) FILTER (k % 3 <> 0) AS first_value FROM ev GROUP BY 1")
def m08(spark, d):
    e = views.events(spark, d).withColumn("v", F.when(F.col("k") % 3 != 0, F.col("value")))
    return e.groupBy("participantid").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("measuredat"))).alias("first_value"))


@query("f11_successive_differences", f"WITH {LONG} SELECT participantid, feature, strftime(d, '%Y-%m-%d') AS date_local, round(x - lag(x) OVER (PARTITION BY participantid, feature ORDER BY d), 4) AS diff FROM lv")
def f11(spark, d):
    w = Window.partitionBy("participantid", "feature").orderBy("date_local")
    return long_values(spark, d).select("participantid", "feature", "date_local", (F.col("x") - F.lag("x").over(w)).alias("diff"))


@query("e15_iqr_outliers", f"WITH {EV}, b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev) SELECT event_id, round(value, 4) AS value, round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM ev, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def e15(spark, d):
    return secondary.iqr_outliers(views.events(spark, d), "value", ["event_id"])


RANKED = f"""{LONG}, ov AS (SELECT participantid, feature, avg(x) AS x, CAST(CAST(participantid AS BIGINT) % 3 AS VARCHAR) AS outcome FROM lv GROUP BY 1, 2),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, x) AS ties FROM ov)"""


@query("f13_average_ranks", f"WITH {RANKED} SELECT participantid, feature, CAST(r AS DOUBLE) AS r FROM rk")
def f13(spark, d):
    return outcome_values(spark, d).select("participantid", "feature", screening.average_rank(["feature"], "x").alias("r"))


KW = f"""{RANKED}, kg AS (SELECT feature, outcome, sum(r) AS s, count(*) AS m, sum(ties * ties - 1) AS t FROM rk GROUP BY 1, 2),
kw AS (SELECT feature, sum(m) AS n, count(*) AS k, (12 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - sum(t) / (power(sum(m), 3) - sum(m))) AS h FROM kg GROUP BY 1)"""


@query("m11_kruskal", f"WITH {KW} SELECT feature, round(h, 4) AS h, k, CAST(n AS BIGINT) AS n, round(greatest(0, (h - (k - 1)) / (n - 1)), 4) AS epsilon2, round(exp(-h / 2), 4) AS p FROM kw")
def m11(spark, d):
    return screening.kruskal(outcome_values(spark, d))


@query("f14_bh_adjust", f"WITH {KW}, p AS (SELECT feature, exp(-h / 2) AS p FROM kw), s AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS a FROM p) SELECT feature, round(p, 4) AS p, round(least(1, min(a) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS q FROM s")
def f14(spark, d):
    return screening.bh_adjusted(screening.kruskal(outcome_values(spark, d))).select("feature", "p", "q")


@query(
    "m09_spearman",
    f"""WITH {LONG}, ov AS (SELECT participantid, feature, avg(x) AS x FROM lv GROUP BY 1, 2), pr AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM ov a JOIN ov b USING (participantid) WHERE a.feature < b.feature),
rr AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2 AS rb FROM pr)
SELECT a, b, round(corr(ra, rb), 4) AS rho, count(*) AS n FROM rr GROUP BY 1, 2""",
)
def m09(spark, d):
    return screening.spearman(outcome_values(spark, d))


#: Three features: the nearest two are merged if near enough, then the third if the mean of its distances is.
CLUSTERS = f"""{LONG}, ov AS (SELECT participantid, feature, avg(x) AS x FROM lv GROUP BY 1, 2), pr AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM ov a JOIN ov b USING (participantid) WHERE a.feature < b.feature),
rr AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2 AS rb FROM pr),
ds AS (SELECT a, b, 1 - abs(corr(ra, rb)) AS d FROM rr GROUP BY 1, 2),
mg AS (SELECT arg_min(a, d) AS a, arg_min(b, d) AS b, min(d) AS d1, (sum(d) - min(d)) / 2 AS d2 FROM ds),
ft AS (SELECT * FROM (VALUES ('total', 0), ('level', 1), ('n', 2)) v(feature, place)),
rt AS (SELECT feature, place, CASE WHEN d1 <= 0.5 AND d2 <= 0.5 THEN 0 WHEN d1 <= 0.5 AND feature IN (a, b) THEN (SELECT min(place) FROM ft f WHERE f.feature IN (a, b)) ELSE place END AS root FROM ft, mg),
cl AS (SELECT feature, place, root, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM rt)"""


@query("m10_feature_clusters", f"WITH {CLUSTERS} SELECT feature, cluster, place = root AS representative FROM cl")
def m10(spark, d):
    features = ["total", "level", "n"]
    numbers = screening.clusters(screening.spearman(outcome_values(spark, d)).toPandas(), features, 0.5)
    return spark.createDataFrame([(f, numbers[f], f in screening.representatives(numbers, features)) for f in features], "feature string, cluster int, representative boolean")


@query("f10_first_of_cluster", f"WITH {CLUSTERS} SELECT feature, cluster FROM cl WHERE place = root")
def f10(spark, d):
    return m10(spark, d).where("representative").select("feature", "cluster")


#: The error function by its series.
ERF = "1.1283791670955126 * list_sum(list_transform(range(0, 120), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln(greatest({0}, 1e-12)) - lgamma(i + 1)) / (2 * i + 1)))"
BH = "least(1, min(p * m / place) OVER (PARTITION BY feature ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(
    "m12_dunn",
    f"""WITH {RANKED}, mn AS (SELECT feature, outcome, avg(r) AS mean, count(*) AS m FROM rk GROUP BY 1, 2), wh AS (SELECT feature, count(*) AS n, sum(ties * ties - 1) AS t FROM rk GROUP BY 1),
zs AS (SELECT a.feature, a.outcome AS a, b.outcome AS b, (a.mean - b.mean) / sqrt((n * (n + 1) / 12 - t / (12 * (n - 1))) * (1 / a.m + 1 / b.m)) AS z FROM mn a JOIN mn b ON a.feature = b.feature AND a.outcome < b.outcome JOIN wh ON wh.feature = a.feature),
ps AS (SELECT *, (1 - {ERF.format('(abs(z) / sqrt(2))')}) / 2 AS p FROM zs), pn AS (SELECT *, count(*) OVER (PARTITION BY feature) AS m, row_number() OVER (PARTITION BY feature ORDER BY p) AS place FROM ps)
SELECT feature, a, b, round(z, 4) AS z, round(p, 4) AS p, round({BH}, 4) AS q FROM pn""",
)
def m12(spark, d):
    return screening.dunn(outcome_values(spark, d))


@query(
    "m12_wilcoxon_pairs",
    f"""WITH {RANKED.split(', ov AS')[0]}, ov AS (SELECT participantid, feature, avg(x) AS x, CAST(CAST(participantid AS BIGINT) % 3 AS VARCHAR) AS outcome FROM lv GROUP BY 1, 2),
ab AS (SELECT * FROM (VALUES ('0', '1'), ('0', '2'), ('1', '2')) v(a, b)), rw AS (SELECT feature, a, b, outcome, x FROM ov JOIN ab ON outcome IN (a, b)),
rr AS (SELECT *, rank() OVER (PARTITION BY feature, a, b ORDER BY x) + (count(*) OVER (PARTITION BY feature, a, b, x) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, a, b, x) AS ties FROM rw),
ts AS (SELECT feature, a, b, sum(r) FILTER (outcome = a) AS s, count(*) FILTER (outcome = a) AS na, count(*) FILTER (outcome = b) AS nb, sum(ties * ties - 1) AS t FROM rr GROUP BY 1, 2, 3),
zs AS (SELECT feature, a, b, s - na * (na + 1) / 2 AS w, (abs(s - na * (na + 1) / 2 - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))) AS z FROM ts),
ps AS (SELECT *, 1 - {ERF.format('(abs(z) / sqrt(2))')} AS p FROM zs), pn AS (SELECT *, count(*) OVER (PARTITION BY feature) AS m, row_number() OVER (PARTITION BY feature ORDER BY p) AS place FROM ps)
SELECT feature, a, b, round(w, 4) AS w, round(p, 4) AS p, round({BH}, 4) AS q FROM pn""",
)
def m12_wilcoxon(spark, d):
    return screening.wilcoxon_pairs(outcome_values(spark, d))


@query("m13_bootstrap_medians")
def m13(spark, d):
    return screening.bootstrap_medians(outcome_values(spark, d), ["feature", "outcome"])


SETS = "sets AS (SELECT DISTINCT et AS name, user_id * 100 + day(ts) AS member FROM ev)"


def _sets(spark, d):
    """The days of participants on which each kind of event occurs."""
    return views.events(spark, d).select(F.col("event_type").alias("name"), (F.col("user_id") * 100 + F.dayofmonth("measuredat")).alias("member")).distinct()


@query("h06_jaccard", f"WITH {EV}, {SETS}, n AS (SELECT name, count(*) AS n FROM sets GROUP BY 1), c AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM sets a JOIN sets b USING (member) WHERE a.name < b.name GROUP BY 1, 2) SELECT x.name AS a, y.name AS b, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 4) AS jaccard FROM n x JOIN n y ON x.name < y.name LEFT JOIN c ON c.a = x.name AND c.b = y.name")
def h06(spark, d):
    return screening.jaccard(_sets(spark, d), "name", "member")


@query("m14_selection_frequency", f"WITH {EV}, {SETS} SELECT member, count(DISTINCT name) AS folds, count(DISTINCT name) >= 4 AS stable FROM sets GROUP BY 1")
def m14(spark, d):
    return screening.selection_frequency(_sets(spark, d), "name", "member", 4)


PREDICTED = "pd AS (SELECT CAST(user_id % 3 AS VARCHAR) AS actual, CAST(CASE WHEN k % 4 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END AS VARCHAR) AS predicted FROM ev)"


def _predictions(spark, d):
    u = F.col("user_id")
    return views.events(spark, d).select((u % 3).cast("string").alias("actual"), F.when(F.col("k") % 4 == 0, (u + 1) % 3).otherwise(u % 3).cast("string").alias("predicted"))


@query("m16_confusion", f"WITH {EV}, {PREDICTED} SELECT actual, predicted, count(*) AS n FROM pd GROUP BY 1, 2")
def m16(spark, d):
    return screening.confusion(_predictions(spark, d))


@query(
    "m16_agreement",
    f"""WITH {EV}, {PREDICTED}, t AS (SELECT count(*) AS t FROM pd), a AS (SELECT actual AS c, count(*) AS r, count(*) FILTER (actual = predicted) AS h FROM pd GROUP BY 1), b AS (SELECT predicted AS c, count(*) AS l FROM pd GROUP BY 1),
m AS (SELECT *, h / l AS p, h / r AS rc, ((t - r - l + h) / (t - r) + h / r) / 2 AS bal FROM a JOIN b USING (c), t), s AS (SELECT sum(h) / max(t) AS acc, sum(r * l) / (max(t) * max(t)) AS ch, avg(p) AS mp, avg(rc) AS mr, avg(2 * p * rc / (p + rc)) AS mf, avg(bal) AS mb FROM m)
SELECT round(acc, 4) AS accuracy, round((acc - ch) / (1 - ch), 4) AS kappa, round(mp, 4) AS macro_precision, round(mr, 4) AS macro_recall, round(mf, 4) AS macro_f1, round(mb, 4) AS balanced_accuracy FROM s""",
)
def m16_agreement(spark, d):
    return screening.agreement(screening.confusion(_predictions(spark, d)))


# both bounds by bisection on the binomial tails, summed in logarithms
TAIL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"


@query(
    "m15_accuracy_interval",
    f"""WITH RECURSIVE {EV}, {PREDICTED}, t AS (SELECT count(*) FILTER (actual = predicted) AS hits, count(*) AS n FROM pd),
s AS (SELECT 0 AS step, hits, n, CAST(0 AS DOUBLE) AS la, CAST(1 AS DOUBLE) AS lb, CAST(0 AS DOUBLE) AS ha, CAST(1 AS DOUBLE) AS hb FROM t UNION ALL
  SELECT step + 1, hits, n, CASE WHEN lt < 0.025 THEN (la + lb) / 2 ELSE la END, CASE WHEN lt < 0.025 THEN lb ELSE (la + lb) / 2 END, CASE WHEN ht > 0.025 THEN (ha + hb) / 2 ELSE ha END, CASE WHEN ht > 0.025 THEN hb ELSE (ha + hb) / 2 END
  FROM (SELECT *, {TAIL.format(a='hits', b='n + 1', p='((la + lb) / 2)')} AS lt, {TAIL.format(a='0', b='hits + 1', p='((ha + hb) / 2)')} AS ht FROM s WHERE step < 40))
SELECT hits, n, round(la, 4) AS low, round(ha, 4) AS high FROM s WHERE step = 40""",
)
def m15(spark, d):
    row = _predictions(spark, d).agg(F.count_if(F.col("actual") == F.col("predicted")).alias("hits"), F.count("*").alias("n")).first()
    low, high = screening.binomial_interval(row.hits, row.n)
    return spark.createDataFrame([(row.hits, row.n, low, high)], "hits long, n long, low double, high double")


# 2.2621571627409915 is the 97.5 % quantile of the t distribution with 9 degrees of freedom
@query("m15_fold_interval", f"WITH {EV}, f AS (SELECT event_id % 10 AS fold, avg(CAST(k % 4 <> 0 AS INT)) AS accuracy FROM ev GROUP BY 1) SELECT count(*) AS n, round(avg(accuracy), 4) AS mean, round(avg(accuracy) - 2.2621571627409915 * stddev_samp(accuracy) / sqrt(10), 4) AS low, round(avg(accuracy) + 2.2621571627409915 * stddev_samp(accuracy) / sqrt(10), 4) AS high FROM f")
def m15_folds(spark, d):
    folds = views.events(spark, d).groupBy((F.col("event_id") % 10).alias("fold")).agg(F.avg((F.col("k") % 4 != 0).cast("int")).alias("accuracy"))
    return screening.mean_intervals(folds, "accuracy")


@query("n05_class_weights", f"WITH {EV}, c AS (SELECT et AS event_type, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, n, round(1.0 / n / (SELECT avg(1.0 / n) FROM c), 4) AS weight FROM c")
def n05(spark, d):
    return modelling.class_weights(views.events(spark, d), "event_type")


@query("n07_stratified_folds", f"WITH {EV} SELECT event_id, (row_number() OVER (PARTITION BY et, user_id % 2 ORDER BY event_id) - 1) % 10 AS fold FROM ev")
def n07(spark, d):
    e = views.events(spark, d).withColumn("device", F.col("user_id") % 2)
    return modelling.folds(e, ["event_type", "device"], 10, "event_id").select("event_id", "fold")


@query("n06_upsampled_cells", f"WITH {EV}, c AS (SELECT et, user_id % 2 AS device, count(*) AS n FROM ev GROUP BY 1, 2) SELECT et AS event_type, device, (SELECT max(n) FROM c) AS n FROM c")
def n06(spark, d):
    e = views.events(spark, d).withColumn("device", F.col("user_id") % 2)
    return modelling.upsampled(e, ["event_type", "device"], "event_id").groupBy("event_type", "device").agg(F.count("*").alias("n"))


IMPORTANCE = "im AS (SELECT CAST(user_id AS VARCHAR) AS feature, CAST(sum(k) AS DOUBLE) AS importance FROM ev GROUP BY 1)"


def _importances(spark, d):
    return views.events(spark, d).groupBy(F.col("participantid").alias("feature")).agg(F.sum("k").cast("double").alias("importance"))


@query("f12_running_share", f"WITH {EV}, {IMPORTANCE} SELECT feature, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / (SELECT sum(importance) FROM im), 4) AS share FROM im")
def f12(spark, d):
    return modelling.elbow(_importances(spark, d), 2.0).select("feature", "share")


@query("n12_elbow", f"WITH {EV}, {IMPORTANCE}, s AS (SELECT *, row_number() OVER w AS place, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / (SELECT sum(importance) FROM im) AS share FROM im WINDOW w AS (ORDER BY importance DESC, feature)) SELECT feature, importance, place, round(share, 4) AS share FROM s WHERE place <= 10 OR share - importance / (SELECT sum(importance) FROM im) < 0.6 - 1e-12")
def n12(spark, d):
    return modelling.elbow(_importances(spark, d), 0.6)


@query("n13_average_importance", f"WITH {EV} SELECT participantid AS feature, round(sum(k) / 5.0, 4) AS importance FROM ev GROUP BY 1")
def n13(spark, d):
    return modelling.average_importance(views.events(spark, d).select(F.col("participantid").alias("feature"), F.col("k").alias("importance")), 5)


def _matrix(spark, d, gaps=True):
    """A participants' matrix with device and class. With `gaps` differences end at days without known values, as in MATRIX."""
    days = day_values(spark, d).where("participantid is not null")
    f = secondary.participant_features(days, ["total", "level", "n"], [], gaps=gaps)
    numbers = [c for c in f.columns if c.rsplit("_", 1)[-1] in ("mean", "median", "sd", "iqr", "rmssd")]
    uid = F.col("participantid").cast("long")
    return f.select("participantid", *numbers, F.when(uid % 2 == 0, "android").otherwise("ios").alias("device_type"), F.when(F.col("total_mean") > 90, "high").when(F.col("level_mean") > 50, "mid").otherwise("low").alias("outcome")), numbers


_NUMBERS = ("mean", "median", "sd", "iqr", "rmssd", "above_median", "below_median")
#: The matrix in long form, with device and class, and Huber's estimate by repeated means of clipped values.
MATRIX = f"""{LONG}, {STATS}, w AS (SELECT * FROM q JOIN r USING (participantid, feature) JOIN m USING (participantid, feature)),
mo AS (SELECT participantid, CASE WHEN CAST(participantid AS BIGINT) % 2 = 0 THEN 'android' ELSE 'ios' END AS device_type, CASE WHEN max(mean) FILTER (feature = 'total') > 90 THEN 'high' WHEN max(mean) FILTER (feature = 'level') > 50 THEN 'mid' ELSE 'low' END AS outcome FROM w GROUP BY 1),
mx AS (SELECT participantid, device_type, outcome, feature || '_' || stat AS feature, x FROM (UNPIVOT (SELECT participantid, feature, mean, median, sd, iqr, rmssd, CAST(above_median AS DOUBLE) AS above_median, CAST(below_median AS DOUBLE) AS below_median FROM w) ON mean, median, sd, iqr, rmssd, above_median, below_median INTO NAME stat VALUE x) JOIN mo USING (participantid))"""


def huber_sql(source: str) -> str:
    return f"""hm AS (SELECT device_type, feature, quantile_cont(x, 0.5) AS mid, count(*) AS n FROM {source} GROUP BY 1, 2),
hs AS (SELECT device_type, feature, mid, n, 1.4826 * quantile_cont(abs(x - mid), 0.5) AS mad FROM {source} JOIN hm USING (device_type, feature) GROUP BY 1, 2, 3, 4),
hi AS (SELECT device_type, feature, 0 AS i, mid AS mu, n < 5 OR mad = 0 AS done FROM hs UNION ALL
  SELECT device_type, feature, i + 1, avg(greatest(mu - 1.5 * mad, least(mu + 1.5 * mad, x))), abs(avg(greatest(mu - 1.5 * mad, least(mu + 1.5 * mad, x))) - mu) < 1e-6 * mad FROM hi JOIN hs USING (device_type, feature) JOIN {source} USING (device_type, feature) WHERE NOT done GROUP BY device_type, feature, i, mu, mad),
hp AS (SELECT device_type, feature, arg_max(mu, i) AS mu, CASE WHEN n < 5 OR mad = 0 THEN mad + 1e-8 ELSE mad END AS s FROM hi JOIN hs USING (device_type, feature) GROUP BY device_type, feature, n, mad)"""


@query("n01_huber", f"WITH RECURSIVE {MATRIX}, {huber_sql('mx')} SELECT device_type, feature, round(mu, 4) AS mu, round(s, 4) AS s FROM hp")
def n01(spark, d):
    m, columns = _matrix(spark, d)
    return modelling.fit_huber(m, columns)


_WIDE = ", ".join(f"round(max(z) FILTER (feature = '{f}_{n}'), 4) AS {f}_{n}" for f in ("total", "level", "n") for n in _NUMBERS)
_SCORE = "greatest(-3, least(3, (x - mu) / s))"


@query("n02_winsorized", f"WITH RECURSIVE {MATRIX}, {huber_sql('mx')}, zs AS (SELECT participantid, feature, {_SCORE} AS z FROM mx JOIN hp USING (device_type, feature)) SELECT participantid, {_WIDE} FROM zs GROUP BY 1")
def n02(spark, d):
    m, columns = _matrix(spark, d)
    return modelling.winsorized(m, modelling.fit_huber(m, columns), columns).select("participantid", *columns)


@query("n04_imputed_medians", f"WITH {EV}, m AS (SELECT quantile_cont(value, 0.5) AS m FROM ev WHERE k % 3 <> 0) SELECT event_id, round(CASE WHEN k % 3 <> 0 THEN value ELSE m END, 4) AS v FROM ev, m")
def n04(spark, d):
    e = views.events(spark, d).select("event_id", F.when(F.col("k") % 3 != 0, F.col("value")).alias("v"))
    return modelling.imputed(e, modelling.fit_medians(e, ["v"]))


def _tuned(family):
    return lambda spark, d: grids.tuned(*_matrix(spark, d, gaps=False), family).select("fold", "participantid", "actual", "predicted")


query("n08_elastic_net")(_tuned("elastic net"))
query("n09_random_forest")(_tuned("forest"))
query("n10_two_stage_forest")(_tuned("pruned forest"))
query("n11_boosting")(_tuned("boosting"))
query("n11_pruned_boosting")(_tuned("pruned boosting"))


@query(
    "n03_fold_preparation",
    f"""WITH RECURSIVE {MATRIX}, fo AS (SELECT participantid, (row_number() OVER (PARTITION BY outcome, device_type ORDER BY participantid) - 1) % 2 AS fold FROM mo),
tr AS (SELECT mx.* FROM mx JOIN fo USING (participantid) WHERE fold = 0), {huber_sql('tr')},
sc AS (SELECT participantid, fold, device_type, f.feature, {_SCORE} AS z FROM (SELECT participantid, fold, device_type FROM mo JOIN fo USING (participantid)) p JOIN hp f USING (device_type) LEFT JOIN mx USING (participantid, device_type, feature)),
me AS (SELECT feature, coalesce(quantile_cont(z, 0.5), 0) AS m FROM sc WHERE fold = 0 GROUP BY 1),
zs AS (SELECT participantid, feature, coalesce(z, m) AS z FROM sc JOIN me USING (feature) WHERE fold = 1) SELECT participantid, {_WIDE} FROM zs GROUP BY 1""",
)
def n03(spark, d):
    m, columns = _matrix(spark, d)
    parts = modelling.folds(m, ["outcome", "device_type"], 2)
    ready = modelling.prepare(parts.where("fold = 0").drop("fold"), parts.where("fold = 1").drop("fold"), columns)
    return ready.test.select("participantid", *ready.columns)


@query("h07_feature_overlap", f"WITH {EV}, {SETS} SELECT member FROM sets GROUP BY 1 HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM sets)")
def h07(spark, d):
    s = _sets(spark, d)
    n = s.agg(F.count_distinct("name").alias("n"))
    return s.groupBy("member").agg(F.count_distinct("name").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("member")
