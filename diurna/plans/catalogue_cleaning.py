"""Queries on values, cleaning and merging."""

from __future__ import annotations

from .catalogue import *  # noqa: F403
from .catalogue import (
    DAILY_ACC, DAILY_CALLS, DAILY_SCREEN, DAYVAL, EV, GPS, LOC, NIGHT, PARTS, POINTS, SCREEN, SEG, STAMP, F, Window,
    daily, daily_calls, daily_motion, daily_screen, day_values, geo, gps, intervals, merging, mobility, motion, nights, points, query, readers, segments, sequences, sleep, times, values, views,
)
from .catalogue_events import ANDROID_CALLS


@query("c01_projection", f"WITH {EV} SELECT event_id AS id, et AS kind FROM ev")
def c01(spark, d):
    return views.events(spark, d).withColumnRenamed("event_id", "id").select("id", F.col("event_type").alias("kind")).drop("nothing")


@query("c02_screen_labels", f"WITH {EV} SELECT event_id, CASE WHEN et = 'view' THEN 'unlocked' WHEN et = 'click' THEN 'locked' ELSE et END AS label FROM ev")
def c02(spark, d):
    raw = F.when(F.col("event_type") == "view", "Screen_ON").when(F.col("event_type") == "click", "SCREEN_OFF").otherwise(F.upper("event_type"))
    return views.events(spark, d).select("event_id", values.screen_label(raw).alias("label"))


@query("c03_terminations", f"WITH {EV} SELECT event_id, 'CALL_DISCONNECTED' AS value0 FROM ev WHERE et = 'error'")
def c03(spark, d):
    return values.terminations(views.calls(spark, d), "CALL_DISCONNECTED").select("event_id", "value0")


@query("c04_on_off", f"WITH {EV} SELECT CASE WHEN et = 'view' THEN 'on' WHEN et = 'click' THEN 'off' ELSE 'unknown' END AS state, count(*) AS n FROM ev GROUP BY 1")
def c04(spark, d):
    raw = F.when(F.col("event_type") == "view", "UNLOCKED").when(F.col("event_type") == "click", "screen_off").when(F.col("event_type") == "error", "unlocked").otherwise(F.col("event_type"))
    return views.events(spark, d).groupBy(values.on_off(raw).alias("state")).agg(F.count("*").alias("n"))


@query("c05_plausible_axes", f"WITH {EV} SELECT event_id AS _id FROM ev WHERE value / 10 BETWEEN -20 AND 20 AND event_id % 9 <> 0")
def c05(spark, d):
    p = views.accelerometer(spark, d).withColumn("acc_x", F.when(F.col("_id") % 9 != 0, F.col("acc_x") * 10))
    return values.plausible_axes(p).select("_id")


@query("c06_units", f"WITH {EV} SELECT event_id AS _id, round(value / 100 / 9.81, 4) AS acc_x, round(k / 100 / 9.81, 4) AS acc_y FROM ev")
def c06(spark, d):
    return values.to_g(views.accelerometer(spark, d)).select("_id", "acc_x", "acc_y")


@query("c07_duration_limits", f"WITH {EV} SELECT count(*) FILTER (k * 600 > 0 AND k * 600 <= 36000) AS sessions, count(*) FILTER (k * 600 <= 10800) AS daily, count(*) FILTER (k * 600 < 43200) AS calls, count(*) FILTER (k * 600 BETWEEN 0 AND 43200) AS android_calls FROM ev")
def c07(spark, d):
    s = F.col("k") * 600
    t = values.T
    return views.events(spark, d).agg(F.count_if((s > 0) & (s <= t.max_session_s)).alias("sessions"), F.count_if(s <= t.max_daily_session_s).alias("daily"), F.count_if(s < t.max_call_s).alias("calls"), F.count_if(s.between(0, t.max_call_s)).alias("android_calls"))


@query("c09_text_times", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE {STAMP.format('ts')} END AS ts FROM ev")
def c09(spark, d):
    e = views.events(spark, d)
    plain, with_t = F.date_format("measuredat", "yyyy-MM-dd HH:mm:ss"), F.date_format("measuredat", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    m = F.col("event_id") % 4
    local = F.when(m == 0, plain).when(m == 1, with_t).otherwise("soon")
    utc = F.when(m == 2, plain).otherwise(F.lit(None).cast("string"))
    return e.select("event_id", times.text_or_fallback(local, utc).alias("ts"))


@query("c10_norm_range", f"WITH {POINTS} SELECT event_id AS _id FROM pts WHERE n BETWEEN 0 AND 20")
def c10(spark, d):
    return points(spark, d).where(F.col("euclidean_norm_g").between(0, motion.T.max_norm_g)).select("_id")


PARSED = "CASE WHEN event_id % 5 = 0 THEN '44 | -63 | 1' WHEN event_id % 5 = 1 THEN 'None' WHEN event_id % 5 = 2 THEN '95.5 | 10.0' WHEN event_id % 5 = 3 THEN 'at 12.5 | -7.25 now' ELSE packed END"


def _packed(spark, d):
    m = F.col("_id") % 5
    text = F.when(m == 0, "44 | -63 | 1").when(m == 1, "None").when(m == 2, "95.5 | 10.0").when(m == 3, "at 12.5 | -7.25 now").otherwise(F.col("location_decrypted"))
    return views.location(spark, d).withColumn("location_decrypted", text)


@query("c11_usable_coordinates", f"WITH {EV}, {LOC} SELECT event_id AS _id FROM loc WHERE event_id % 5 IN (2, 4)")
def c11(spark, d):
    return mobility.usable_points(_packed(spark, d)).select("_id")


@query("c12_unknown_zone", f"WITH {EV}, {LOC} SELECT CASE own_zone WHEN 'Unknown_Timezone' THEN 'UTC' ELSE own_zone END AS zone, count(*) AS n FROM loc GROUP BY 1")
@query("j03_effective_zone", f"WITH {EV}, {LOC} SELECT CASE own_zone WHEN 'Unknown_Timezone' THEN 'UTC' ELSE own_zone END AS zone, count(*) AS n FROM loc GROUP BY 1")
def c12(spark, d):
    return views.location(spark, d).groupBy(times.effective_zone(F.col("timezone_id")).alias("zone")).agg(F.count("*").alias("n"))


@query("c13_zero_if_missing", f"WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS k FROM ev")
def c13(spark, d):
    e = views.events(spark, d).select("event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k"))
    return values.zero_if_missing(e, ["k"])


@query("c14_conditional_zero", f"WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 0 END ELSE k END AS part, CASE WHEN event_id % 2 = 0 THEN value END AS total FROM ev")
def c14(spark, d):
    e = views.events(spark, d).select("event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("part"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("total"))
    return values.zero_if_observed(e, ["part"], "total")


@query("c15_caps", f"WITH {EV} SELECT event_id, CASE WHEN value * 10000 <= 2000000 THEN round(value * 10000, 4) END AS total_haversine_meters FROM ev")
def c15(spark, d):
    e = views.events(spark, d).select("event_id", (F.col("value") * 10000).alias("total_haversine_meters"))
    return values.capped(e, values.CAPS["gps", "ios"])


@query("c16_complete_rows", f"WITH {EV} SELECT event_id FROM ev WHERE k % 3 <> 0 AND et <> 'error'")
def c16(spark, d):
    e = views.events(spark, d).select("event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("t"), F.lit(None).cast("int").alias("score"))
    return values.complete(e, ["score"]).select("event_id")


@query("c17_sparse_columns", f"WITH {EV} SELECT event_id, round(value, 4) AS value, round(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END / 3, 4) AS share FROM ev")
def c17(spark, d):
    e = views.events(spark, d).select("event_id", "value", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k"))
    kept = values.without_sparse_columns(e)  # k is missing in a third of the rows
    return e.select(*kept.columns, values.missing_share(e).alias("share"))


@query("c18_known_keys", f"WITH {EV} SELECT event_id FROM ev WHERE user_id % 7 <> 0")
def c18(spark, d):
    return views.events(spark, d).withColumn("key", F.when(F.col("user_id") % 7 != 0, F.col("participantid"))).where(F.col("key").isNotNull()).select("event_id")


SCORES = "sc AS (SELECT DISTINCT participantid, user_id FROM ev)"
_CUT = {"emo_symptoms": (3, 5), "hyperactivity": (5, 7), "conduct_probs": (2, 3), "peer_probs": (2, 3)}


def _category(i: int, name: str, j: int, when: str) -> str:
    x = f"((user_id * {2 * i + 3} + {7 * j}) % 11)"
    if name == "prosocial":
        return f"CASE WHEN {x} >= 7 THEN 'normal' WHEN {x} = 6 THEN 'borderline' ELSE 'abnormal' END AS {name}_{when}_cat"
    a, b = _CUT[name]
    return f"CASE WHEN {x} <= {a} THEN 'normal' WHEN {x} <= {b} THEN 'borderline' ELSE 'abnormal' END AS {name}_{when}_cat"


@query("c19_cutoffs", f"WITH {EV}, {SCORES} SELECT participantid, {', '.join(_category(i, n, j, w) for j, w in enumerate(('baseline', 'followup')) for i, n in enumerate(values.CUTOFFS))} FROM sc")
def c19(spark, d):
    s = views.scores(spark, d)
    return s.select("participantid", *(values.category(n, F.col(f"{n}_{w}")).alias(f"{n}_{w}_cat") for w in ("baseline", "followup") for n in values.CUTOFFS))


DEVICE = "dev AS (SELECT DISTINCT participantid, user_id FROM ev)"


@query("c20_device_overrides", f"WITH {EV}, {DEVICE} SELECT participantid, CASE WHEN participantid = '3' THEN 'android' WHEN user_id % 2 = 0 AND user_id % 50 <> 0 THEN 'android' ELSE 'ios' END AS device_type FROM dev")
def c20(spark, d):
    dev = views.device(spark, d)
    fixed = spark.range(1).select(F.lit("3").alias("participantid"), F.lit("android").alias("device_type"))
    return merging.device_types(dev, dev.where("device_type = 'android'"), dev.where("device_type = 'ios'"), fixed)


@query("c21_strict_coordinates", f"WITH {EV}, {LOC}, t AS (SELECT event_id, {PARSED} AS p FROM loc) SELECT event_id AS _id, round(CASE WHEN regexp_full_match(trim(split_part(p, '|', 1)), '[+-]?[0-9]+\\.[0-9]+') THEN TRY_CAST(trim(split_part(p, '|', 1)) AS DOUBLE) END, 4) AS lat, round(CASE WHEN regexp_full_match(trim(split_part(p, '|', 2)), '[+-]?[0-9]+\\.[0-9]+') THEN TRY_CAST(trim(split_part(p, '|', 2)) AS DOUBLE) END, 4) AS lon FROM t")
def c21(spark, d):
    p = F.col("location_decrypted")
    return _packed(spark, d).select("_id", geo.strict_coordinate(p, 0).alias("lat"), geo.strict_coordinate(p, 1).alias("lon"))


@query("c22_lenient_coordinates", f"WITH {EV}, {LOC} SELECT event_id AS _id, CASE event_id % 5 WHEN 0 THEN 44.0 WHEN 3 THEN 12.5 WHEN 4 THEN round(44 + value / 100, 4) END::DOUBLE AS lat, CASE event_id % 5 WHEN 0 THEN -63.0 WHEN 3 THEN -7.25 WHEN 4 THEN round(-63 + k / 100, 4) END::DOUBLE AS lon FROM loc")
def c22(spark, d):
    return _packed(spark, d).select("_id", geo.lenient_coordinates(F.col("location_decrypted")).alias("c")).select("_id", "c.lat", "c.lon")


@query("c23_spaced_coordinates", f"WITH {EV}, {LOC}, t AS (SELECT event_id, {PARSED} AS p FROM loc) SELECT event_id AS _id, round(TRY_CAST(split_part(p, ' | ', 1) AS DOUBLE), 4) AS lat, round(TRY_CAST(CASE event_id % 5 WHEN 1 THEN NULL ELSE split_part(p, ' | ', 2) END AS DOUBLE), 4) AS lon FROM t")
def c23(spark, d):
    p = F.col("location_decrypted")
    return _packed(spark, d).select("_id", geo.spaced_coordinate(p, 0).alias("lat"), geo.spaced_coordinate(p, 1).alias("lon"))


@query("d04_batch_join", f"WITH {EV} SELECT event_id FROM ev WHERE user_id < 20")
def d04(spark, d):
    batch = spark.range(20).select(F.col("id").cast("string").alias("participantid"))
    return views.events(spark, d).join(batch, "participantid").select("event_id")


DAYS5 = f"""{EV}, da AS (SELECT participantid, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS total FROM ev WHERE event_id % 5 <> 0 GROUP BY 1, 2),
db AS (SELECT participantid, CAST(ts AS DATE) AS d, max(k) AS top FROM ev WHERE event_id % 3 = 0 GROUP BY 1, 2)"""


def _two_domains(spark, d):
    e = views.events(spark, d).withColumn("date_local", F.to_date("measuredat"))
    a = e.where("event_id % 5 <> 0").groupBy("participantid", "date_local").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return {"gps": a, "screen": e.where("event_id % 3 = 0").groupBy("participantid", "date_local").agg(F.max("k").alias("top"))}


@query("d05_daily_merge", f"WITH {DAYS5} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, n AS gps_n, round(total, 4) AS gps_total, top AS screen_top FROM da FULL JOIN db USING (participantid, d)")
@query("i12_prefixed_columns", f"WITH {DAYS5} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, n AS gps_n, round(total, 4) AS gps_total, top AS screen_top FROM da FULL JOIN db USING (participantid, d)")
def d05(spark, d):
    return merging.merge_days(_two_domains(spark, d))


@query("d06_scores_join", f"WITH {EV}, u AS (SELECT DISTINCT participantid, user_id FROM ev) SELECT participantid, CASE WHEN user_id % 4 <> 0 THEN (user_id * 3) % 11 END AS emo_symptoms_baseline FROM u")
def d06(spark, d):
    s = views.scores(spark, d).where("cast(participantid as int) % 4 <> 0").select(F.upper("participantid").alias("participantid"), "emo_symptoms_baseline")
    return merging.with_scores(views.events(spark, d).select("participantid").distinct(), s)


@query("d07_platform_exclusion", f"WITH {EV} SELECT event_id FROM ev WHERE user_id % 50 <> 0")
def d07(spark, d):
    dev = views.device(spark, d)
    both = merging.on_both_platforms(dev.where("device_type = 'android'"), dev.where("device_type = 'ios'"))
    return merging.without(views.events(spark, d), both).select("event_id")


@query("h03_on_both_platforms", f"WITH {EV} SELECT DISTINCT participantid FROM ev WHERE user_id % 50 = 0")
def h03(spark, d):
    dev = views.device(spark, d)
    return merging.on_both_platforms(dev.where("device_type = 'android'"), dev.where("device_type = 'ios'"))


DAYS = "dd AS (SELECT DISTINCT participantid, CAST(ts AS DATE) AS d FROM ev)"


def _days(spark, d):
    return views.events(spark, d).select("participantid", F.to_date("measuredat").alias("date_local")).distinct()


@query("d08_min_days", f"WITH {EV}, {DAYS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local FROM dd WHERE participantid IN (SELECT participantid FROM dd GROUP BY 1 HAVING count(DISTINCT d) >= 27)")
def d08(spark, d):
    return merging.with_enough_days(_days(spark, d), 27)


@query("e11_days_per_participant", f"WITH {EV}, {DAYS} SELECT participantid, count(DISTINCT d) AS n FROM dd GROUP BY 1 HAVING count(DISTINCT d) >= 5")
def e11(spark, d):
    return _days(spark, d).groupBy("participantid").agg(F.count_distinct("date_local").alias("n")).where("n >= 5")


@query("e12_duplicate_days", f"WITH {EV} SELECT participantid, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date_local, count(*) AS n FROM ev GROUP BY participantid, CAST(ts AS DATE) HAVING count(*) > 1")
def e12(spark, d):
    return merging.duplicate_days(views.events(spark, d).withColumn("date_local", F.to_date("measuredat")))


@query("e14_descriptive", f"WITH {EV} SELECT et AS event_type, count(*) AS n, count(*) FILTER (k % 3 = 0) AS thirds, count(*) FILTER (value < 0) AS negative, round(avg(value), 4) AS mean FROM ev GROUP BY 1")
def e14(spark, d):
    return views.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k") % 3 == 0).alias("thirds"), F.count_if(F.col("value") < 0).alias("negative"), F.avg("value").alias("mean"))


@query("e16_crosstab", f"WITH {EV} SELECT et AS event_type, user_id % 2 AS device, count(*) AS n FROM ev GROUP BY 1, 2")
def e16(spark, d):
    return views.events(spark, d).groupBy("event_type", (F.col("user_id") % 2).alias("device")).agg(F.count("*").alias("n"))


@query("e17_missing_counts", f"WITH {EV} SELECT CAST(0 AS BIGINT) AS event_id, count(*) FILTER (k % 3 = 0) AS k FROM ev")
def e17(spark, d):
    return values.missing_counts(views.events(spark, d).select("event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k")))


@query("e18_distinct_rows", f"WITH {EV} SELECT DISTINCT participantid, et AS event_type FROM ev")
def e18(spark, d):
    return views.events(spark, d).select("participantid", "event_type").dropDuplicates()


@query("f08_row_number_dedup", f"WITH {EV} SELECT participantid, et AS event_type, max(event_id) AS event_id FROM ev GROUP BY 1, 2")
def f08(spark, d):
    from ..sources import sinks

    return sinks.one_per_key(views.events(spark, d).select("participantid", "event_type", "event_id"), ["participantid", "event_type"])


@query("f03_first_difference", f"WITH {EV} SELECT event_id AS _id, round(value / 100 - lag(value / 100) OVER (PARTITION BY participantid ORDER BY ts, event_id), 4) AS dx FROM ev")
def f03(spark, d):
    w = Window.partitionBy("participantid").orderBy("measuredat", "_id")
    return views.accelerometer(spark, d).select("_id", (F.col("acc_x") - F.lag("acc_x").over(w)).alias("dx"))


@query("f09_batch_numbers", f"WITH {EV}, p AS (SELECT DISTINCT participantid FROM ev) SELECT participantid, (row_number() OVER (ORDER BY participantid) - 1) // 10 + 1 AS batch FROM p")
def f09(spark, d):
    return readers.batch_numbers(views.events(spark, d), 10)


@query("g03_ordered_days", f"WITH {EV}, {DAYS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local FROM dd")
def g03(spark, d):
    return _days(spark, d).orderBy("participantid", "date_local")


@query("g04_top_features", f"WITH {EV} SELECT et AS event_type, round(sum(value), 2) AS total FROM ev GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def g04(spark, d):
    return views.events(spark, d).groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total")).orderBy(F.col("total").desc()).limit(3)


@query("h01_union_sources", f"WITH {EV} SELECT event_id, et AS value0 FROM ev WHERE et IN ('view', 'error')")
def h01(spark, d):
    e = views.events(spark, d).select("event_id", F.col("event_type").alias("value0"))
    return e.where("value0 = 'view'").unionByName(e.where("value0 = 'error'"))


@query("h02_platform_rows", f"WITH {EV} SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'android' ELSE 'ios' END AS device_type FROM ev")
def h02(spark, d):
    e = views.events(spark, d).select("event_id", "user_id")
    return merging.of_both(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")).drop("user_id")


@query("h04_set_difference", f"WITH {EV} SELECT DISTINCT participantid FROM ev WHERE user_id % 2 = 1 EXCEPT SELECT participantid FROM ev WHERE user_id % 3 = 0")
def h04(spark, d):
    e = views.events(spark, d)
    return e.where("user_id % 2 = 1").select("participantid").subtract(e.where("user_id % 3 = 0").select("participantid"))


@query("h05_folded_sets", f"WITH {EV}, s AS (SELECT DISTINCT participantid, et FROM ev) SELECT participantid, count(*) AS n FROM s GROUP BY 1")
def h05(spark, d):
    sets = views.events(spark, d).groupBy("participantid").agg(F.collect_set("event_type").alias("s"))
    folded = F.aggregate(F.array("s", "s"), F.array().cast("array<string>"), lambda acc, x: F.array_union(acc, x))
    return sets.select("participantid", F.size(folded).alias("n"))


@query("i01_text_functions", f"""WITH {EV} SELECT event_id, upper(et) AS up, lower(upper(et)) AS low, contains(et, 'e') AS has_e, et LIKE '%i%' AS has_i, regexp_replace(et || ' ' || participantid, '[^a-zA-Z0-9]', '_', 'g') AS name,
  replace('2024-01-01T00', 'T', ' ') AS spaced, concat_ws('_', CAST(round(value, 1) AS VARCHAR), participantid) AS joined, trim(split_part('a | ' || et, '|', 2)) AS part, coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE et END, 'none') AS filled FROM ev""")
def i01(spark, d):
    t, p = F.col("event_type"), F.col("participantid")
    return views.events(spark, d).select(
        "event_id", F.upper(t).alias("up"), F.lower(F.upper(t)).alias("low"), t.contains("e").alias("has_e"), t.like("%i%").alias("has_i"), F.regexp_replace(F.concat(t, F.lit(" "), p), "[^a-zA-Z0-9]", "_").alias("name"),
        F.replace(F.lit("2024-01-01T00"), F.lit("T"), F.lit(" ")).alias("spaced"), F.concat_ws("_", F.round("value", 1).cast("string"), p).alias("joined"), F.trim(F.get(F.split(F.concat(F.lit("a | "), t), r"\|"), F.lit(1))).alias("part"),
        F.coalesce(F.when(F.col("k") % 3 != 0, t), F.lit("none")).alias("filled"),
    )


@query("j01_timestamp_forms", f"WITH {EV} SELECT event_id, {STAMP.format('ts')} AS ts FROM ev")
def j01(spark, d):
    m = F.col("event_id") % 3
    text = F.when(m == 0, F.date_format("measuredat", "yyyy-MM-dd HH:mm:ss.SSS")).when(m == 1, F.date_format("measuredat", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("measuredat", "yyyy-MM-dd'T'HH:mm:ss"))
    return views.events(spark, d).select("event_id", times.parse_timestamp(text).alias("ts"))


@query("j07_weekdays", f"WITH {EV} SELECT dayname(ts) AS weekday, count(*) AS n FROM ev GROUP BY 1")
def j07(spark, d):
    return views.events(spark, d).groupBy(times.weekday(F.to_date("measuredat")).alias("weekday")).agg(F.count("*").alias("n"))


@query("j08_shifted_days", f"WITH {EV} SELECT strftime(CAST(ts - INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS day, strftime(CASE WHEN hour(ts) >= 22 THEN CAST(ts AS DATE) ELSE CAST(ts - INTERVAL 1 DAY AS DATE) END, '%Y-%m-%d') AS night, count(*) AS n FROM ev GROUP BY 1, 2")
def j08(spark, d):
    return views.events(spark, d).groupBy(times.sensing_date(F.col("measuredat")).alias("day"), times.night_date(F.col("measuredat")).alias("night")).agg(F.count("*").alias("n"))


@query("j11_epoch_differences", f"WITH {EV} SELECT event_id, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS seconds, hour(ts) AS hour, {STAMP.format("date_trunc('minute', ts)")} AS minute FROM ev")
def j11(spark, d):
    return views.events(spark, d).select("event_id", (F.unix_timestamp("measuredat") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("seconds"), F.hour("measuredat").alias("hour"), F.date_trunc("minute", "measuredat").alias("minute"))


@query("k01_norms", f"WITH {EV} SELECT event_id AS _id, round(sqrt(value / 100 * value / 100 + k / 100 * k / 100), 4) AS norm FROM ev")
def k01(spark, d):
    return views.accelerometer(spark, d).select("_id", motion.norm((F.col("acc_x"), F.col("acc_y"))).alias("norm"))


@query("k04_flags", f"WITH {POINTS} SELECT count(*) FILTER (n >= 0.4) AS vigorous, count(*) FILTER (n < 0.4) AS non_vigorous FROM pts")
def k04(spark, d):
    return points(spark, d).agg(F.sum("vigorous_pa").alias("vigorous"), F.sum("non_vigorous_pa").alias("non_vigorous"))


@query("k06_bounds", f"WITH {EV} SELECT event_id, greatest(k, 50) AS hi, least(k, 50) AS lo, round(ln(value + 1), 4) AS ln, round(abs(value - 100), 4) AS away, k * 60 AS seconds FROM ev")
def k06(spark, d):
    return views.events(spark, d).select("event_id", F.greatest("k", F.lit(50)).alias("hi"), F.least("k", F.lit(50)).alias("lo"), F.ln(F.col("value") + 1).alias("ln"), F.abs(F.col("value") - 100).alias("away"), (F.col("k") * 60).alias("seconds"))


PEOPLE = 12
#: The events of all users dealt to PEOPLE participants. Even ones are on android, odd ones on iOS, the first on both.
EV12 = EV.replace("user_id, CAST(user_id AS VARCHAR)", f"user_id % {PEOPLE} AS user_id, CAST(user_id % {PEOPLE} AS VARCHAR)")
MERGED = f"""{DAILY_CALLS.replace(EV, EV12)}, {', '.join(x for x in [GPS[GPS.index('gp AS'):], NIGHT[NIGHT.index('se AS'):], DAILY_SCREEN[DAILY_SCREEN.index('ahead AS'):], DAILY_ACC[DAILY_ACC.index('ax AS'):]])}"""


@query(
    "o11_clean_days",
    f"""WITH {MERGED.replace('cv AS (SELECT', SCREEN + ', cv AS (SELECT', 1)}, {ANDROID_CALLS[ANDROID_CALLS.index('ar AS'):]},
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY participantid, d ORDER BY total_haversine_meters DESC NULLS LAST, du DESC) AS best FROM dgps) WHERE best = 1),
call2 AS (SELECT participantid, d, num_all_calls FROM dcall WHERE CAST(participantid AS INT) % 2 = 1 UNION ALL SELECT participantid, d, count(*) FROM ab WHERE CAST(participantid AS INT) % 2 = 0 GROUP BY 1, 2),
whole AS (SELECT participantid, d, CASE WHEN CAST(participantid AS INT) % 2 = 0 THEN 'android' ELSE 'ios' END AS device_type, g.total_haversine_meters, s.total_screen_time_in_seconds, c.num_all_calls, z.total_night_screen_minutes, a.total_active_seconds
  FROM g1 g JOIN dscreen s USING (participantid, d) JOIN call2 c USING (participantid, d) JOIN dsleep z USING (participantid, d) JOIN dacc a USING (participantid, d)
  WHERE participantid <> '0' AND g.var IS NOT NULL AND g.total_haversine_meters <= 2000000 AND s.afternoon_screen_time_in_seconds <= 21600 AND s.nighttime_screen_time_in_seconds <= 21600)
SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, device_type, total_haversine_meters AS gps_total_haversine_meters, total_screen_time_in_seconds AS screen_total_screen_time_in_seconds, num_all_calls AS call_num_all_calls,
  total_night_screen_minutes AS sleep_total_night_screen_minutes, total_active_seconds AS activity_total_active_seconds, (CAST(participantid AS BIGINT) * 3) % 11 AS emo_symptoms_baseline
FROM whole WHERE participantid IN (SELECT participantid FROM whole GROUP BY 1 HAVING count(*) >= 5)""",
)
def o11(spark, d):
    d = views.Study(d, PEOPLE)
    number = F.col("participantid").cast("int")
    on = {"android": number % 2 == 0, "ios": (number % 2 == 1) | (number == 0)}
    # daily tables, which several branches read, are small beside the events they are made from
    made = {name: d.once(name, lambda f=f: f(spark, d)) for name, f in (("screen", daily_screen), ("activity", daily_motion), ("call", daily_calls))}
    android, ios = ({name: df.where(who) for name, df in made.items()} for who in on.values())
    android["call"] = daily.daily_calls_android(views.calls_android(spark, d).where(on["android"]))
    days = merging.prepared_days(gps(spark, d), sleep.nightly(nights(spark, d)), android, ios, views.scores(spark, d))
    return days.select("participantid", "date_local", "device_type", "gps_total_haversine_meters", "screen_total_screen_time_in_seconds", "call_num_all_calls", "sleep_total_night_screen_minutes", "activity_total_active_seconds", "emo_symptoms_baseline")
