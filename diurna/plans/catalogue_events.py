"""Queries on events, intervals, sessions and daily features."""

from __future__ import annotations

import uuid

from .. import config
from .catalogue import *  # noqa: F403
from .catalogue import (
    CALLS, DAILY_ACC, DAILY_CALLS, DAILY_SCREEN, DAY6, EV, GPS, LOC, LOCAL, NIGHT, PARTS, POINTS, SCREEN, SEG, SESSIONS, STAMP, STEPS, COUNTS, PAIRS, F, Window,
    calls, daily, daily_calls, daily_motion, daily_screen, enrichment, geo, gps, intervals, mobility, motion, nights, points, query, readers, segments, sequences, sessions, sinks, sleep, times, values, views, zoned,
)


@query("a01_event_data", f"WITH {EV}, {SCREEN} SELECT participantid, {STAMP.format('ts')} AS measuredat, v AS value0 FROM screen")
def a01(spark, d):
    return readers.read_event_data(views.screen(spark, d))


@query("a02_timezone_data", f"WITH {EV}, {LOC}, {SEG} SELECT participantid, timezone_id, {STAMP.format('start_time')} AS start_time, {STAMP.format('end_time')} AS end_time FROM seg")
def a02(spark, d):
    return readers.read_timezone_data(segments(spark, d))


@query("a03_accelerometer_data", f"WITH {EV} SELECT event_id AS _id, participantid, {STAMP.format('ts')} AS measuredat, round(value / 100, 4) AS acc_x, round(k / 100, 4) AS acc_y, round((event_id % 7) / 7, 4) AS acc_z FROM ev")
def a03(spark, d):
    raw = views.accelerometer(spark, d)
    return readers.read_accelerometer_data(raw.select("_id", "participantid", F.date_format("measuredat", "yyyy-MM-dd HH:mm:ss").alias("measuredat"), *(F.col(f"acc_{c}").cast("string").alias(f"value{i}") for i, c in enumerate("xyz"))))


@query("a04_location_data", f"WITH {EV}, {LOC} SELECT event_id AS _id, participantid, {STAMP.format('ts')} AS measuredat, {STAMP.format('ts')} AS uploadedat, '' AS value0, packed AS location_decrypted, own_zone AS timezone_id FROM loc")
def a04(spark, d):
    raw = views.location(spark, d)
    form = lambda c: F.when(F.col("_id") % 3 == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")).when(F.col("_id") % 3 == 1, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return readers.read_location_data(raw.withColumns({"measuredat": form("measuredat"), "uploadedat": form("measuredat"), "value0": F.lit("")}))


@query("a05_participant_batch", f"WITH {EV}, {SCREEN} SELECT event_id, participantid, v AS value0 FROM screen WHERE participantid IN ('1', '2', '3')")
def a05(spark, d):
    return readers.of_participants(views.screen(spark, d), ["1", "2", "3"]).select("event_id", "participantid", "value0")


@query("a06_distinct_participants", f"WITH {EV} SELECT DISTINCT participantid FROM ev")
def a06(spark, d):
    return readers.distinct_participants(views.events(spark, d))


@query("a08_sql_query", f"WITH {EV} SELECT et AS event_type, count(*) AS n FROM ev GROUP BY 1")
def a08(spark, d):
    return readers.query(spark, "SELECT event_type, count(*) AS n FROM {ev} GROUP BY event_type", ev=views.events(spark, d))


HALVES = "old AS (SELECT event_id AS id, value AS v FROM ev WHERE event_id % 3 <> 0), new AS (SELECT event_id AS id, value + 1000 AS v FROM ev WHERE event_id % 2 = 0)"


def _halves(spark, d):
    e = views.events(spark, d)
    return e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("value").alias("v")), e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") + 1000).alias("v"))


def _stored(spark, d, mode, keep=()):
    """What a dataset holds after the new rows are written to it."""
    old, new = _halves(spark, d)
    path = f"{sinks.scratch(spark)}/table"
    sinks.overwrite(old, path)
    if mode == "append":
        sinks.append(new, path)
    elif mode == "overwrite":
        sinks.overwrite(new, path)
    else:
        sinks.upsert(new, path, ["id"], mode, keep)
    return readers.table(spark, path)


@query("b02_upsert_merge", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, round(v, 4) FROM new")
def b02(spark, d):
    return _stored(spark, d, "update")


@query("b03_upsert_keeping_columns", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM old UNION ALL SELECT id, round(v, 4) FROM new WHERE id NOT IN (SELECT id FROM old)")
def b03(spark, d):
    return _stored(spark, d, "update", ("v",))


@query("b06_merge_ignore", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM old UNION ALL SELECT id, round(v, 4) FROM new WHERE id NOT IN (SELECT id FROM old)")
def b06(spark, d):
    return _stored(spark, d, "ignore")


@query("b01_append_rows", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM old UNION ALL SELECT id, round(v, 4) FROM new")
@query("b08_append", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM old UNION ALL SELECT id, round(v, 4) FROM new")
def b08(spark, d):
    return _stored(spark, d, "append")


@query("b04_replace_table", f"WITH {EV}, {HALVES} SELECT id, round(v, 4) AS v FROM new")
def b04(spark, d):
    return _stored(spark, d, "overwrite")


@query("a09_scores_file", f"WITH {EV}, u AS (SELECT DISTINCT participantid, user_id FROM ev) SELECT participantid AS redcap_survey_identifier, (user_id * 3) % 11 AS emo_symptoms_baseline, (user_id * 11 + 7) % 11 AS prosocial_followup FROM u")
@query("b09_file_of_text", f"WITH {EV}, u AS (SELECT DISTINCT participantid, user_id FROM ev) SELECT participantid AS redcap_survey_identifier, (user_id * 3) % 11 AS emo_symptoms_baseline, (user_id * 11 + 7) % 11 AS prosocial_followup FROM u")
def a09(spark, d):
    path = f"{sinks.scratch(spark)}/scores"
    sinks.write_csv(views.scores(spark, d).select(F.col("participantid").alias("redcap_survey_identifier"), *(f.name for f in readers.SCORES.fields[1:])), path)
    return readers.read_scores(spark, path).select("redcap_survey_identifier", "emo_symptoms_baseline", "prosocial_followup")


@query("a07_probes", "SELECT * FROM (VALUES ('events', TRUE, TRUE), ('orders', TRUE, FALSE), ('no_such_table', FALSE, FALSE)) v(name, there, has_users)")
def a07(spark, d):
    path = lambda name: f"{d}/{name}.parquet"
    rows = [(name, there, there and readers.has_column(readers.table(spark, path(name)), "user_id")) for name in ("events", "orders", "no_such_table") for there in [readers.exists(spark, path(name))]]
    return spark.createDataFrame(rows, "name string, there boolean, has_users boolean")


@query("a10_batches", f"WITH {EV}, n AS (SELECT count(DISTINCT participantid) AS n FROM ev) SELECT i AS batch, least(40, n - 40 * i) AS rows FROM n, range(0, 1000000) r(i) WHERE 40 * i < n")
def a10(spark, d):
    sizes = [(i, len(rows)) for i, rows in enumerate(readers.batches(readers.distinct_participants(views.events(spark, d)), 40))]
    return spark.createDataFrame(sizes, "batch long, rows long")


@query("a11_settings", "SELECT 'x/daily_gps/run_date=20240131' AS path, 'sensing' AS catalogue")
@query("j14_run_date", "SELECT 'x/daily_gps/run_date=20240131' AS path, 'sensing' AS catalogue")
def a11(spark, d):
    own = config.Settings(root="x", run_date="20240131")
    return spark.createDataFrame([(config.dataset_path(own, "daily_gps"), own.catalogue)], "path string, catalogue string")


@query("b05_table_of_a_schema", "SELECT * FROM (VALUES ('event_id', 'BIGINT', 0), ('user_id', 'BIGINT', 1), ('participantid', 'TEXT', 2), ('measuredat', 'TIMESTAMP', 3), ('event_type', 'TEXT', 4), ('value', 'DOUBLE PRECISION', 5), ('k', 'BIGINT', 6), ('added', 'NUMERIC(5,2)', 7)) v(name, kind, place)")
def b05(spark, d):
    name = f"made_{uuid.uuid4().hex}"
    sinks.create_table_if_not_exists(spark, name, sinks.with_column_added(views.events(spark, d), "added", "decimal(5,2)").schema)
    try:
        schema = spark.table(name).schema
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame([(f.name, sinks.sql_type(f.dataType), i) for i, f in enumerate(schema.fields)], "name string, kind string, place long")


@query("g05_sample_row", f"WITH {EV} SELECT event_id, participantid, et AS event_type FROM ev ORDER BY event_id LIMIT 1")
def g05(spark, d):
    return views.events(spark, d).orderBy("event_id").select("event_id", "participantid", "event_type").limit(1)


@query("b07_fill_missing", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN et ELSE 'kept' END AS label FROM ev")
def b07(spark, d):
    e = views.events(spark, d).withColumn("label", F.when(F.col("event_id") % 5 != 0, "kept"))
    return sinks.filled(e, "label", F.col("event_type")).select("event_id", "label")


@query("d01_timezone_match", f"WITH {EV}, {SCREEN}, {LOC}, {SEG}, {zoned('screen', 'm')} SELECT event_id, participantid, timezone_id FROM m")
def d01(spark, d):
    return intervals.best_zone(views.screen(spark, d), segments(spark, d), "event_id").select("event_id", "participantid", "timezone_id")


@query(
    "d02_nearest_interval",
    f"""WITH {EV}, {SCREEN}, {LOC}, {SEG}, j AS (SELECT x.event_id, x.participantid, s.timezone_id, s.start_time,
  CASE WHEN s.participantid IS NULL THEN NULL WHEN x.ts BETWEEN s.start_time AND s.end_time THEN -1 ELSE least(abs(epoch_us(x.ts) - epoch_us(s.start_time)), abs(epoch_us(x.ts) - epoch_us(s.end_time))) END AS away
  FROM screen x LEFT JOIN seg s ON s.participantid = x.participantid),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY away, start_time, timezone_id) AS best FROM j) SELECT event_id, participantid, timezone_id FROM r WHERE best = 1""",
)
def d02(spark, d):
    return intervals.nearest_zone(views.screen(spark, d), segments(spark, d), "event_id").select("event_id", "participantid", "timezone_id")


@query("o08_timezone_segments", f"WITH {EV}, {LOC}, {SEG} SELECT participantid, timezone_id, {STAMP.format('start_time')} AS start_time, {STAMP.format('end_time')} AS end_time FROM seg")
def o08(spark, d):
    return segments(spark, d)


TIMES_SQL = f"""SELECT participantid, coalesce(timezone_id, 'UTC') AS effective_timezone, timezone_id IS NULL AS used_utc_fallback, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_start_time_utc, strftime(nts, '%Y-%m-%dT%H:%M:%SZ') AS event_end_time_utc,
  strftime({LOCAL}, '%Y-%m-%dT%H:%M:%S') AS event_start_time_local, strftime((nts AT TIME ZONE 'UTC') AT TIME ZONE coalesce(timezone_id, 'UTC'), '%Y-%m-%dT%H:%M:%S') AS event_end_time_local,
  strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date_utc, strftime({DAY6.format(LOCAL)}, '%Y-%m-%d') AS date_local, dayname(CAST(ts AS DATE)) AS weekday_utc, dayname({DAY6.format(LOCAL)}) AS weekday_local, secs AS screen_on_time_in_secs FROM sess"""
TIME_COLUMNS = ["participantid", "effective_timezone", "used_utc_fallback", "event_start_time_utc", "event_end_time_utc", "event_start_time_local", "event_end_time_local", "date_utc", "date_local", "weekday_utc", "weekday_local", "screen_on_time_in_secs"]


@query("o01_screen_sessions", f"WITH {SESSIONS} {TIMES_SQL}")
@query("j04_event_times", f"WITH {SESSIONS} {TIMES_SQL}")
def o01(spark, d):
    return sessions(spark, d).select(*TIME_COLUMNS)


@query(
    "o02_screen_sessions_ios",
    f"WITH {EV}, screen AS (SELECT event_id, user_id, participantid, ts, CASE et WHEN 'view' THEN 'unlocked' WHEN 'click' THEN 'locked' ELSE 'app terminating' END AS v FROM ev WHERE et IN ('view', 'click', 'error')), {LOC}, {SEG}, {PAIRS}, {zoned('spans', 'sess')} {TIMES_SQL}",
)
def o02(spark, d):
    e = views.events(spark, d)
    lock = e.where(F.col("event_type").isin("view", "click")).withColumn("value0", F.when(F.col("event_type") == "view", "UNLOCKED").otherwise("LOCKED"))
    analytics = e.withColumn("value0", F.when(F.col("event_type") == "error", "App Terminating").otherwise("App running"))
    return sequences.screen_sessions_ios(lock, analytics, segments(spark, d)).select(*TIME_COLUMNS)


@query(
    "f01_lead_pairs",
    f"WITH {EV}, {SCREEN}, a AS (SELECT *, lead(v) OVER w AS nv, lead(ts) OVER w AS nts FROM screen WINDOW w AS (PARTITION BY participantid ORDER BY ts, v)) SELECT event_id, v AS value0, nv AS next_value0, {STAMP.format('nts')} AS next_measuredat FROM a",
)
def f01(spark, d):
    w = sequences.by_time()
    return views.screen(spark, d).select("event_id", "value0", F.lead("value0").over(w).alias("next_value0"), F.lead("measuredat").over(w).alias("next_measuredat"))


@query("o03_ios_calls", f"WITH {CALLS} SELECT participantid, {STAMP.format('ts')} AS call_start, {STAMP.format('call_end')} AS call_end, call_type, secs AS call_duration_in_secs FROM call")
def o03(spark, d):
    return calls(spark, d)[0].select("participantid", F.col("measuredat").alias("call_start"), F.col("next_measuredat").alias("call_end"), "call_type", "call_duration_in_secs")


@query("o03_call_anomalies", f"WITH {CALLS} SELECT participantid, {STAMP.format('ts')} AS call_start, {STAMP.format('t2')} AS call_connected, {STAMP.format('t3')} AS call_end, span3 AS anomaly_duration_secs FROM cb WHERE ans AND span3 >= 43200")
def o03_anomalies(spark, d):
    return calls(spark, d)[1].select("participantid", "call_start", "call_connected", "call_end", F.col("call_duration_in_secs").alias("anomaly_duration_secs"))


@query(
    "o04_ios_call_events",
    f"WITH {CALLS} SELECT participantid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_start_time_utc, strftime({LOCAL}, '%Y-%m-%dT%H:%M:%S') AS event_start_time_local, strftime({DAY6.format(LOCAL)}, '%Y-%m-%d') AS date_local, call_type, secs AS call_duration_in_secs FROM call",
)
def o04(spark, d):
    return calls(spark, d)[0].select("participantid", "event_start_time_utc", "event_start_time_local", "date_local", "call_type", "call_duration_in_secs")


CALL_NAMES = "num_all_calls, duration_all_calls_seconds, num_calls_made, duration_calls_made_seconds, num_calls_received, duration_calls_received_seconds, num_missed_calls, num_rejected_calls"


@query("e03_daily_calls_ios", f"WITH {DAILY_CALLS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, weekday_local, {CALL_NAMES} FROM dcall")
def e03(spark, d):
    return daily_calls(spark, d)


ANDROID_CALLS = f"""{EV},
ar AS (SELECT participantid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS v0, CASE WHEN event_id % 11 = 0 THEN 'abc' WHEN event_id % 13 = 0 THEN '' ELSE CAST(k * 500 AS VARCHAR) END AS v1,
  CASE et WHEN 'signup' THEN 'outgoing' WHEN 'view' THEN 'incoming' WHEN 'click' THEN 'missed' WHEN 'purchase' THEN 'rejected' ELSE et END AS v2 FROM ev),
ab AS (SELECT participantid, {DAY6.format('CAST(v0 AS TIMESTAMP)')} AS d, CASE v2 WHEN 'outgoing' THEN 'outgoing_call_answered' WHEN 'incoming' THEN 'incoming_call_answered' WHEN 'missed' THEN 'incoming_call_unanswered' WHEN 'rejected' THEN 'outgoing_call_unanswered' ELSE v2 END AS call_type,
  CASE WHEN v2 IN ('missed', 'rejected') THEN 0 ELSE TRY_CAST(v1 AS INTEGER) END AS secs FROM ar WHERE regexp_matches(v0, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND regexp_matches(v1, '^[0-9]+$') AND TRY_CAST(v1 AS INTEGER) BETWEEN 0 AND 43200)"""


@query("e02_daily_calls_android", f"WITH {ANDROID_CALLS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, dayname(d) AS weekday_local, {COUNTS} FROM ab GROUP BY participantid, d")
def e02(spark, d):
    return daily.daily_calls_android(views.calls_android(spark, d))


@query("c08_call_guards", f"WITH {ANDROID_CALLS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, call_type, CAST(secs AS BIGINT) AS seconds FROM ab")
def c08(spark, d):
    return daily.raw_android_calls(views.calls_android(spark, d))


@query("o05_accelerometer_points", f"WITH {POINTS} SELECT event_id AS _id, participantid, n AS euclidean_norm_g, step AS euclidean_distance_g, CAST(n < 0.4 AS BIGINT) AS non_vigorous_pa, CAST(n >= 0.4 AS BIGINT) AS vigorous_pa, {STAMP.format('ts')} AS measuredat_utc, {STAMP.format('lt')} AS measuredat_local FROM pts")
def o05(spark, d):
    return points(spark, d).select("_id", "participantid", "euclidean_norm_g", "euclidean_distance_g", "non_vigorous_pa", "vigorous_pa", "measuredat_utc", "measuredat_local")


ACC_NAMES = ", ".join(f"{n}_pa_seconds" for n, _, _ in PARTS)


@query(
    "e01_daily_accelerometer",
    f"WITH {DAILY_ACC} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, weekday_local, non_vigorous_pa_seconds, vigorous_pa_seconds, total_active_seconds, percentage_vigorous_active_daily, {ACC_NAMES}, CAST(CAST(CAST(avg_n AS DECIMAL(20, 12)) AS DECIMAL(10, 4)) AS DOUBLE) AS avg_euclidean_norm, CAST(CAST(CAST(max_n AS DECIMAL(20, 12)) AS DECIMAL(10, 4)) AS DOUBLE) AS max_euclidean_norm, CAST(CAST(CAST(sd_n AS DECIMAL(20, 12)) AS DECIMAL(10, 4)) AS DOUBLE) AS activity_variability FROM dacc",
)
def e01(spark, d):
    return daily_motion(spark, d)


SCREEN_NAMES = ", ".join(f"{n}_screen_time_in_seconds, num_of_events_{n}" for n, _, _ in PARTS)


@query("o10_daily_screen", f"WITH {DAILY_SCREEN} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, weekday_local, total_screen_time_in_seconds, num_of_events_total, {SCREEN_NAMES} FROM dscreen")
def o10(spark, d):
    return daily_screen(spark, d)


@query("e04_daily_screen_totals", f"WITH {DAILY_SCREEN} SELECT weekday_local, CAST(sum(total_screen_time_in_seconds) AS BIGINT) AS seconds, CAST(sum(num_of_events_total) AS BIGINT) AS sessions FROM dscreen GROUP BY 1")
def e04(spark, d):
    return daily_screen(spark, d).groupBy("weekday_local").agg(F.sum("total_screen_time_in_seconds").alias("seconds"), F.sum("num_of_events_total").alias("sessions"))


@query(
    "j10_session_parts",
    f"WITH {DAILY_SCREEN} SELECT participantid, {STAMP.format('s')} AS event_start, {', '.join(f'greatest(0, {n}) AS {n}_seconds' for n, _, _ in PARTS)} FROM (SELECT participantid, d, s, {', '.join(f'CAST(epoch(least(e, CAST(d AS TIMESTAMP) + INTERVAL {b} HOUR)) - epoch(greatest(s, CAST(d AS TIMESTAMP) + INTERVAL {a} HOUR)) AS BIGINT) AS {n}' for n, a, b in PARTS)} FROM sd)",
)
def j10(spark, d):
    return daily.split_sessions(sessions(spark, d)).select("participantid", "event_start", *(f"{n}_seconds" for n, _, _ in PARTS))


@query(
    "o06_gps_daily",
    f"WITH {GPS} SELECT participantid, strftime(du, '%Y-%m-%d') AS date_utc, strftime(d, '%Y-%m-%d') AS date_local, total_haversine_meters, number_of_stay_points, total_time_at_clusters_seconds, round(ent, 2) AS location_entropy, round(var, 2) AS location_variance, round(coalesce(sqrt(var), 0), 2) AS radius_of_gyration_meters FROM dgps",
)
def o06(spark, d):
    return gps(spark, d)


@query("f04_gps_steps", f"WITH {STEPS} SELECT event_id AS _id, round(dist, 3) AS haversine_distance, dwell AS time_spent_seconds FROM gs")
def f04(spark, d):
    return mobility.steps(mobility.usable_points(views.location(spark, d))).select("_id", F.round("haversine_distance", 3).alias("haversine_distance"), "time_spent_seconds")


@query("e05_gps_base", f"WITH {STEPS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, round(sum(dist), 1) AS meters, CAST(CAST(CAST(CASE WHEN count(*) > 1 THEN var_pop(lat) + var_pop(lon) END AS DECIMAL(20, 12)) AS DECIMAL(10, 4)) AS DOUBLE) AS variance FROM gs GROUP BY participantid, d")
def e05(spark, d):
    s = mobility.steps(mobility.usable_points(views.location(spark, d)))
    return s.groupBy("participantid", "date_local").agg(F.round(F.sum("haversine_distance"), 1).alias("meters"), motion.numeric(F.when(F.count("lat") > 1, F.var_pop("lat") + F.var_pop("lon"))).alias("variance"))


@query(
    "e06_stay_points",
    f"WITH {STEPS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, count(DISTINCT (round(lat, 4), round(lon, 4))) AS stays, CAST(sum(dwell) AS BIGINT) AS seconds FROM gs WHERE dwell >= 600 GROUP BY participantid, d",
)
def e06(spark, d):
    s = mobility.steps(mobility.usable_points(views.location(spark, d))).where("time_spent_seconds >= 600")
    return s.groupBy("participantid", "date_local").agg(F.count_distinct(F.struct(F.round("lat", 4), F.round("lon", 4))).alias("stays"), F.sum("time_spent_seconds").alias("seconds"))


@query("e07_location_entropy", f"WITH {STEPS} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, round(ln(sum(dwell)) - sum(dwell * ln(dwell)) / sum(dwell), 4) AS entropy FROM gs WHERE dwell >= 600 GROUP BY participantid, d")
def e07(spark, d):
    s = mobility.steps(mobility.usable_points(views.location(spark, d))).where("time_spent_seconds >= 600")
    return s.groupBy("participantid", "date_local").agg(mobility.dwell_entropy(F.col("time_spent_seconds")).alias("entropy"))


@query("e08_gps_rounding", f"WITH {GPS} SELECT strftime(d, '%Y-%m-%d') AS date_local, CAST(sum(total_haversine_meters) AS BIGINT) AS meters FROM dgps GROUP BY d")
def e08(spark, d):
    return gps(spark, d).groupBy("date_local").agg(F.sum("total_haversine_meters").cast("long").alias("meters"))


@query("d03_stay_join", f"WITH {STEPS}, b AS (SELECT participantid, d, count(*) AS n FROM gs GROUP BY 1, 2), s AS (SELECT participantid, d, count(*) AS stays FROM gs WHERE dwell >= 600 GROUP BY 1, 2) SELECT b.participantid, strftime(b.d, '%Y-%m-%d') AS date_local, n, coalesce(stays, 0) AS stays FROM b LEFT JOIN s USING (participantid, d)")
def d03(spark, d):
    s = mobility.steps(mobility.usable_points(views.location(spark, d)))
    return s.groupBy("participantid", "date_local").agg(F.count("*").alias("n"), F.count_if(F.col("time_spent_seconds") >= 600).alias("stays"))


SLEEP_NAMES = "total_night_screen_minutes, total_night_screen_interruptions, 600 - total_night_screen_minutes AS total_inactive_minutes"


@query("o07_sleep", f"WITH {NIGHT} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, {SLEEP_NAMES} FROM dsleep")
@query("e09_nightly_screen", f"WITH {NIGHT} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, {SLEEP_NAMES} FROM dsleep")
def o07(spark, d):
    return sleep.nightly(nights(spark, d))


@query("l02_sleep_by_rows", f"WITH {NIGHT} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, {SLEEP_NAMES} FROM dsleep")
def l02(spark, d):
    return sleep.nightly_by_rows(nights(spark, d))


@query("f05_previous_state", f"WITH {NIGHT} SELECT event_id, s AS event_type, b AS before FROM sp")
def f05(spark, d):
    n = nights(spark, d)
    rank = F.when(F.col("event_type") == "off", 0).when(F.col("event_type") == "on", 1).otherwise(2)
    w = Window.partitionBy("participantid", "date_local").orderBy("local_time", rank).rowsBetween(Window.unboundedPreceding, -1)
    out = n.withColumn("before", F.last(F.when(F.col("event_type") != "unknown", F.col("event_type")), ignorenulls=True).over(w))
    return out.join(views.events(spark, d).select("participantid", "measuredat", "event_id"), ["participantid", "measuredat"]).select("event_id", "event_type", "before")


@query("j05_point_times", f"WITH {EV}, {LOC} SELECT event_id AS _id, {STAMP.format('ts')} AS measuredat_utc, {STAMP.format('lt')} AS measuredat_local, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date_utc, strftime({DAY6.format('lt')}, '%Y-%m-%d') AS date_local FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE CASE own_zone WHEN 'Unknown_Timezone' THEN 'UTC' ELSE own_zone END AS lt FROM loc)")
def j05(spark, d):
    return times.point_times(views.location(spark, d)).select("_id", "measuredat_utc", "measuredat_local", "date_utc", "date_local")


@query("j06_time_fields", f"WITH {EV}, {LOC} SELECT event_id AS _id, strftime(lt, '%d-%m-%Y %H:%M:%S') AS measuredat_local, dayname(CAST(ts AS DATE)) AS weekday_utc, dayname({DAY6.format('lt')}) AS weekday_local FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE CASE own_zone WHEN 'Unknown_Timezone' THEN 'UTC' ELSE own_zone END AS lt FROM loc)")
def j06(spark, d):
    return times.time_fields(views.location(spark, d)).select("_id", "measuredat_local", "weekday_utc", "weekday_local")


@query("j09_day_parts", f"WITH {EV} SELECT CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'nighttime' END AS part, count(*) AS n FROM ev GROUP BY 1")
def j09(spark, d):
    return views.events(spark, d).groupBy(times.bucket_of(F.col("measuredat")).alias("part")).agg(F.count("*").alias("n"))


@query("k02_haversine", f"WITH {EV}, p AS (SELECT event_id, 44 + value / 100 AS lat, -63 + k / 100 AS lon, 44.0 AS plat, -63.0 AS plon FROM ev) SELECT event_id, round(2 * 6371000 * asin(sqrt(power(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(plon)) / 2), 2))), 2) AS meters FROM p")
def k02(spark, d):
    e = views.events(spark, d)
    return e.select("event_id", F.round(geo.haversine(F.lit(44.0), F.lit(-63.0), 44 + F.col("value") / 100, -63 + F.col("k") / 100), 2).alias("meters"))


@query("v01_basic_checks", f"WITH {DAILY_CALLS} SELECT count(*) AS total_rows, count(DISTINCT participantid) AS participants, count(*) FILTER (weekday_local IS NULL) AS null_weekdays, count(*) FILTER (duration_all_calls_seconds < 0) AS negative_durations FROM dcall")
def v01(spark, d):
    return daily.basic_checks(daily_calls(spark, d))


RESIDUAL = "SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, num_all_calls, num_all_calls - (num_calls_made + num_calls_received + num_missed_calls + num_rejected_calls) AS residual, CASE WHEN num_all_calls = num_calls_made + num_calls_received + num_missed_calls + num_rejected_calls THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM dcall"


@query("v02_call_match", f"WITH {DAILY_CALLS} {RESIDUAL} ORDER BY date_local DESC, participantid LIMIT 20")
def v02(spark, d):
    return daily.newest(daily.call_residuals(daily_calls(spark, d)), 20)


@query("v03_match_percentage", f"WITH {DAILY_CALLS}, r AS ({RESIDUAL}) SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM r), 2) AS percentage FROM r GROUP BY 1")
@query("d09_share_of_total", f"WITH {DAILY_CALLS}, r AS ({RESIDUAL}) SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM r), 2) AS percentage FROM r GROUP BY 1")
def v03(spark, d):
    return daily.status_shares(daily.call_residuals(daily_calls(spark, d)))


@query("v04_daily_distribution", f"WITH {DAILY_CALLS} SELECT strftime(d, '%Y-%m-%d') AS date_local, count(DISTINCT participantid) AS participants, CAST(sum(num_all_calls) AS BIGINT) AS calls, CAST(sum(duration_all_calls_seconds) AS BIGINT) AS seconds, round(avg(duration_all_calls_seconds), 2) AS mean_seconds FROM dcall GROUP BY d ORDER BY 1 DESC LIMIT 10")
def v04(spark, d):
    out = daily_calls(spark, d).groupBy("date_local").agg(F.count_distinct("participantid").alias("participants"), F.sum("num_all_calls").alias("calls"), F.sum("duration_all_calls_seconds").alias("seconds"), F.round(F.avg("duration_all_calls_seconds"), 2).alias("mean_seconds"))
    return out.orderBy(F.col("date_local").desc()).limit(10)


@query("v05_top_participants", f"WITH {DAILY_CALLS} SELECT participantid, CAST(sum(duration_all_calls_seconds) AS BIGINT) AS seconds FROM dcall GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
@query("g02_top_participants", f"WITH {DAILY_CALLS} SELECT participantid, CAST(sum(duration_all_calls_seconds) AS BIGINT) AS seconds FROM dcall GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def v05(spark, d):
    return daily_calls(spark, d).groupBy("participantid").agg(F.sum("duration_all_calls_seconds").alias("seconds")).orderBy(F.col("seconds").desc(), "participantid").limit(10)


@query("v06_active_parts", f"WITH {DAILY_SCREEN} SELECT {', '.join(f'count(*) FILTER ({n}_screen_time_in_seconds > 0) AS {n}_days' for n, _, _ in PARTS)}, round(avg(total_screen_time_in_seconds), 4) AS mean_total FROM dscreen")
def v06(spark, d):
    return daily_screen(spark, d).agg(*(F.count_if(F.col(f"{n}_screen_time_in_seconds") > 0).alias(f"{n}_days") for n, _, _ in PARTS), F.avg("total_screen_time_in_seconds").alias("mean_total"))


@query("v07_ordered_sample", f"WITH {DAILY_SCREEN} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, total_screen_time_in_seconds FROM dscreen ORDER BY 2 DESC, 1 LIMIT 20")
@query("g01_newest_rows", f"WITH {DAILY_SCREEN} SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, total_screen_time_in_seconds FROM dscreen ORDER BY 2 DESC, 1 LIMIT 20")
def v07(spark, d):
    return daily.newest(daily_screen(spark, d).select("participantid", "date_local", "total_screen_time_in_seconds"), 20)


SCREEN_RESIDUAL = f"SELECT participantid, strftime(d, '%Y-%m-%d') AS date_local, total_screen_time_in_seconds, {' + '.join(f'{n}_screen_time_in_seconds' for n, _, _ in PARTS)} AS parts, CASE WHEN total_screen_time_in_seconds = {' + '.join(f'{n}_screen_time_in_seconds' for n, _, _ in PARTS)} THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM dscreen"


@query("v08_screen_match", f"WITH {DAILY_SCREEN} {SCREEN_RESIDUAL}")
def v08(spark, d):
    return daily.screen_residuals(daily_screen(spark, d))


@query("v09_screen_status", f"WITH {DAILY_SCREEN}, r AS ({SCREEN_RESIDUAL}) SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM r), 2) AS percentage FROM r GROUP BY 1")
def v09(spark, d):
    return daily.status_shares(daily.screen_residuals(daily_screen(spark, d)))


BOXES = (("America/Halifax", 43.0, 47.0, -66.0, -59.0), ("America/Toronto", 41.0, 50.0, -80.0, -62.5), ("Europe/Berlin", 47.0, 55.0, 6.0, 15.0))


def _boxes(spark):
    rows = F.array(*(F.struct(F.lit(z).alias("timezone_id"), *(F.lit(v).alias(n) for n, v in zip(("south", "north", "west", "east"), b, strict=True))) for z, *b in BOXES))
    return spark.range(1).select(F.inline(rows))


ZONE = "CASE WHEN {lat} BETWEEN 43 AND 47 AND {lon} BETWEEN -66 AND -59 THEN 'America/Halifax' WHEN {lat} BETWEEN 41 AND 50 AND {lon} BETWEEN -80 AND -62.5 THEN 'America/Toronto' ELSE 'Unknown_Timezone' END"


@query("l05_zone_lookup", f"WITH {EV}, p AS (SELECT event_id, 44 + value / 100 AS lat, -63 + k / 100 AS lon FROM ev) SELECT event_id, {ZONE.format(lat='lat', lon='lon')} AS timezone_id FROM p")
@query("j15_zone_of_place", f"WITH {EV}, p AS (SELECT event_id, 44 + value / 100 AS lat, -63 + k / 100 AS lon FROM ev) SELECT event_id, {ZONE.format(lat='lat', lon='lon')} AS timezone_id FROM p")
def l05(spark, d):
    p = views.events(spark, d).select("event_id", (44 + F.col("value") / 100).alias("lat"), (-63 + F.col("k") / 100).alias("lon"))
    return enrichment.zones_by_box(p, _boxes(spark), "event_id").select("event_id", "timezone_id")


@query(
    "o09_fill_missing_zones",
    f"WITH {EV}, {LOC}, p AS (SELECT *, CAST(split_part(packed, ' | ', 1) AS DOUBLE) AS lat, CAST(split_part(packed, ' | ', 2) AS DOUBLE) AS lon FROM loc) SELECT event_id AS _id, CASE WHEN own_zone = 'Unknown_Timezone' THEN {ZONE.format(lat='lat', lon='lon')} ELSE own_zone END AS timezone_id FROM p",
)
def o09(spark, d):
    loc = views.location(spark, d).withColumn("timezone_id", F.nullif("timezone_id", F.lit("Unknown_Timezone")))
    return enrichment.zones_where_missing(loc, _boxes(spark)).select("_id", "timezone_id")


@query("l04_decoded_payload", f"WITH {EV}, {LOC} SELECT event_id AS _id, CASE WHEN event_id % 7 = 0 THEN 'None' WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN 'kept' ELSE packed END AS location_decrypted FROM loc")
def l04(spark, d):
    m = F.col("_id") % 7
    flip = lambda raw: bytes(b ^ 90 for b in raw)  # noqa: E731  stands in for a cipher
    sealed = enrichment.encoder(flip)(F.col("location_decrypted"))
    df = views.location(spark, d).withColumn("payload", F.when(m == 0, "none").when(m == 1, "*not base64*").otherwise(sealed)).withColumn("location_decrypted", F.when(m == 2, "kept"))
    return enrichment.decrypted_where_missing(df, "payload", "location_decrypted", enrichment.decoder(flip)).select("_id", "location_decrypted")


@query("e10_run_starts", f"WITH {EV}, {LOC}, {SEG} SELECT participantid, CAST(run AS BIGINT) AS run, {STAMP.format('start_time')} AS start_time FROM zg")
@query("f06_runs", f"WITH {EV}, {LOC}, {SEG} SELECT participantid, CAST(run AS BIGINT) AS run, {STAMP.format('start_time')} AS start_time FROM zg")
def e10(spark, d):
    s = segments(spark, d)
    return s.select("participantid", F.row_number().over(Window.partitionBy("participantid").orderBy("start_time")).alias("run"), "start_time")


@query("f07_next_start", f"WITH {EV}, {LOC}, {SEG} SELECT participantid, {STAMP.format('end_time')} AS end_time, end_time = TIMESTAMP '2100-01-01' AS open FROM seg")
def f07(spark, d):
    s = segments(spark, d)
    return s.select("participantid", "end_time", (F.col("end_time") == F.to_timestamp(F.lit(intervals.FAR_FUTURE))).alias("open"))


@query("f02_two_ahead", f"WITH {CALLS} SELECT event_id, v AS first, v2 AS second, v3 AS third FROM ca")
def f02(spark, d):
    w = sequences.by_time()
    c = views.calls(spark, d)
    c = c.withColumn("value0", F.when(F.lower("value0").contains("terminating"), "CALL_DISCONNECTED").otherwise(F.col("value0")))
    return c.select("event_id", F.col("value0").alias("first"), F.lead("value0").over(w).alias("second"), F.lead("value0", 2).over(w).alias("third"))


@query("j02_local_times", f"WITH {EV}, {SCREEN}, {LOC}, {SEG}, {zoned('screen', 'm')} SELECT event_id, {STAMP.format(LOCAL)} AS local FROM m")
def j02(spark, d):
    m = intervals.best_zone(views.screen(spark, d), segments(spark, d), "event_id")
    return m.select("event_id", times.local_time(F.col("measuredat"), F.col("timezone_id")).alias("local"))


@query("j12_local_minutes", f"WITH {NIGHT} SELECT strftime(d, '%Y-%m-%d') AS date_local, hour(lt) AS hour, count(*) AS n FROM sn GROUP BY 1, 2")
def j12(spark, d):
    return nights(spark, d).groupBy("date_local", F.hour("local_time").alias("hour")).agg(F.count("*").alias("n"))


@query("j13_unix_times", f"WITH {EV} SELECT event_id, {STAMP.format('ts')} AS ts FROM ev")
def j13(spark, d):
    e = views.events(spark, d).select("event_id", F.unix_timestamp("measuredat").alias("seconds"))
    return e.select("event_id", times.any_timestamp("bigint", F.col("seconds")).alias("ts"))


@query("l01_entropy_of_dwell", f"WITH {STEPS} SELECT strftime(d, '%Y-%m-%d') AS date_local, round(ln(sum(dwell)) - sum(dwell * ln(dwell)) / sum(dwell), 4) AS entropy FROM gs WHERE dwell > 0 GROUP BY d")
def l01(spark, d):
    s = mobility.steps(mobility.usable_points(views.location(spark, d))).where("time_spent_seconds > 0")
    return s.groupBy("date_local").agg(mobility.dwell_entropy(F.col("time_spent_seconds")).alias("entropy"))
