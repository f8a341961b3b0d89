"""Registered queries over the driver's tables, and SQL that gives the same rows.

All read the sensor views of sources.views. Results are in plain types: times and dates as text,
whole numbers as bigint, other numbers as rounded doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, times, values
from ..operators import daily, enrichment, grids, intervals, merging, mobility, modelling, motion, screening, secondary, sequences, sleep
from ..sources import readers, sinks, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.IntegralType):
            c = c.cast("long")
        elif isinstance(t, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), 4)
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- SQL parts -----------------------------------------------------------------------------------

EV = "ev AS (SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS participantid, ts, event_type AS et, value, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)"
SCREEN = "screen AS (SELECT event_id, user_id, participantid, ts, CASE et WHEN 'view' THEN 'unlocked' WHEN 'click' THEN 'locked' ELSE et END AS v FROM ev)"
LOC = """loc AS (SELECT event_id, participantid, user_id, ts, value, k, CASE (user_id + (day(ts) - 1) // 10) % 3 WHEN 0 THEN 'America/Halifax' WHEN 1 THEN 'UTC' ELSE 'Unknown_Timezone' END AS own_zone,
  printf('%.6f | %.6f | 0', 44 + value / 100, -63 + k / 100) AS packed FROM ev)"""
SEG = """zr AS (SELECT *, lag(own_zone) OVER (PARTITION BY participantid ORDER BY ts) AS before FROM loc WHERE own_zone <> 'Unknown_Timezone'),
zs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> own_zone THEN 1 ELSE 0 END) OVER (PARTITION BY participantid ORDER BY ts) AS run FROM zr),
zg AS (SELECT participantid, own_zone AS timezone_id, run, min(ts) AS start_time FROM zs GROUP BY 1, 2, 3),
seg AS (SELECT participantid, timezone_id, start_time, coalesce(lead(start_time) OVER (PARTITION BY participantid ORDER BY start_time), TIMESTAMP '2100-01-01') AS end_time FROM zg)"""
LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE coalesce(timezone_id, 'UTC'))"
SECONDS = "CAST(epoch(date_trunc('second', {b})) - epoch(date_trunc('second', {a})) AS BIGINT)"


def zoned(source: str, name: str, key: str = "event_id") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT x.*, s.timezone_id, row_number() OVER (PARTITION BY x.participantid, x.{key} ORDER BY s.start_time DESC NULLS LAST, s.end_time, s.timezone_id) AS best
  FROM {source} x LEFT JOIN seg s ON s.participantid = x.participantid AND x.ts >= s.start_time AND x.ts <= s.end_time) WHERE best = 1)"""


PAIRS = f"""ahead AS (SELECT *, lead(v) OVER w AS nv, lead(ts) OVER w AS nts FROM screen WINDOW w AS (PARTITION BY participantid ORDER BY ts, v)),
paired AS (SELECT participantid, event_id, ts, nts, {SECONDS.format(a="ts", b="nts")} AS secs FROM ahead WHERE v = 'unlocked' AND nv = 'locked'),
spans AS (SELECT * FROM paired WHERE secs > 0 AND secs <= 36000)"""
SESSIONS = f"{EV}, {SCREEN}, {LOC}, {SEG}, {PAIRS}, {zoned('spans', 'sess')}"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
DAY6 = "CAST({0} - INTERVAL 6 HOUR AS DATE)"
PARTS = (("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24), ("nighttime", 24, 30))
_CLIP = ",\n  ".join(
    f"greatest(0, CAST(epoch(least(e, CAST(d AS TIMESTAMP) + INTERVAL {b} HOUR)) - epoch(greatest(s, CAST(d AS TIMESTAMP) + INTERVAL {a} HOUR)) AS BIGINT)) AS {n}" for n, a, b in PARTS
)
DAILY_SCREEN = f"""{SESSIONS},
st AS (SELECT participantid, date_trunc('second', {LOCAL}) AS s, secs FROM sess WHERE secs <= 10800),
sd AS (SELECT participantid, s, s + to_seconds(secs) AS e, {DAY6.format('s')} AS d FROM st),
sb AS (SELECT participantid, d, {_CLIP} FROM sd),
dscreen AS (SELECT participantid, d, dayname(d) AS weekday_local, CAST(sum(morning + afternoon + evening + nighttime) AS BIGINT) AS total_screen_time_in_seconds, count(*) AS num_of_events_total,
  {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}_screen_time_in_seconds, CAST(count(*) FILTER ({n} > 0) AS BIGINT) AS num_of_events_{n}" for n, _, _ in PARTS)} FROM sb GROUP BY 1, 2, 3)"""
CALLS = f"""{EV}, {LOC}, {SEG},
cv AS (SELECT event_id, participantid, ts, CASE et WHEN 'signup' THEN 'CALL_INCOMING' WHEN 'view' THEN 'CALL_DIALING' WHEN 'click' THEN 'CALL_CONNECTED' ELSE 'CALL_DISCONNECTED' END AS v FROM ev),
{zoned('cv', 'cz')},
ca AS (SELECT *, lead(v) OVER w AS v2, lead(v, 2) OVER w AS v3, lead(ts) OVER w AS t2, lead(ts, 2) OVER w AS t3 FROM cz WINDOW w AS (PARTITION BY participantid ORDER BY ts, v)),
cb AS (SELECT *, v2 = 'CALL_CONNECTED' AND v3 = 'CALL_DISCONNECTED' AS ans, v2 = 'CALL_DISCONNECTED' AND (v3 IS NULL OR v3 <> 'CALL_CONNECTED') AND {SECONDS.format(a='ts', b='t2')} < 43200 AS un,
  {SECONDS.format(a='ts', b='t3')} AS span3, CASE v WHEN 'CALL_INCOMING' THEN 'incoming' ELSE 'outgoing' END AS way FROM ca WHERE v IN ('CALL_INCOMING', 'CALL_DIALING')),
call AS (SELECT participantid, timezone_id, ts, CASE WHEN ans THEN t3 ELSE t2 END AS call_end, way || CASE WHEN ans THEN '_call_answered' ELSE '_call_unanswered' END AS call_type, CASE WHEN ans THEN span3 ELSE 0 END AS secs
  FROM cb WHERE (ans AND span3 < 43200) OR un)"""
COUNTS = """count(*) AS num_all_calls, CAST(coalesce(sum(secs), 0) AS BIGINT) AS duration_all_calls_seconds,
  count(*) FILTER (call_type = 'outgoing_call_answered') AS num_calls_made, CAST(coalesce(sum(secs) FILTER (call_type = 'outgoing_call_answered'), 0) AS BIGINT) AS duration_calls_made_seconds,
  count(*) FILTER (call_type = 'incoming_call_answered') AS num_calls_received, CAST(coalesce(sum(secs) FILTER (call_type = 'incoming_call_answered'), 0) AS BIGINT) AS duration_calls_received_seconds,
  count(*) FILTER (call_type = 'incoming_call_unanswered') AS num_missed_calls, count(*) FILTER (call_type = 'outgoing_call_unanswered') AS num_rejected_calls"""
DAILY_CALLS = f"""{CALLS}, dcall AS (SELECT participantid, d, dayname(d) AS weekday_local, {COUNTS} FROM (SELECT *, {DAY6.format(LOCAL)} AS d FROM call) GROUP BY 1, 2, 3)"""
POINTS = f"""{EV}, {LOC}, {SEG},
ax AS (SELECT event_id, participantid, ts, value / 100 AS x, k / 100 AS y, (event_id % 7) / 7 AS z FROM ev),
ap AS (SELECT * FROM ax WHERE x BETWEEN -20 AND 20 AND y BETWEEN -20 AND 20 AND z BETWEEN -20 AND 20),
{zoned('ap', 'az')},
ad AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM az WINDOW w AS (PARTITION BY participantid ORDER BY ts, event_id)),
pts AS (SELECT event_id, participantid, ts, timezone_id, x, y, z, round(sqrt(x * x + y * y + z * z), 4) AS n, round(sqrt(dx * dx + dy * dy + dz * dz), 4) AS step, date_trunc('second', {LOCAL}) AS lt FROM ad)"""
DAILY_ACC = f"""{POINTS},
pa AS (SELECT *, {DAY6.format('lt')} AS d, CASE WHEN hour(lt) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(lt) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(lt) >= 18 THEN 'evening' ELSE 'nighttime' END AS b FROM pts WHERE n BETWEEN 0 AND 20),
dacc AS (SELECT participantid, d, dayname(d) AS weekday_local, count(*) FILTER (n < 0.4) AS non_vigorous_pa_seconds, count(*) FILTER (n >= 0.4) AS vigorous_pa_seconds, count(*) AS total_active_seconds,
  round(count(*) FILTER (n >= 0.4) * 100.0 / 86400, 2) AS percentage_vigorous_active_daily, {", ".join(f"count(*) FILTER (b = '{n}') AS {n}_pa_seconds" for n, _, _ in PARTS)},
  avg(n) AS avg_n, max(n) AS max_n, coalesce(stddev_samp(n), 0) AS sd_n FROM pa GROUP BY 1, 2, 3)"""
HAV = "2 * 6371000 * asin(sqrt(power(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(plon)) / 2), 2)))"
STEPS = f"""{EV}, {LOC},
gp AS (SELECT event_id, participantid, ts, CAST(trim(split_part(packed, '|', 1)) AS DOUBLE) AS lat, CAST(trim(split_part(packed, '|', 2)) AS DOUBLE) AS lon, CAST(ts AS DATE) AS du,
  {DAY6.format("((ts AT TIME ZONE 'UTC') AT TIME ZONE CASE own_zone WHEN 'Unknown_Timezone' THEN 'UTC' ELSE own_zone END)")} AS d FROM loc),
gl AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(ts) OVER w AS nts FROM gp WINDOW w AS (PARTITION BY participantid, d ORDER BY ts, event_id)),
gs AS (SELECT *, CASE WHEN plat IS NULL THEN 0 ELSE {HAV} END AS dist, coalesce({SECONDS.format(a='ts', b='nts')}, 0) AS dwell FROM gl)"""
GPS = f"""{STEPS},
dgps AS (SELECT participantid, du, d, round(sum(dist), 0) AS total_haversine_meters, count(DISTINCT (round(lat, 4), round(lon, 4))) FILTER (dwell >= 600) AS number_of_stay_points,
  CAST(coalesce(sum(dwell) FILTER (dwell >= 600), 0) AS BIGINT) AS total_time_at_clusters_seconds,
  coalesce(ln(sum(dwell) FILTER (dwell >= 600)) - sum(dwell * ln(dwell)) FILTER (dwell >= 600) / sum(dwell) FILTER (dwell >= 600), 0) AS ent,
  CASE WHEN count(*) > 1 THEN var_pop(lat) + var_pop(lon) END AS var FROM gs GROUP BY 1, 2, 3)"""
NIGHT = f"""{EV}, {LOC}, {SEG},
se AS (SELECT event_id, participantid, ts, CASE et WHEN 'view' THEN 'on' WHEN 'click' THEN 'off' ELSE 'unknown' END AS s FROM ev), {zoned('se', 'sz')},
sl AS (SELECT *, {LOCAL} AS lt FROM sz),
sn AS (SELECT *, CASE WHEN hour(lt) >= 22 THEN CAST(lt AS DATE) ELSE CAST(lt - INTERVAL 1 DAY AS DATE) END AS d FROM sl WHERE hour(lt) >= 22 OR hour(lt) < 8),
sp AS (SELECT *, last_value(CASE WHEN s IN ('on', 'off') THEN s END IGNORE NULLS) OVER (PARTITION BY participantid, d ORDER BY lt, CASE s WHEN 'off' THEN 0 WHEN 'on' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sn),
dsleep AS (SELECT participantid, d, count(DISTINCT date_trunc('minute', lt)) FILTER (s = 'on') AS total_night_screen_minutes, count(*) FILTER (s = 'on' AND coalesce(b, '') <> 'on') AS total_night_screen_interruptions FROM sp GROUP BY 1, 2)"""
#: Values of each participant for statistics: event values of the first 15 days by day.
DAYVAL = f"""{EV}, dayval AS (SELECT participantid, CAST(ts AS DATE) AS d, sum(value) AS total, avg(k) AS level, count(*) AS n FROM ev GROUP BY 1, 2)"""
LONG = f"""{DAYVAL}, lv AS (SELECT participantid, d, 'total' AS feature, CAST(total AS DOUBLE) AS x FROM dayval UNION ALL SELECT participantid, d, 'level', level FROM dayval UNION ALL SELECT participantid, d, 'n', n FROM dayval)"""


# ---- frames that several queries share -----------------------------------------------------------


def segments(spark, d) -> DataFrame:
    make = lambda: intervals.zone_segments(views.location(spark, d), ["measuredat"])
    return d.once("segments", make) if isinstance(d, views.Study) else make()


def sessions(spark, d) -> DataFrame:
    return sequences.screen_sessions_android(views.screen(spark, d), segments(spark, d))


def daily_screen(spark, d) -> DataFrame:
    return daily.daily_screen(sessions(spark, d))


def calls(spark, d) -> tuple[DataFrame, DataFrame]:
    raw = views.calls(spark, d)
    return sequences.calls_ios(raw.where(~F.lower("value0").contains("terminating")), raw, segments(spark, d))


def daily_calls(spark, d) -> DataFrame:
    return daily.daily_calls_ios(calls(spark, d)[0])


def points(spark, d) -> DataFrame:
    return motion.accelerometer_points(views.accelerometer(spark, d).drop("user_id"), segments(spark, d))


def daily_motion(spark, d) -> DataFrame:
    return motion.daily_accelerometer(points(spark, d))


def gps(spark, d) -> DataFrame:
    return mobility.daily_gps(views.location(spark, d))


def nights(spark, d) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "screen_on").when(F.col("event_type") == "click", "screen_off").otherwise(F.col("event_type"))
    states = sleep.screen_states(views.events(spark, d).withColumn("value0", label), None)
    return sleep.night_events(states, segments(spark, d))


def day_values(spark, d) -> DataFrame:
    e = views.events(spark, d).select("participantid", F.to_date("measuredat").alias("date_local"), "event_id", F.col("value").alias("total"), "k")
    return secondary.summed_in_order(e, ["participantid", "date_local"], ["event_id"], "total", F.avg("k").alias("level"), F.count("*").alias("n"))


def long_values(spark, d) -> DataFrame:
    return secondary.long_form(day_values(spark, d), ["total", "level", "n"])


def outcome_values(spark, d) -> DataFrame:
    """Long values with a class of three for each participant."""
    e = views.events(spark, d).select("participantid", F.pmod("user_id", F.lit(3)).cast("string").alias("outcome")).distinct()
    sums = secondary.summed_in_order(long_values(spark, d), ["participantid", "feature"], ["date_local"], "x", F.count("x").alias("n"))
    return sums.select("participantid", "feature", (F.col("x") / F.col("n")).alias("x")).join(e, "participantid")


from . import catalogue_cleaning, catalogue_events, catalogue_statistics  # noqa: E402, F401
