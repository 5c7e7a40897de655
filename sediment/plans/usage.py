"""Usage queries over events: app is the event type, model is in the properties."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sediment.functions import dates
from sediment.operators import usage as us
from sediment.plans.registry import query
from sediment.sources import logs
from sediment.sources.work import work_root
from sediment.streaming import events as ev

_TOKENS = "sum(CAST(floor(value) AS BIGINT)) AS input_tokens, sum(CAST(floor(value / 2) AS BIGINT)) AS output_tokens"


def _in():
    return F.floor("value").cast("long")


def _out():
    return F.floor(F.col("value") / 2).cast("long")


@query(f"SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS requests, {_TOKENS}, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def usage_weekly_monday(spark, table):
    return us.weekly(table("events"), dates.week_monday(F.col("ts")), "user_id", _in(), _out())


@query(f"SELECT CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS week_start, count(*) AS requests, {_TOKENS}, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def usage_weekly_sunday(spark, table):
    return us.weekly(table("events"), dates.week_sunday(F.col("ts")), "user_id", _in(), _out())


@query("SELECT count(*) AS requests, coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS input_tokens, count(DISTINCT user_id) AS users, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events")
def usage_totals(spark, table):
    return us.totals(table("events"), F.to_date("ts"), "user_id", _in())


@query("SELECT event_type AS name, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def usage_by_app(spark, table):
    return us.count_by(table("events"), F.col("event_type"), "event_id")


@query("SELECT json_extract_string(props, '$.k') AS name, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def usage_by_model(spark, table):
    return us.count_by(table("events"), F.get_json_object("props", "$.k"), "event_id")


@query("SELECT count(*) AS requests, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS apps FROM events")
def usage_summary(spark, table):
    return us.summary(table("events"), "ts", "event_type")


@query("SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS bad, count(*) AS lines FROM events")
def usage_log_bad_lines(spark, table):
    line = F.when(F.col("event_id") % 10 == 0, F.concat("event_type", F.lit("|x"))).otherwise(F.concat_ws("|", F.col("ts").cast("string"), "event_type", F.lit("m")))
    return logs.bad_lines(logs.parse_usage_lines(table("events").select(line.alias("value"))))


@query("SELECT event_type, count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE value > 50) = 0 THEN 0 ELSE sum(value) / count(*) FILTER (WHERE value > 50) END, 4) AS average FROM events GROUP BY 1")
def metric_averages(spark, table):
    out = table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count_if(F.col("value") > 50).alias("k"))
    return out.select("event_type", "n", F.round(us.metric_average(F.col("s"), F.col("k")), 4).alias("average"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_windows(spark, table):
    out = ev.windowed_counts(table("events"), "ts", ["event_type"], "1 day")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, table):
    out = ev.sessions(table("events"), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""SELECT date_trunc('week', ts)::DATE AS period, event_type, count(*) AS requests, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS cents, true AS near
FROM events GROUP BY ALL""")
def usage_from_days(spark, table):
    """Weeks merged from stored days, the last day added by itself; near tells whether the users estimated are within 5 % of those counted."""
    logs = table("events").withColumn("day", F.to_date("ts"))
    store = us.UsageStore(spark, f"{work_root(spark)}/sediment-usage-{uuid.uuid4().hex}")
    last = logs.agg(F.max("day")).first()[0]
    for some in (logs.where(F.col("day") < F.lit(last)), logs.where(F.col("day") == F.lit(last))):
        store.put(us.daily_partials(some, F.col("day"), ["event_type"], "user_id", {"cents": F.floor(F.col("value") * 100)}))
    weeks = us.merged(store.read(), F.to_date(F.date_trunc("week", F.col("day"))), ["event_type"], ["cents"])
    counted = logs.groupBy(F.to_date(F.date_trunc("week", F.col("day"))).alias("period"), "event_type").agg(F.countDistinct("user_id").alias("exact"))
    return weeks.join(counted, ["period", "event_type"]).select("period", "event_type", "requests", "cents", (F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))
