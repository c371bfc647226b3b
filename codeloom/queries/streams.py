
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..streaming import events as E
from . import query


def _events(spark, d):
    return A.table(spark, d, "events")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 7200 SECONDS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM g GROUP BY user_id, g""")
def debounce_sessions(spark, d):
    out = E.debounced(_events(spark, d), "2 hours", ["user_id"])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    out = E.tumbling(_events(spark, d), "1 hour", ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) - k * INTERVAL 15 MINUTES AS start, value FROM events, range(4) r(k)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1")
def sliding_latency(spark, d):
    out = E.sliding(_events(spark, d), "1 hour", "15 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"))


@query("SELECT event_type AS mode, count(*) AS searches, round(avg(value), 4) AS mean_latency, round(max(value), 4) AS max_latency FROM events GROUP BY 1")
def telemetry_summary(spark, d):
    """X9, X10."""
    return E.telemetry(_events(spark, d).select(F.col("event_type").alias("mode"), F.col("value").alias("latency_ms")))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND user_id % 10 <> 0")
def filtered_events(spark, d):
    """Events that the ignore rules leave."""
    return E.accepted(_events(spark, d), F.col("event_type") == "error", F.col("user_id") % 10 == 0).select("event_id", "user_id")
