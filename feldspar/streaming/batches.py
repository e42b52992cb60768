"""The streaming operators' batch twins: the same functions over a bounded table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import adapters as a
from ..plans.registry import query
from .jobs import first_seen, windowed_counts


@query("u04_windowed_counts", """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def u04(spark, d):
    return windowed_counts(a.table(spark, d, "events"), "ts", "event_type", "6 hours", "1 hour")


@query("u03_first_seen", """SELECT count(DISTINCT (user_id, event_type)) AS kept FROM events""")
def u03(spark, d):
    """On a bounded table everything is within the watermark."""
    events = a.table(spark, d, "events")
    kept = first_seen(events, ["user_id", "event_type"], "ts", "1 day") if events.isStreaming else events.dropDuplicates(["user_id", "event_type"])
    return kept.agg(F.count(F.lit(1)).alias("kept"))
