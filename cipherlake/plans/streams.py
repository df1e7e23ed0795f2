"""Streaming queries, run over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cipherlake.functions.storage import shared_dir
from cipherlake.plans.relational import NEW, OLD
from cipherlake.sources.bridge import F_CTE, findings, table
from cipherlake.streaming import monitor as M


def events(s, d):
    """The events table as a stream: rewritten to a folder, because a stream's source is one."""
    path = f"{shared_dir(s)}/events-{uuid.uuid4().hex}"
    table(s, d, "events").write.parquet(path)
    return M.stream_table(s, path, table(s, d, "events").schema, per_trigger=1000)


def monitor_diff(s, d):
    f = findings(s, d)
    source, work = (f"{shared_dir(s)}/{n}-{uuid.uuid4().hex}" for n in ("scans", "monitor"))
    for scan in (OLD, NEW):
        f.where(F.col("scan_id") == scan).select("rule_id", "file_path", "line_start").coalesce(1).write.mode("append").parquet(source)
    m = M.Monitor(s, work)
    m.run(M.stream_table(s, source, "rule_id string, file_path string, line_start int"))
    return m.outbox().groupBy("batch", "change").agg(F.count("*").alias("n"))


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_K = "k AS (SELECT DISTINCT scan_id, rule_id || ':' || file_path || ':' || line_start AS key FROM f)"

QUERIES = {
    "q_stream_tumbling": (
        lambda s, d: _ntz(M.run_to_table(M.tumbling(events(s, d), "1 day", "event_type"), "tumbling")),
        "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
    "q_stream_sliding": (
        lambda s, d: _ntz(M.run_to_table(M.sliding(events(s, d), "1 day", "12 hours", "event_type"), "sliding")),
        "SELECT start, start + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS * i AS start FROM events, range(2) AS r(i)) GROUP BY ALL",
    ),
    "q_stream_session": (
        lambda s, d: _ntz(M.run_to_table(M.sessions(events(s, d), "6 hours", "user_id"), "session")),
        "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k",
    ),
    "q_stream_monitor_diff": (
        monitor_diff,
        f"WITH {F_CTE}, {_K}, a AS (SELECT key FROM k WHERE scan_id = '{OLD}'), b AS (SELECT key FROM k WHERE scan_id = '{NEW}') SELECT 0 AS batch, 'new' AS change, count(*) AS n FROM a UNION ALL SELECT 1, 'new', count(*) FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT 1, 'fixed', count(*) FROM a WHERE key NOT IN (SELECT key FROM b)",
    ),
}
