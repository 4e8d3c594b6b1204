"""Queries over events and requests: sessions, windows, streams, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.tables import table
from corpusloom.session import checkpoint_dir
from corpusloom.streaming import ingest as I

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def session_windows(spark, sf) -> DataFrame:
    s = I.sessions(table(spark, sf, "events"), "user_id", "ts")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


_SESSIONS = """e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
    g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)"""
S["session_windows"] = f"WITH {_SESSIONS} SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS events FROM g GROUP BY user_id, s"


@query
def stream_sessions(spark, sf) -> DataFrame:
    """The same over a stream with a watermark of ten minutes: sessions still open at its end
    have not come out yet."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = I.run_available(I.sessions(I.parquet_stream(spark, f"{sf}/events.parquet*"), "user_id", "ts", delay="10 minutes"), f"{base}/out", f"{base}/state")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


S["stream_sessions"] = f"""WITH {_SESSIONS}, s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS events FROM g GROUP BY user_id, s)
    SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, events FROM s WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query
def hourly_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.unix_micros("w.start").alias("hour_us"), "event_type", "events", "value")


S["hourly_events"] = "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


@query
def stream_dedupe(spark, sf) -> DataFrame:
    """Requests once each from a stream; state is kept for 60 days of event time, the latest a second delivery may come."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = I.new_rows(I.parquet_stream(spark, f"{sf}/ask_request.parquet*"), "request_id", "requested_at", "60 days")
    return I.run_available(s.select("request_id", "session_id"), f"{base}/out", f"{base}/state")


S["stream_dedupe"] = "SELECT DISTINCT request_id, session_id FROM ask_request"


#: What a source might say, by event type: the messages that the classes tell apart.
_SAID = {"view": "HTTP 429: Too Many Requests", "click": "Subtitles are disabled for this video", "signup": "NoTranscriptFound: no transcript for vi", "purchase": "quota exceeded for key", "error": "connection reset by peer"}


@query
def fetch_errors(spark, sf) -> DataFrame:
    """Classes of error messages, and which are a rate limit."""
    said = F.create_map(*[F.lit(x) for kv in _SAID.items() for x in kv])[F.col("event_type")]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events")).select("event_type", "events", T.error_class(said).alias("class"), T.is_rate_limit(said).alias("limited"))


S["fetch_errors"] = f"""WITH e AS (SELECT event_type, count(*) AS events, lower(CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAID.items())} END) AS m FROM events GROUP BY 1)
    SELECT event_type, events, CASE WHEN regexp_matches(m, '429|too many requests|blocked|ipblocked|requestblocked') THEN 'blocked' WHEN contains(m, 'disabled') THEN 'transcripts_disabled' WHEN regexp_matches(m, 'no transcript|notranscript') THEN 'no_transcript' ELSE 'error' END AS class, regexp_matches(m, '429|rate_limit|quota') AS limited FROM e"""


@query
def stream_ingest(spark, sf) -> DataFrame:
    """Chunks from a stream, each id once, and none that the ledger of an earlier run has; a second run adds nothing."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for run in (1, 2):
        I.ingest(I.parquet_stream(spark, f"{sf}/transcript_v3.parquet*"), f"{base}/out", f"{base}/ledger", "chunk_id", f"{base}/state{run}")
    return spark.read.parquet(f"{base}/out").groupBy("chunk_id").agg(F.count("*").alias("rows"), F.max("video_id").alias("video_id"))


S["stream_ingest"] = "SELECT chunk_id, 1 AS rows, max(video_id) AS video_id FROM transcript_v3 WHERE chunk_id IS NOT NULL GROUP BY 1"


@query
def stream_stops(spark, sf) -> DataFrame:
    """Where a user's clicks in a row reach three, from a stream with the count kept as state."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = I.parquet_stream(spark, f"{sf}/events.parquet*").select("user_id", "event_id", F.when(F.col("event_type") == "click", "blocked").otherwise("ok").alias("status"))
    return I.run_available(I.stop_signals(e, "user_id", "event_id", "status", 3), f"{base}/out", f"{base}/state")


@query
def event_streaks(spark, sf) -> DataFrame:
    """Runs of one event type per user, with a stop after three in a row."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "blocked").otherwise("ok").alias("status"))
    return I.blocked_runs(e, "user_id", "event_id", "status", 3)


S["event_streaks"] = """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS b, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    r AS (SELECT user_id, event_id, CAST(sum(CAST(b AS INT)) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM e) SELECT *, streak >= 3 AS stop FROM r"""


@query
def run_counters(spark, sf) -> DataFrame:
    """Outcomes of deliveries: first, repeated, late."""
    r = table(spark, sf, "ask_request")
    first = r.groupBy("request_id").agg(F.count("*").alias("n"), F.min(F.unix_micros("received_at") - F.unix_micros("requested_at")).alias("lag"))
    status = F.when(F.col("n") > 1, "repeated").when(F.col("lag") > 86_400_000_000, "late").otherwise("success")
    return first.groupBy(status.alias("status")).agg(F.count("*").alias("requests"))


S["run_counters"] = "WITH f AS (SELECT request_id, count(*) AS n, min(epoch_us(received_at) - epoch_us(requested_at)) AS lag FROM ask_request GROUP BY 1) SELECT CASE WHEN n > 1 THEN 'repeated' WHEN lag > 86400000000 THEN 'late' ELSE 'success' END AS status, count(*) AS requests FROM f GROUP BY 1"


S["stream_stops"] = f"SELECT user_id, event_id FROM ({S['event_streaks']}) WHERE streak = 3"
