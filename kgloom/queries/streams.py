"""Streaming pipelines over events as files, worked off once; the batch twins give the oracle."""

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.registry import query
from kgloom.sources.readers import scratch
from kgloom.streaming import deltas, memory
from kgloom.streaming import pipelines as P


def staged(spark, sf, files: int = 4):
    """Events as a folder of files, for a file stream."""
    e = table(spark, sf, "events")
    path = scratch(spark, "events-in")
    e.repartitionByRange(files, "ts").write.parquet(path)
    return P.files(spark, path, e)


@query("m02_modified_since", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def m02(spark, sf):
    out, ck = scratch(spark, "m02"), scratch(spark, "m02-ck")
    P.run_once(staged(spark, sf).where("ts > timestamp'2024-01-20 00:00:00'").select("event_id", "ts"), out, ck)
    return spark.read.parquet(out)


@query("m03_mail_pipeline", "SELECT event_id, (i // 8)::INT AS chunk_index, substring(body, i + 1, 10) AS chunk FROM (SELECT event_id, event_type || ' ' || props AS body FROM events WHERE event_type <> 'error'), LATERAL (SELECT unnest(range(0, length(body), 8)) AS i)")
def m03(spark, sf):
    """Clean, cut and store in one streaming plan."""
    from kgloom.operators.chunking import fixed_windows

    out, ck = scratch(spark, "m03"), scratch(spark, "m03-ck")
    body = F.concat_ws(" ", "event_type", "props")
    s = staged(spark, sf).where("event_type <> 'error'").select("event_id", F.posexplode(fixed_windows(body, 10, 2)).alias("chunk_index", "chunk"))
    P.run_once(s, out, ck)
    return spark.read.parquet(out)


@query("m04_stream_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def m04(spark, sf):
    """Four batches, one a file, as deltas that are compacted after the third."""
    e = table(spark, sf, "events")
    path, out, ck = (scratch(spark, n) for n in ("events-in", "m04", "m04-ck"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    keys, version = ["user_id"], ["ts", "event_id"]
    P.run_once(P.files(spark, path, e, per_trigger=1), out, ck, each=deltas.upserter(out, keys, version, every=3))
    return deltas.read(spark, out, keys, version, e.schema).select("user_id", "event_id", "event_type")


@query("m10_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def m10(spark, sf):
    """One alert for each key within the watermark; all files are one batch here, so one for each key."""
    out, ck = scratch(spark, "m10"), scratch(spark, "m10-ck")
    P.run_once(P.first_seen(staged(spark, sf).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"]), out, ck)
    return spark.read.parquet(out).select("user_id", "event_type")


def closed(spark, sf, make):
    """The windows of all events: a marker later than every event goes into the folder after them and closes what
    would wait for the watermark; its own window stays open and is never written."""
    e = table(spark, sf, "events")
    path, out, ck = (scratch(spark, n) for n in ("events-in", "windows", "windows-ck"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    P.run_once(make(P.files(spark, path, e)), out, ck)
    e.agg(F.max(F.col("ts")).alias("ts")).select(*[((F.col("ts") + F.expr("interval 60 days")) if c.name == "ts" else F.lit(None)).cast(c.dataType).alias(c.name) for c in e.schema]).write.mode("append").parquet(path)
    P.run_once(make(P.files(spark, path, e)), out, ck)
    return spark.read.parquet(out)


@query("m01_stream_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS count FROM events GROUP BY 1")
def m01(spark, sf):
    return closed(spark, sf, lambda s: P.daily(s, "ts")).select(F.col("start").cast("timestamp_ntz").alias("start"), "count")


@query("m07_stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS count FROM s GROUP BY user_id, n")
def m07(spark, sf):
    return closed(spark, sf, lambda s: P.sessions(s, "ts", "user_id")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "count")


def remembered(spark, sf):
    """Conversations as a stream that is stopped and started again in between: the second run has only the checkpoint."""
    c = table(spark, sf, "conversations")
    path, out, ck = (scratch(spark, n) for n in ("turns-in", "turns", "turns-ck"))

    def run():
        s = P.files(spark, path, c).select("conv_id", "turn", "role", F.concat_ws(" ", "turn", "role").alias("message"), F.when(F.col("role") == "user", 25).alias("asked"), F.when(F.col("turn") % 7 == 0, F.concat(F.lit("set "), F.floor(F.col("turn") / 7).cast("string"))).alias("choice"))
        P.run_once(memory.remembering(s, "conv_id", ["turn", "role"], "message", "asked", "choice"), out, ck)

    memory.in_runs(spark, c, "turn", path, 2, run)
    return spark.read.parquet(out)


@query("m07_memory_window", "WITH m AS (SELECT conv_id, turn, role, turn || ' ' || role AS message FROM conversations) SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN coalesce(array_to_string(list(message) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), chr(10)), '') ELSE coalesce(array_to_string(list(message) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), chr(10)), '') END AS context FROM m")
def m07_memory(spark, sf):
    """What each message can refer to: the last 10 messages, or those asked for up to 20, kept as state."""
    return remembered(spark, sf).select("conv_id", "turn", "role", "context")


@query("m11_dataset_pin", "SELECT conv_id, turn, role, last_value(CASE WHEN turn % 7 = 0 THEN 'set ' || (turn // 7) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pinned FROM conversations")
def m11(spark, sf):
    """The data set chosen in a turn answers the next three turns and then expires; a new choice replaces it. Kept as state."""
    return remembered(spark, sf).select("conv_id", "turn", "role", "pinned")
