"""State of question sessions as queries: cached results, retries, bounded fan-out, pinned data sets."""

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import session as S
from kgloom.registry import query
from kgloom.sources.readers import scratch
from kgloom.streaming import memory
from kgloom.streaming import pipelines as P


@query("m06_result_cache", "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), nxt AS (SELECT a.user_id, a.event_type, a.n, min(b.n) AS after FROM e a JOIN e b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.n > a.n AND b.ts > a.ts + INTERVAL 300 SECOND GROUP BY ALL), r AS (SELECT user_id, event_type, 1::BIGINT AS n FROM e WHERE n = 1 UNION ALL SELECT r.user_id, r.event_type, nxt.after FROM r JOIN nxt ON nxt.user_id = r.user_id AND nxt.event_type = r.event_type AND nxt.n = r.n) SELECT e.event_id, r.n IS NULL AS hit FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.event_type = e.event_type AND r.n = e.n")
def m06(spark, sf):
    """Which events a cache of results answers: the key is the kind of event, entries live 300 seconds from when they were made, and
    a user has 1000 at most. The cache is a stream's state, kept over a restart between the two halves of the events."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path, out, ck = (scratch(spark, n) for n in ("events-in", "answers", "answers-ck"))
    seconds = e.withColumn("at", F.unix_micros("ts"))
    memory.in_runs(spark, seconds, "at", path, 2, lambda: P.run_once(memory.answering(P.files(spark, path, seconds), "user_id", "event_type", "at", "event_id"), out, ck))
    return spark.read.parquet(out).select("event_id", "hit")


@query("m08_bounded_fan_out", "SELECT page_id, length(html)::INT AS size FROM pages")
def m08(spark, sf):
    """Ten calls at a time in each task, answers in the order of the rows: for remote calls that mostly wait."""

    def run(batches):
        with ThreadPoolExecutor(max_workers=10) as pool:
            for pdf in batches:
                yield pd.DataFrame({"page_id": pdf["page_id"], "size": list(pool.map(len, pdf["html"]))}, columns=["page_id", "size"])

    return table(spark, sf, "pages").select("page_id", "html").mapInPandas(run, "page_id long, size int")


@query("m09_retries", "SELECT event_id, least(event_id % 6 + 1, 4)::INT AS attempts, event_id % 6 < 4 AS done, (CASE least(event_id % 6, 3) WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 ELSE 3.5 END)::DOUBLE AS waited FROM events")
def m09(spark, sf):
    """Calls that fail a number of times before they succeed; waits are noted, not slept."""

    def run(batches):
        for pdf in batches:
            rows = []
            for e in pdf["event_id"]:
                waits, calls = [], []

                def call(e=e, calls=calls):
                    calls.append(1)
                    if len(calls) <= e % 6:
                        raise TimeoutError

                try:
                    S.with_retries(call, (TimeoutError,), sleep=waits.append)
                    done = True
                except TimeoutError:
                    done = False
                rows.append((e, len(calls), done, float(sum(waits))))
            yield pd.DataFrame(rows, columns=["event_id", "attempts", "done", "waited"])

    return table(spark, sf, "events").select("event_id").mapInPandas(run, "event_id long, attempts int, done boolean, waited double")
