"""Queries of event windows: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.plans.registry import query
from strandlake.plans.tables import minutes, read
from strandlake.streaming import kmers as S


@query("SELECT cast(floor(epoch(ts)) AS BIGINT) // 3600 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hour", F.floor(minutes("ts") / 60))
    return e.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS q FROM g) SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, q, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL")
def event_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    return S.sessions(e, "user_id", "30 minutes", "1 hour").groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("SELECT cast(floor(epoch(ts)) AS BIGINT) // 86400 AS day, k AS kmer, count(*) AS n FROM (SELECT ts, unnest(list_transform(range(1, length(event_type)), lambda i: substr(event_type, i, 2))) AS k FROM (SELECT ts, translate(event_type, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS event_type FROM events)) WHERE length(k) = 2 GROUP BY ALL")
def streaming_kmers(spark, sf_dir):
    from strandlake.functions.sequence import text_to_dna
    from strandlake.operators.space import KmerSpace

    e = read(spark, sf_dir, "events").select("ts", text_to_dna("event_type").alias("seq"))
    days = S.windowed_counts(e, KmerSpace(2), "1 day", "2 days")
    return days.select(F.datediff(F.to_date("window_start"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), "kmer", "n")
