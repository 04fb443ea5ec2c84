"""Registered queries that run streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ranks import durable, shared_dir
from ..streaming import reconcile
from .catalogue import query, t

#: Micro-batches that the events come in; their bounds are times and lie within the days that are runs.
SLICES = 4


@query(
    """WITH o AS (SELECT DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'app' END AS source_name, strftime(ts, '%Y-%m-%d') AS asof_date, 'U' || user_id AS isin, 'V' || (floor(value)::BIGINT % 3) AS venue_mic, 'T' AS ticker FROM events),
    r AS (SELECT source_name, asof_date, source_name || '-' || asof_date AS run_id, row_number() OVER (ORDER BY asof_date, source_name) AS pos FROM (SELECT DISTINCT source_name, asof_date FROM o)),
    g AS (SELECT k.*, r.*, o.isin IS NOT NULL AS seen FROM (SELECT DISTINCT isin, venue_mic, ticker FROM o) k CROSS JOIN r LEFT JOIN o USING (isin, venue_mic, ticker, source_name, asof_date)),
    s AS (SELECT *, max(CASE WHEN seen THEN pos END) OVER w AS last_seen, max(CASE WHEN source_name = 'web' THEN pos END) OVER w AS web, max(CASE WHEN source_name = 'app' THEN pos END) OVER w AS app FROM g WINDOW w AS (PARTITION BY isin, venue_mic, ticker ORDER BY pos)),
    l AS (SELECT *, CASE WHEN last_seen IN (web, app) THEN 'active' WHEN last_seen IS NOT NULL THEN 'inactive' END AS status FROM s),
    i AS (SELECT isin, NULL AS venue_mic, NULL AS ticker, pos, run_id, source_name, asof_date, CASE WHEN bool_or(status = 'active') THEN 'active' WHEN bool_or(status = 'inactive') THEN 'inactive' END AS status FROM l GROUP BY isin, pos, run_id, source_name, asof_date),
    a AS (SELECT 'listing' AS entity_type, isin, venue_mic, ticker, pos, run_id, source_name, asof_date, status FROM l UNION ALL SELECT 'instrument', isin, venue_mic, ticker, pos, run_id, source_name, asof_date, status FROM i),
    e AS (SELECT *, lag(status) OVER (PARTITION BY entity_type, isin, venue_mic, ticker ORDER BY pos) AS previous_status FROM a)
    SELECT entity_type, isin, venue_mic, ticker, previous_status, status AS new_status, CASE WHEN status = 'inactive' THEN 'deactivated' WHEN previous_status IS NULL THEN 'inserted' ELSE 'reactivated' END AS event_type, run_id, source_name, asof_date FROM e WHERE status IS DISTINCT FROM previous_status
    UNION ALL SELECT 'state', isin, venue_mic, ticker, NULL, status, NULL, NULL, CASE WHEN last_seen = web THEN 'web' WHEN last_seen = app THEN 'app' ELSE (SELECT source_name FROM r WHERE r.pos = last_seen) END, NULL FROM l WHERE pos = (SELECT max(pos) FROM r)"""
)
def stream_runs(spark, sf_dir):
    """Life-cycle events and the last state of listings whose daily runs come in micro-batches that cut days in two."""
    source = F.when(F.col("event_type").isin("click", "view"), "web").otherwise("app")
    day = F.date_format("ts", "yyyy-MM-dd")
    seen = t(spark, sf_dir, "events").select(
        F.concat_ws("-", source, day).alias("run_id"),
        source.alias("source_name"),
        day.alias("asof_date"),
        F.concat(F.lit("U"), F.col("user_id")).alias("isin"),
        F.concat(F.lit("V"), F.floor("value") % 3).alias("venue_mic"),
        F.lit("T").alias("ticker"),
        F.lit(None).cast("long").alias("rows"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    none = [F.lit(None).cast("string").alias(c) for c in reconcile.KEYS]
    ends = seen.groupBy("run_id", "source_name", "asof_date").agg(F.count_distinct(*reconcile.KEYS).alias("rows"), F.max("ts").alias("ts"))
    rows = seen.unionByName(ends.select("run_id", "source_name", "asof_date", *none, "rows", "ts"))
    span = seen.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z")).first()
    part = F.floor((F.unix_micros("ts") - (span.a or 0)) * SLICES / ((span.z or 0) - (span.a or 0) + 1)).cast("int")
    rows = durable(rows.withColumn("slice", part).drop("ts"), "stream-rows")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(SLICES):
        rows.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(reconcile.OBSERVATIONS).parquet(f"{path}/in")
        reconcile.reconcile_stream(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    events = reconcile.events_so_far(spark, f"{path}/out")
    last = reconcile.current(spark, f"{path}/out").withColumnsRenamed({"data_source": "source_name", "status": "new_status"})
    return events.unionByName(last.withColumn("entity_type", F.lit("state")), allowMissingColumns=True)
