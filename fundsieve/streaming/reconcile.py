"""Observation runs as a stream: whole runs move the listing state and append life-cycle events.

A run is what one source saw on one date; what it did not see is inactive from then on, so absence only means
something once all rows of a run have arrived. A run's rows may come in any number of micro-batches, in any order and
more than once. Its end is a row without an isin that says how many different listings it saw (`rows`), and a run is
whole when it has that many. Whole runs are applied by date, source and id, and wait for earlier ones that have begun.

Rows are kept in a log by batch and run; counts by batch and run tell which runs may be whole, so only their part of
the log is read. All runs that a batch completes are applied in one job (`timeline`): a listing's rows are sorted by
run, and a row lasts until the source's next run unless the listing is seen again by then.

Every place is named after its batch and written anew when a batch is repeated; the ledger of applied runs comes last.
A stream that is killed anywhere and started again with its checkpoint gives the same state and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("isin", "venue_mic", "ticker")
STATE = "isin string, venue_mic string, ticker string, data_source string, status string"
OBSERVATIONS = "run_id string, source_name string, asof_date string, isin string, venue_mic string, ticker string, rows long"
COUNTS = "run_id string, source_name string, asof_date string, n long, rows long, batch long"
LEDGER = "run_id string, state long, batch long"
EVENTS = "entity_type string, isin string, venue_mic string, ticker string, previous_status string, new_status string, event_type string, run_id string, source_name string, asof_date string"
#: After the last run.
NEVER = 2**31 - 1


def timeline(listing: DataFrame, seen: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listing state after all runs, and the events of listings and instruments in each of them.

    listing: KEYS, data_source, status. seen: KEYS and run_id, of these runs only. runs: run_id, source_name,
    asof_date, one row each; they are applied by date, source and id.
    """
    # runs are as many as sources and dates that have come since the last batch, and listings of one key as many as runs
    order = Window.orderBy("asof_date", "source_name", "run_id")
    placed = F.broadcast(runs.withColumn("pos", F.row_number().over(order)))
    follows = F.broadcast(placed.select("pos", "run_id", "source_name", F.lead("pos").over(Window.partitionBy("source_name").orderBy("pos")).alias("following")))
    first = F.broadcast(placed.groupBy("source_name").agg(F.min("pos").alias("following")))
    old = listing.join(first, F.col("data_source") == F.col("source_name"), "left").select(*KEYS, "data_source", "status", F.lit(0).alias("pos"), "following")
    new = seen.select(*KEYS, "run_id").distinct().join(follows, "run_id").select(*KEYS, F.col("source_name").alias("data_source"), F.lit("active").alias("status"), "pos", "following")
    by_key = Window.partitionBy(*KEYS).orderBy("pos")
    again, last = F.coalesce(F.lead("pos").over(by_key), F.lit(NEVER)), F.lead("pos").over(by_key).isNull()
    ends = F.when(F.col("status") != "active", 0).when(F.col("following") < F.col("again"), F.col("following")).otherwise(F.col("again"))
    rows = old.unionByName(new).withColumns({"again": again, "last": last}).withColumn("until", ends)
    rows = rows.withColumn("before", F.lag("until").over(by_key))
    after = rows.where("last").select(*KEYS, "data_source", F.when(F.col("until") == NEVER, "active").otherwise("inactive").alias("status"))
    changes = turns(rows.where("pos > 0 and (before is null or before < pos)"), rows.where("status = 'active' and until < again"))
    both = changes.select(F.lit("listing").alias("entity_type"), *KEYS, "at", "event_type").unionByName(instrument_turns(rows))
    previous = F.when(F.col("event_type") == "reactivated", "inactive").when(F.col("event_type") == "deactivated", "active")
    now = F.when(F.col("event_type") == "deactivated", "inactive").otherwise("active")
    told = both.join(placed.withColumnRenamed("pos", "at"), "at").withColumns({"previous_status": previous, "new_status": now})
    return after, told.select(*[c.split()[0] for c in EVENTS.split(", ")])


def turns(begun: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows that begin (`before`: until when there was one) and that end, as events at a run."""
    appears = begun.select(*KEYS, F.col("pos").alias("at"), F.when(F.col("before").isNull(), "inserted").otherwise("reactivated").alias("event_type"))
    return appears.unionByName(ended.select(*KEYS, F.col("until").alias("at"), F.lit("deactivated").alias("event_type")))


def instrument_turns(rows: DataFrame) -> DataFrame:
    """The same of instruments, which are active while any of their listings is: unions of the listings' intervals."""
    by_start = Window.partitionBy("isin").orderBy("pos", "until")
    reach = F.max("until").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # a listing that was inactive before reaches nowhere (0) and still tells that the instrument is known
    spans = rows.select("isin", "pos", "until", "status").withColumn("reach", reach)
    opens = (F.col("status") == "active") & (F.col("reach").isNull() | (F.col("reach") < F.col("pos")) | (F.col("reach") == 0))
    island = F.sum(F.when(opens, 1).otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    since = F.min(F.when(F.col("status") == "active", F.col("pos"))).alias("pos")
    islands = spans.withColumn("island", island).groupBy("isin", "island").agg(since, F.max("until").alias("until"))
    known = Window.partitionBy("isin").orderBy("island")
    told = islands.withColumn("before", F.lag("until").over(known)).where("pos is not null")
    whole = told.select("isin", F.lit(None).cast("string").alias("venue_mic"), F.lit(None).cast("string").alias("ticker"), "pos", "until", "before")
    return turns(whole.where("pos > 0"), whole.where(F.col("until") < NEVER)).select(F.lit("instrument").alias("entity_type"), *KEYS, "at", "event_type")


def read_back(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """The rows of all batches before one; no rows where nothing has been written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < before)


def current(spark: SparkSession, path: str, before: int = 2**62) -> DataFrame:
    """The listing state that the runs applied in batches before one have left."""
    version = read_back(spark, f"{path}/ledger", LEDGER, before).agg(F.max("state")).first()[0]
    return spark.createDataFrame([], STATE) if version is None else spark.read.schema(STATE).parquet(f"{path}/state/{version}")


def whole_runs(log: DataFrame, counts: DataFrame, ledger: DataFrame) -> list[tuple[str, str, str]]:
    """(date, source, id) of the runs that may be applied now, in order; only open runs come to the driver."""
    open_ = counts.groupBy("run_id").agg(F.max("source_name").alias("source_name"), F.max("asof_date").alias("asof_date"), F.sum("n").alias("n"), F.max("rows").alias("rows"))
    open_ = open_.join(ledger, "run_id", "left_anti").orderBy("asof_date", "source_name", "run_id").collect()
    perhaps = [r.run_id for r in open_ if r.rows is not None and r.n >= r.rows]
    if not perhaps:
        return []
    seen = log.where(F.col("run_id").isin(perhaps) & F.col("isin").isNotNull()).select("run_id", *KEYS).distinct().groupBy("run_id").count()
    distinct = {r.run_id: r["count"] for r in seen.collect()}
    found = []
    for r in open_:
        if r.rows is None or distinct.get(r.run_id, 0) < r.rows:
            break  # later runs wait for it
        found.append((r.asof_date, r.source_name, r.run_id))
    return found


def reconcile_stream(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply the runs of a stream of observations; log, states and events are under `path`.

    Rows without a run are of no run and are left out.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.where("run_id is not null").write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/log/batch={number}")
        log = read_back(spark, f"{path}/log", f"{OBSERVATIONS}, batch long", number + 1)
        mine = log.where(F.col("batch") == number).groupBy("run_id").agg(F.max("source_name").alias("source_name"), F.max("asof_date").alias("asof_date"), F.count("isin").alias("n"), F.max("rows").alias("rows"))
        mine.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        ledger = read_back(spark, f"{path}/ledger", LEDGER, number)
        found = whole_runs(log, read_back(spark, f"{path}/counts", COUNTS, number + 1), ledger)
        if not found:
            return
        runs = spark.createDataFrame(found, "asof_date string, source_name string, run_id string")
        seen = log.where(F.col("run_id").isin([r[2] for r in found]) & F.col("isin").isNotNull())
        after, events = timeline(current(spark, path, number), seen, runs)
        after.write.mode("overwrite").parquet(f"{path}/state/{number}")
        events.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        runs.select("run_id", F.lit(number).cast("long").alias("state")).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The events of all applied runs."""
    applied = read_back(spark, f"{path}/ledger", LEDGER, 2**62).select("batch").distinct()
    return read_back(spark, f"{path}/events", f"{EVENTS}, batch long", 2**62).join(applied, "batch", "left_semi").drop("batch")
