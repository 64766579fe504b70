"""Durable logs: events and served lists, partitioned by tenant and UTC day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "user_id string, event string, ts timestamp, session_id string, request_id string, content_id string, dwell_seconds double, "
    "end_reason string, query_text string, clicked_id string, impressions array<string>, survey_answers map<string,array<string>>, "
    "raw string, event_key string, tenant string, date date, batch string"
)
SERVED_SCHEMA = (
    "request_id string, user_id string, ts timestamp, strategy string, filter string, cold_start boolean, ranking string, distractor_id string, "
    "items array<struct<id string, rank int, role string, relevance_score double, breakdown map<string,double>, features array<double>>>, "
    "tenant string, date date, batch string"
)
EVENT_COLUMNS = (
    "ts", "user_id", "event", "content_id", "session_id", "request_id", "dwell_seconds", "end_reason", "query_text", "clicked_id",
    "impressions", "survey_answers", "raw",
)


def _dated(df: DataFrame, tenant: str) -> DataFrame:
    return df.withColumn("tenant", F.lit(tenant)).withColumn("date", F.to_date("ts"))


# An event is the same delivery again if these agree; unlike a row number, the key doesn't change when a batch is retried.
EVENT_KEY = "sha2(concat_ws('\\x1f', user_id, event, CAST(unix_micros(ts) AS STRING), coalesce(request_id, ''), coalesce(content_id, ''), coalesce(raw, '')), 256)"


def _write(rows: DataFrame, path: str, batch: str | None) -> None:
    """One folder per tenant, day and batch; a batch that is written again replaces its own folders only.

    Rows are rebalanced by day, so a day's files follow its size instead of a fixed number.
    """
    named = rows.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    named.hint("rebalance", "date").write.partitionBy("tenant", "date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_events(events: DataFrame, base: str, tenant: str = "default", batch: str | None = None) -> None:
    """Log events. With a ``batch`` name a retry writes the same rows once."""
    columns = [c for c in EVENT_COLUMNS if c in events.columns]
    full = events
    for c in ("request_id", "content_id", "raw"):
        full = full if c in full.columns else full.withColumn(c, F.lit(None).cast("string"))
    _write(_dated(full.select(*columns, F.expr(EVENT_KEY).alias("event_key")), tenant), f"{base}/events", batch)


def append_served(served: DataFrame, base: str, tenant: str = "default", batch: str | None = None) -> None:
    _write(_dated(served, tenant), f"{base}/served", batch)


def distinct_events(log: DataFrame) -> DataFrame:
    """One row of each delivery, however often it came; rows of old logs without a key all stay.

    Only a 64-bit hash of each key is shuffled. Rows whose hash occurs once are not repeated; the others, repeated or met by
    chance, are the few that are compared by their keys. Where there are few of them, no other row is shuffled.
    """
    marked = log.withColumn("_mark", F.expr("xxhash64(tenant, event_key)"))
    keyed = marked.filter("event_key IS NOT NULL")
    suspects = keyed.groupBy("_mark").agg(F.count("*").alias("n")).filter("n > 1").select("_mark")
    once = marked.join(suspects, "_mark", "left_anti").unionByName(marked.filter("event_key IS NULL").join(suspects, "_mark", "left_semi"))
    again = keyed.join(suspects, "_mark", "left_semi").dropDuplicates(["tenant", "event_key"])
    return once.unionByName(again).select(*log.columns)


def read_events(spark: SparkSession, base: str, distinct: bool = True) -> DataFrame:
    """The event log under its fixed schema; all-null columns of old parts read as null.

    Repeated deliveries are dropped here and not at ingest, where that takes a bound on lateness and loses late events.
    """
    log = spark.read.schema(EVENT_SCHEMA).parquet(f"{base}/events")
    return distinct_events(log) if distinct else log


def read_served(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(SERVED_SCHEMA).parquet(f"{base}/served")


def encode_events(events: DataFrame) -> DataFrame:
    """Flat rows: the nested columns as JSON text, the time as ISO text."""
    kept = [c for c in EVENT_COLUMNS if c in events.columns and c not in ("ts", "impressions", "survey_answers")]
    return events.selectExpr(
        *kept, "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") AS ts", "to_json(impressions) AS impressions",
        "to_json(survey_answers) AS survey_answers",
    )


def decode_events(rows: DataFrame) -> DataFrame:
    """Inverse of ``encode_events``; rows without user, event or readable time are left out."""
    kept = [c for c in rows.columns if c not in ("ts", "impressions", "survey_answers")]
    return rows.selectExpr(
        *kept, "try_to_timestamp(ts) AS ts", "coalesce(from_json(impressions, 'array<string>'), array()) AS impressions",
        "coalesce(from_json(survey_answers, 'map<string,array<string>>'), map()) AS survey_answers",
    ).filter("user_id IS NOT NULL AND event IS NOT NULL AND ts IS NOT NULL")


def reject_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.expr("count_if(user_id IS NULL OR event IS NULL OR try_to_timestamp(ts) IS NULL) AS skipped"))


def within_window(events: DataFrame, now: str, window_days: int = 30) -> DataFrame:
    """Retention of the hot history: events of the last ``window_days`` before ``now``; of a log, only their days are read."""
    since = f"{now} - INTERVAL {int(window_days)} DAYS"
    recent = events.filter(f"ts > {since}")
    return recent.filter(f"date >= CAST({since} AS DATE)") if "date" in events.columns else recent


def served_long(served: DataFrame) -> DataFrame:
    """One row per served item."""
    return served.selectExpr("request_id", "user_id", "ts", "inline(items)").withColumnRenamed("id", "content_id")


def served_tail(served: DataFrame, n: int, user_id: str | None = None) -> DataFrame:
    """Newest n requests, items reduced to id, rank and role.

    A global top n: each task keeps n rows, so the history is never sorted.
    """
    rows = served if user_id is None else served.filter(F.col("user_id") == user_id)
    light = "transform(items, i -> struct(i.id AS id, i.rank AS rank, i.role AS role))"
    return rows.orderBy(F.desc("ts"), F.desc("request_id")).limit(n).withColumn("items", F.expr(light))


def newest_served(spark: SparkSession, base: str, n: int, tenant: str | None = None, user_id: str | None = None) -> DataFrame:
    """The newest n requests of the served log, reading its days from the newest on until they hold n.

    Days are partitions by the request's time, so no older day can hold a newer request. Row counts of whole days come
    from the files' footers; with a visitor, the days read double until enough of its rows are found.
    """
    log = read_served(spark, base)
    log = log if tenant is None else log.filter(F.col("tenant") == tenant)
    days = sorted(((r.date, r["n"]) for r in log.groupBy("date").agg(F.expr("count(*) AS n")).collect()), reverse=True)
    taken, found, step = 0, 0, 1
    while taken < len(days) and found < n:
        some = days[taken : taken + step]
        if user_id is None:
            found += some[0][1]
        else:
            part = log.filter(F.col("date").between(some[-1][0], some[0][0])).filter(F.col("user_id") == user_id)
            found += part.limit(n - found).count()
            step *= 2
        taken += len(some)
    recent = log.filter(F.col("date") >= days[taken - 1][0]) if taken else log.limit(0)
    return served_tail(recent, n, user_id)


def snapshot(events: DataFrame, path: str) -> None:
    """The whole log in time order as gzip CSV, nested columns as JSON text, quotes doubled."""
    encode_events(events).orderBy("ts").write.option("compression", "gzip").option("header", True).option("escape", '"').mode("overwrite").csv(path)


def snapshot_stats(events: DataFrame) -> DataFrame:
    """One row: events, visitors, responded and anonymous visitors, view counts."""
    people = events.groupBy("user_id").agg(
        F.expr("count(*) AS n"), F.expr("bool_or(size(survey_answers) > 0) AS answered"),
        F.expr("count_if(event = 'CONTENT_VIEW_STARTED') AS starts"), F.expr("count_if(startswith(event, 'CONTENT_VIEW')) AS views"),
    )
    return people.agg(
        F.expr("sum(n) AS total_events"), F.expr("count(*) AS total_visitors"), F.expr("count_if(answered) AS survey_responded_visitors"),
        F.expr("count_if(NOT answered) AS anonymous_visitors"), F.expr("sum(starts) AS content_views"), F.expr("sum(views) AS content_view_events"),
    )


def compact(spark: SparkSession, base: str, target: str, rows_per_file: int = 5_000_000, table: str = "events") -> DataFrame:
    """Rewrite a log with few large files per day into ``target``; returns the row counts per day.

    The old files stay until the caller switches readers to ``target``, so a failed run
    loses nothing. A large day is cut into several files instead of passing one task.
    """
    schema = EVENT_SCHEMA if table == "events" else SERVED_SCHEMA
    log = read_events(spark, base) if table == "events" else spark.read.schema(schema).parquet(f"{base}/{table}")
    log = log.drop("batch")
    sizes = log.groupBy("tenant", "date").agg(F.expr(f"CAST(ceil(count(*) / {rows_per_file}D) AS INT) AS files"))
    cut = log.join(sizes, ["tenant", "date"]).withColumn("_cut", F.expr("pmod(xxhash64(request_id, user_id, ts), files)"))
    cut.repartition("tenant", "date", "_cut").drop("files", "_cut").withColumn("batch", F.lit("compact")).write.partitionBy(
        "tenant", "date", "batch").mode("overwrite").parquet(f"{target}/{table}")
    return spark.read.schema(schema).parquet(f"{target}/{table}").groupBy("tenant", "date").agg(F.expr("count(*) AS n"))


def save_model(model: DataFrame, path: str, version: int) -> None:
    """A versioned small model table (policy state, centroids); readers take the latest."""
    model.withColumn("version", F.lit(version)).write.partitionBy("version").mode("append").parquet(path)


def latest_model(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.filter(F.col("version") == table.agg(F.max("version")).scalar()).drop("version")
