"""Visitor models from the durable log, added to as the log grows.

What the log says about a visitor is kept as sums, maxima and minima by (tenant, user) and item, answer or field. These
combine in any order, so a rebuild folds only the batches that no rebuild has folded yet and stores the result as one
more part; a reader combines the parts. An event that is delivered again is found by its key among the events of
its day. A rebuild counts from the moment its commit is written; one that fails before leaves nothing that is read, and
the next takes its place.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.config import RecConfig
from recspark.functions import survey as sv
from recspark.operators import signals as sg
from recspark.session import materialize
from recspark.sources.logs import EVENT_SCHEMA

# Parts after which the next rebuild combines all of them into one.
MOST_PARTS = 16
TENANT = ["tenant", "user_id"]
AT = "struct(ts, event_key)"
BATCHES = "tenant string, date date, batch string, n long"
COMMITS = "whole boolean, n_events long"


def _views(events: DataFrame) -> DataFrame:
    end, rating = f"event = '{sg.VIEW_END}'", "survey_answers['rating']"
    return events.filter("content_id IS NOT NULL").selectExpr(
        *TENANT, "content_id", f"IF(event = '{sg.VIEW_START}', 1L, 0L) AS starts", "dwell_seconds AS dwell", f"IF({end}, struct({AT} AS at, end_reason), NULL) AS reason",
        f"IF({end}, ts, NULL) AS ended", f"IF(event = '{sg.VIEW_START}', ts, NULL) AS started", "ts AS last_ts",
        f"IF({rating} IS NOT NULL, struct({AT} AS at, try_cast(get({rating}, 0) AS DOUBLE) AS value), NULL) AS rating")


def _shown(events: DataFrame) -> DataFrame:
    return events.filter("size(impressions) > 0").selectExpr(*TENANT, "explode(impressions) AS content_id", "ts")


def _answers(events: DataFrame) -> DataFrame:
    return sg.survey_events(events).selectExpr(*TENANT, f"inline({sv.survey_affinity('survey_answers')}) AS (key, amount)")


def _fields(events: DataFrame) -> DataFrame:
    given = sg.survey_events(events).selectExpr(*TENANT, f"{AT} AS at", f"{sv.demographics_of('survey_answers')} AS d")
    entries = ", ".join(f"struct('{f}' AS field, CAST(d.{f} AS STRING) AS value)" for f in sv.DEMO_FIELDS)
    return given.selectExpr(*TENANT, "at", f"inline(array({entries}))").filter("value IS NOT NULL").selectExpr(*TENANT, "field", "struct(at, value) AS latest")


def _people(events: DataFrame) -> DataFrame:
    return events.selectExpr(*TENANT, "1L AS events", "ts AS first_ts", "ts AS last_ts")


# Of each kind: one event as a state, the key beside the visitor, and how two states of a key combine.
KINDS = {
    "views": (_views, ["content_id"], {"starts": "sum", "dwell": "max", "reason": "max", "ended": "max", "started": "min", "last_ts": "max", "rating": "max"}),
    "shown": (_shown, ["content_id"], {"ts": "max"}),
    "answers": (_answers, ["key"], {"amount": "sum"}),
    "fields": (_fields, ["field"], {"latest": "max"}),
    "people": (_people, [], {"events": "sum", "first_ts": "min", "last_ts": "max"}),
}


def combined(states: DataFrame, kind: str) -> DataFrame:
    """One state of each key; partial results are combined before the shuffle."""
    _, key, how = KINDS[kind]
    return states.groupBy(*TENANT, *key).agg(*[F.expr(f"{f}({c}) AS {c}") for c, f in how.items()])


def _schema(spark: SparkSession, kind: str) -> T.StructType:
    events = spark.createDataFrame([], EVENT_SCHEMA)
    return combined(KINDS[kind][0](events), kind).schema


def _commits(spark: SparkSession, state: str) -> list[tuple[int, bool]]:
    """(version, whole) of every finished rebuild, by version. A folder without its mark is of a rebuild that failed."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/commits")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    done = [f.getPath().getName() for f in fs.listStatus(base) if fs.exists(f.getPath().suffix("/_SUCCESS"))]
    versions = sorted(int(name.split("=")[1]) for name in done if name.startswith("version="))
    whole = {r.version for r in spark.read.schema(f"{COMMITS}, version long").parquet(f"{state}/commits").filter("whole").select("version").collect()}
    return [(v, v in whole) for v in versions]


def _live(spark: SparkSession, state: str) -> list[int]:
    """Versions whose parts make up the models: from the last whole one on."""
    commits = _commits(spark, state)
    start = max((v for v, whole in commits if whole), default=-1)
    return [v for v, _ in commits if v >= start]


def _parts(spark: SparkSession, state: str, kind: str, versions: list[int]) -> DataFrame:
    schema = _schema(spark, kind)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())])).parquet(f"{state}/{kind}")
    return rows.filter(F.col("version").isin(versions)).select(*schema.names)


def states(spark: SparkSession, state: str, kind: str, tenant: str | None = None) -> DataFrame:
    """The states of a kind over all live parts; those of one tenant come from its folders only."""
    rows = _parts(spark, state, kind, _live(spark, state))
    return combined(rows if tenant is None else rows.filter(F.col("tenant") == tenant), kind)


def folded_batches(spark: SparkSession, state: str) -> DataFrame:
    """(tenant, date, batch, n) of every batch that a finished rebuild has folded."""
    versions = [v for v, _ in _commits(spark, state)]
    if not versions:
        return spark.createDataFrame([], BATCHES)
    rows = spark.read.schema(f"{BATCHES}, version long").parquet(f"{state}/batches")
    return rows.filter(F.col("version").isin(versions)).select("tenant", "date", "batch", "n")


def _log(spark: SparkSession, base: str, tenant: str | None) -> DataFrame:
    log = spark.read.schema(EVENT_SCHEMA).parquet(f"{base}/events")
    return log if tenant is None else log.filter(F.col("tenant") == tenant)


def new_batches(spark: SparkSession, base: str, state: str, tenant: str | None = None) -> DataFrame:
    """Batches of the log that no rebuild has folded; only partition values and row counts are read.

    A batch whose number of rows is not what it was when it was folded is an error: rebuild into a new folder then.
    """
    present = _log(spark, base, tenant).groupBy("tenant", "date", "batch").agg(F.count("*").alias("n"))
    met = present.join(folded_batches(spark, state).withColumnRenamed("n", "was"), ["tenant", "date", "batch"], "left")
    met = materialize(met)
    changed = met.filter("was <> n").first()
    if changed is not None:
        raise ValueError(f"batch {changed.batch} of {changed.tenant}, {changed.date} had {changed.was} rows when it was folded and has {changed.n}; rebuild from the start")
    return met.filter("was IS NULL").drop("was")


def unfolded_events(spark: SparkSession, base: str, batches: DataFrame, folded: DataFrame, tenant: str | None = None) -> DataFrame:
    """The events of `batches`, each once, without those that a folded batch of the same day holds already.

    An event's key contains its time, so deliveries of it lie in one day: only the days of `batches` are read.
    """
    days = batches.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    log = _log(spark, base, tenant).filter(F.col("date").between(days.lo, days.hi))
    part = ["tenant", "date", "batch"]
    fresh = log.join(batches, part, "left_semi")
    touched = batches.select("tenant", "date").distinct()
    known = log.filter("event_key IS NOT NULL").select(*part, "event_key").join(folded.join(touched, ["tenant", "date"], "left_semi"), part, "left_semi")
    identity = ["tenant", "date", "event_key"]
    keyed = fresh.filter("event_key IS NOT NULL").dropDuplicates(identity).join(known, identity, "left_anti")
    return keyed.unionByName(fresh.filter("event_key IS NULL").select(*keyed.columns))


def rebuild(spark: SparkSession, base: str, state: str, tenant: str | None = None, most_parts: int = MOST_PARTS) -> int | None:
    """Fold what the log at `base` holds beyond the models in `state`; returns the newest version, None without any event.

    One rebuild of a state folder at a time. With `tenant` only its folders of the log are listed and read. Rows without
    a visitor, an event name or a time are not folded. When `most_parts` parts have come together, the rebuild stores
    their combination beside its own part as a whole one; parts and batches before it are not read for models any more.
    """
    commits = _commits(spark, state)
    batches = new_batches(spark, base, state, tenant)
    if batches.isEmpty():
        return commits[-1][0] if commits else None
    version = commits[-1][0] + 1 if commits else 0
    events = unfolded_events(spark, base, batches, folded_batches(spark, state), tenant)
    events = materialize(events.filter("user_id IS NOT NULL AND event IS NOT NULL AND ts IS NOT NULL"))
    live = _live(spark, state)
    whole = len(live) + 1 > most_parts
    for kind, (one, _, _) in KINDS.items():
        part = one(events)
        if whole:
            part = part.unionByName(_parts(spark, state, kind, live))
        combined(part, kind).write.partitionBy("tenant").mode("overwrite").parquet(f"{state}/{kind}/version={version}")
    batches.write.mode("overwrite").parquet(f"{state}/batches/version={version}")
    done = events.agg(F.count("*").alias("n_events")).select(F.lit(whole).alias("whole"), "n_events")
    done.write.mode("overwrite").parquet(f"{state}/commits/version={version}")
    return version


SEPARATOR = "\x1f"


def scoped(df: DataFrame, *columns: str, tenant: str = "tenant") -> DataFrame:
    """`df` with the tenant in front of visitor and item ids, for jobs over all tenants at once; ids of two tenants never meet."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.col(tenant), F.lit(SEPARATOR), F.col(c))) for c in columns})


def unscoped(df: DataFrame, *columns: str, tenant: str = "tenant") -> DataFrame:
    """The inverse of `scoped`, with the tenant as a column of its own."""
    own = F.substring_index(F.col(columns[0]), SEPARATOR, 1).alias(tenant)
    rest = [F.expr(f"substring({c}, instr({c}, char(31)) + 1)").alias(c) if c in columns else F.col(c) for c in df.columns if c != tenant]
    return df.select(own, *rest)


class LoggedModel(sg.VisitorModel):
    """The visitor model over stored states instead of events.

    For one `tenant` ids are as in the log. Without one all tenants are one job: ids of visitors and items carry their
    tenant (`scoped`), in the catalogue and the provider's table too, so every table of the model is keyed by both.
    """

    def __init__(self, spark: SparkSession, state: str, contents: DataFrame, content_tags: DataFrame, vectors: DataFrame, now: datetime, cfg: RecConfig,
                 provider: DataFrame | None = None, tenant: str | None = None, stored: bool = True):
        self.spark, self.state, self.tenant = spark, state, tenant
        super().__init__(None, contents, content_tags, vectors, now, cfg, provider, stored)

    def _states(self, kind: str) -> DataFrame:
        rows = states(self.spark, self.state, kind, self.tenant)
        if self.tenant is None:
            rows = scoped(rows, *[c for c in ("user_id", "content_id") if c in rows.columns])
        return rows.drop("tenant")

    @cached_property
    def views(self) -> DataFrame:
        span = "(unix_micros(ended) - unix_micros(started)) / 1e6D"
        return self._states("views").selectExpr(
            "user_id", "content_id", "greatest(starts, 1L) AS visits", f"coalesce(dwell, greatest({span}, 0D)) AS dwell_seconds", "reason.end_reason AS end_reason",
            "last_ts", "rating.value AS survey_rating")

    @cached_property
    def shown(self) -> DataFrame:
        return self._states("shown").select("user_id", "content_id", "ts")

    @cached_property
    def answer_weights(self) -> DataFrame:
        return self._states("answers").select("user_id", "key", "amount")

    @cached_property
    def answered_demographics(self) -> DataFrame:
        rows = self._states("fields").selectExpr("user_id", "field", "latest.value AS value")
        return rows.groupBy("user_id").agg(*[F.expr(f"max(IF(field = '{f}', value, NULL)) AS {f}") for f in sv.DEMO_FIELDS])

    @cached_property
    def visitors(self) -> DataFrame:
        return self._states("people").select("user_id")
