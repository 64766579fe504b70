"""Batch reads of the older relational store (raw visitor events and profiles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], key: str, low: int, high: int,
               partitions: int) -> DataFrame:
    """A JDBC table read in parallel ranges of a numeric key; filters are pushed down."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties)


def raw_events(rows: DataFrame) -> DataFrame:
    """``user_event`` rows to the shape ``sessions.paired_dwell`` reads."""
    return rows.selectExpr(
        "CAST(user_id AS STRING) AS user_id", "coalesce(get_json_object(event_payload, '$.item_id'), CAST(item_id AS STRING)) AS item_id",
        "id AS event_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts",
    )


def profiles(rows: DataFrame) -> DataFrame:
    """Visitor rows to the provider overlay of the visitor model."""
    return rows.selectExpr("CAST(id AS STRING) AS user_id", "CAST(age AS STRING) AS age", "gender", "nationality",
                           "CAST(personal_connection AS STRING) AS personal_connection")
