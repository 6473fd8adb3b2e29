"""Streaming forms of the event analyses: daily tool totals and an ordered fold of reinforcement events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.retrieval import stream_daily

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The events of a folder as a stream with an event-time timestamp."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    return stream_daily(events, late)


def confidence_fold(events: DataFrame) -> DataFrame:
    """user_id, verified, negated, confidence after each batch: a signup verifies (a quarter each, at most 1), an error negates. State is two counts for each key."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        good, bad = state.get if state.exists else (0, 0)
        for pdf in batches:
            good += int((pdf["event_type"] == "signup").sum())
            bad += int((pdf["event_type"] == "error").sum())
        state.update((good, bad))
        yield pd.DataFrame([(key[0], good, bad, min(1.0, 0.25 * good))], columns=["user_id", "verified", "negated", "confidence"])

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, verified long, negated long, confidence double", "good long, bad long", "update", "NoTimeout")
