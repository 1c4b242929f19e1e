"""Journals as streams: the current decision for each target, and activity in windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and hour; later ones than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


OUTCOMES = "book_id long, device string, seq long, outcome string"


def handed_over(edits: DataFrame) -> DataFrame:
    """Edits (book_id, device, seq) from change logs: applied once in order of arrival, unchanged if already seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        for batch in batches:
            out = []
            for seq in sorted(batch["seq"]):
                out.append((*key, seq, "applied" if seq > last else "unchanged"))
                last = max(last, seq)
            yield pd.DataFrame(out, columns=["book_id", "device", "seq", "outcome"])
        state.update((int(last),))

    return edits.groupBy("book_id", "device").applyInPandasWithState(step, OUTCOMES, "last long", "append", GroupStateTimeout.NoTimeout)
