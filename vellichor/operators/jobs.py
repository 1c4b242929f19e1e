"""Prompts for a language model as tables: sizes, costs, ceilings. The model itself is a transport of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN, CONTEXT_CHARS_PER_TOKEN = 3, 2.6


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def costs(rows: DataFrame, by: str, dollars_per_million: float) -> DataFrame:
    total = F.sum(tokens(F.col("text")))
    return rows.groupBy(by).agg(F.count("*").alias("n"), total.alias("tokens"), F.round(total * dollars_per_million / 1e6, 6).alias("cost"))


def chunk_chars(context_tokens: int, overhead_tokens: int = 0) -> int:
    return int(min(60_000, max(6_000, (0.6 * context_tokens - overhead_tokens) * CONTEXT_CHARS_PER_TOKEN)))


def within_ceiling(jobs: DataFrame, ceiling: float) -> DataFrame:
    """Jobs (run, job, cost) that start before the run's ceiling is reached."""
    order = Window.partitionBy("run").orderBy("job").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return jobs.withColumn("total", F.sum("cost").over(order)).filter(F.col("total") <= ceiling)


def answered(prompts: DataFrame, transport: Callable[[str], str], attempts: int = 4) -> DataFrame:
    """(id, answer, error) of prompts (id, prompt); a failing call is tried again."""

    def ask(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return transport(prompt), None
            except Exception as failed:  # the transport's own errors are results here
                error = type(failed).__name__
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *ask(p)) for i, p in zip(batch["id"], batch["prompt"])], columns=["id", "answer", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, "id long, answer string, error string")


def resolved(merges: DataFrame, depth: int = 10) -> DataFrame:
    """Ends of merge chains a -> b -> c. merges: (from_id, to_id), one row per from_id."""
    rows = merges.select("from_id", F.col("to_id").alias("last"))
    step = merges.select(F.col("from_id").alias("last"), F.col("to_id").alias("next"))
    for _ in range(max(1, depth.bit_length())):  # doubling
        doubled = rows.join(step, "last", "left").select("from_id", F.coalesce("next", "last").alias("last"))
        rows, step = doubled, step.join(step.select(F.col("last").alias("next"), F.col("next").alias("far")), "next", "left").select("last", F.coalesce("far", "next").alias("next"))
    return rows.filter("from_id <> last")
