"""Marker colours: book-wide slots for the figures with most lines, chapter slots for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS, LEAST_LINES = 12, 4


def global_slots(cast: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(book_id, speaker, slot). forced: (book_id, speaker, slot) that users chose; the figure with more lines keeps a doubly chosen slot."""
    order = Window.partitionBy("book_id").orderBy(F.desc("lines"), "name", "speaker")
    if forced is None:
        return cast.filter(F.col("lines") >= LEAST_LINES).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SLOTS).select("book_id", "speaker", (F.col("k") - 1).cast("long").alias("slot"))
    chosen = cast.join(forced, ["book_id", "speaker"]).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "slot").orderBy(F.desc("lines"), "name", "speaker"))).filter("k = 1").select("book_id", "speaker", F.col("slot").cast("long").alias("slot"))
    taken = chosen.groupBy("book_id").agg(F.collect_set("slot").alias("taken"))
    rest = cast.join(chosen, ["book_id", "speaker"], "left_anti").filter(F.col("lines") >= LEAST_LINES).withColumn("k", F.row_number().over(order)).join(taken, "book_id", "left")
    free = F.array_except(F.sequence(F.lit(0), F.lit(SLOTS - 1)).cast("array<long>"), F.coalesce("taken", F.array().cast("array<long>")))
    return chosen.unionByName(rest.select("book_id", "speaker", F.get(free, F.col("k") - 1).alias("slot")).filter("slot is not null"))


def chapter_slots(spoken: DataFrame, slots: DataFrame) -> DataFrame:
    """(book_id, chapter_ord, speaker, slot) for figures without a book-wide slot, by first appearance; null when none is left. spoken: (book_id, chapter_ord, block_ord, span_ix, speaker)."""
    first = spoken.filter("speaker is not null").groupBy("book_id", "chapter_ord", "speaker").agg(F.min(F.struct("block_ord", "span_ix")).alias("first"))
    rows = first.join(slots, ["book_id", "speaker"], "left")
    taken = rows.filter("slot is not null").groupBy("book_id", "chapter_ord").agg(F.collect_set("slot").alias("taken"))
    local = rows.filter("slot is null").drop("slot").join(taken, ["book_id", "chapter_ord"], "left")
    k = F.row_number().over(Window.partitionBy("book_id", "chapter_ord").orderBy("first"))
    free = F.array_except(F.sequence(F.lit(0), F.lit(SLOTS - 1)).cast("array<long>"), F.coalesce("taken", F.array().cast("array<long>")))
    return local.withColumn("k", k).select("book_id", "chapter_ord", "speaker", F.get(free, F.col("k") - 1).alias("slot"))


def slot_of(spoken: DataFrame, slots: DataFrame, local: DataFrame) -> DataFrame:
    """Book-wide slot, else the chapter's, else null."""
    return spoken.join(slots.withColumnRenamed("slot", "wide"), ["book_id", "speaker"], "left").join(local.withColumnRenamed("slot", "near"), ["book_id", "chapter_ord", "speaker"], "left").withColumn("slot", F.coalesce("wide", "near")).drop("wide", "near")
