"""Ordered folds over keys of any size.

A table sorted by (key, order) is cut into segments, the rows of one key in one partition. A segment is summed up by a
function of the state that reaches it; the functions of neighbouring segments compose, which gives each segment its
state, and with it every row's. So a key with any share of the rows is as many tasks as it has segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.session import partitions, staged

ROWS = 250_000  # of numbers, in a partition
SEGMENT = 4096  # rows that one aggregate folds


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted and dealt by ranges of order, at most about ROWS in each."""
    n = max(partitions(rows.sparkSession), math.ceil(rows.count() / ROWS))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


# greedy packing -----------------------------------------------------------------------------------------------------


def next_starts(sums: np.ndarray, most: int) -> np.ndarray:
    """For each block where the chunk after the one that begins with it begins; sums: characters before each block, and of all."""
    return np.maximum(np.arange(1, len(sums)), np.searchsorted(sums, sums[:-1] + most, "right") - 1)


def packed(sums: np.ndarray, most: int, first: int = 0) -> np.ndarray:
    """The starts of the chunks from block `first` on."""
    starts, n, at = [], len(sums) - 1, first
    while at < n:
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
    return np.array(starts, np.int64)


def summary(sums: np.ndarray, most: int) -> tuple[list[int], list[int], list[int]]:
    """What a segment does with a chunk of u characters that is open where it begins, as steps.

    The first block k with u + sums[k + 1] > most opens a chunk, from where on nothing depends on u. Steps in falling
    order of bound: the first bound below u has the characters of the chunk that is open at the end, and how many began.
    """
    n = len(sums) - 1
    used, begun = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    following = next_starts(sums, most)
    used[:n] = sums[n] - sums[:n]
    for at in range(n - 1, -1, -1):  # chunks merge, so this is one step a block
        to = following[at]
        begun[at] = 1 + begun[to]
        if to < n:
            used[at] = used[to]
    bounds = most - sums[1:]
    last = np.append((used[1:n] != used[: n - 1]) | (begun[1:n] != begun[: n - 1]), True) if n else np.zeros(0, bool)
    keep = last & (bounds >= 0) | (np.arange(n) == int(np.argmax(bounds < 0)) if n and (bounds < 0).any() else np.zeros(n, bool))
    return bounds[keep].tolist(), used[:n][keep].tolist(), begun[:n][keep].tolist()


def after(u: int, total: int, most: int, steps: tuple[list[int], list[int], list[int]]) -> tuple[int, int]:
    """(characters of the chunk that is open at the segment's end, chunks that began in it)."""
    if u + total <= most:
        return u + total, 0
    return next((used, begun) for bound, used, begun in zip(*steps) if u > bound)


ROW = "book_id long, chapter_ord long, block_ord long, part int, segment int, n long, place long, chunk long"
EDGE = "blocks long, total long, used long, begun long, bounds array<long>, outs array<long>, counts array<long>"


def _segments(rows: pd.DataFrame) -> list[tuple[int, int]]:
    key = rows[["book_id", "chapter_ord"]].to_numpy()
    begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(rows) else np.zeros(0, int)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]))


def chunks(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks (book_id, chapter_ord, block_ord, text) of a chapter in chunks of at most so many characters, filled greedily in order: (book_id, chapter_ord, block_ord, place, chunk). A longer block is a chunk of its own; place counts a chapter's blocks.

    Every segment is packed as if its chapter began there, which is right for all but those that go on from an earlier
    partition; of a partition's first and last segment a summary reaches the driver, two rows a partition. Segments
    that go on are packed again from the state that the summaries give them.
    """
    keys = ["book_id", "chapter_ord", "block_ord"]
    rows = dealt(blocks.select(*(F.col(k).cast("long").alias(k) for k in keys), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")), *keys)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        parts = _segments(rows)
        n, place, chunk, segment = rows["n"].to_numpy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32)
        edges = []
        for k, (a, z) in enumerate(parts):
            sums = np.append(0, np.cumsum(n[a:z]))
            starts = packed(sums, most)
            marks = np.zeros(z - a, np.int64)
            marks[starts[1:]] = 1
            place[a:z], chunk[a:z], segment[a:z] = np.arange(z - a), np.cumsum(marks), k
            if k in (0, len(parts) - 1):
                edges.append((*(int(rows[c][a]) for c in ("book_id", "chapter_ord", "block_ord", "part")), k, z - a, int(sums[-1]), int(sums[-1] - sums[starts[-1]]), len(starts), *summary(sums, most)))
        yield rows.assign(segment=segment, place=place, chunk=chunk, blocks=pd.array([None] * len(rows), "Int64"), total=0, used=0, begun=0, bounds=None, outs=None, counts=None)[NAMES]
        edge = pd.DataFrame(edges, columns=["book_id", "chapter_ord", "block_ord", "part", "segment", *(x.split()[0] for x in EDGE.split(", "))])
        yield edge.assign(n=0, place=0, chunk=0)[NAMES]

    found = staged(rows.withColumn("part", F.spark_partition_id()).mapInPandas(pack, f"{ROW}, {EDGE}"))
    entries: dict[int, tuple[int, int, int]] = {}  # part -> open characters, number of the open chunk, blocks before
    last: tuple | None = None  # chapter, open characters, number of the open chunk, blocks so far
    for e in sorted(found.filter("blocks is not null").collect(), key=lambda e: (e.part, e.segment)):
        chapter = (e.book_id, e.chapter_ord)
        if last is not None and last[0] == chapter and e.segment == 0:
            _, u, number, before = last
            entries[e.part] = (u, number, before)
            used, begun = after(u, e.total, most, (e.bounds, e.outs, e.counts))
            last = (chapter, used, number + begun, before + e.blocks)
        else:
            last = (chapter, e.used, e.begun - 1, e.blocks)
    rows = found.filter("blocks is null")
    out = [*keys, "place", "chunk"]
    if not entries:
        return rows.select(*out)

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        u, number, before = entries[int(rows["part"][0])]
        sums = np.append(0, np.cumsum(rows["n"].to_numpy()))
        first = int(np.searchsorted(sums[1:], most - u, "right"))
        marks = np.zeros(len(rows), np.int64)
        marks[packed(sums, most, first)] = 1
        return rows.assign(place=rows["place"] + before, chunk=number + np.cumsum(marks))[out]

    goes_on = F.col("part").isin(list(entries)) & (F.col("segment") == 0)
    return rows.filter(~goes_on).select(*out).unionByName(rows.filter(goes_on).groupBy("part").applyInPandas(again, "book_id long, chapter_ord long, block_ord long, place long, chunk long"))


NAMES = [x.split()[0] for x in f"{ROW}, {EDGE}".split(", ")]


def with_context(chunked: DataFrame, blocks: int = 3) -> DataFrame:
    """(book_id, chapter_ord, chunk, block_ord, context): the blocks of each chunk, and as context those just before it."""
    keys = ["book_id", "chapter_ord"]
    firsts = chunked.filter("chunk > 0").groupBy(*keys, "chunk").agg(F.min("place").alias("first"))
    near = firsts.select(*keys, "chunk", F.explode(F.sequence(F.greatest(F.col("first") - blocks, F.lit(0)), F.col("first") - 1)).alias("place"))
    own = chunked.select(*keys, "chunk", "block_ord", F.lit(False).alias("context"))
    return own.unionByName(near.join(chunked.select(*keys, "place", "block_ord"), [*keys, "place"]).select(*keys, "chunk", "block_ord", F.lit(True).alias("context")))


# running means ------------------------------------------------------------------------------------------------------


def _composed(maps: Column) -> Column:
    """The composition of affine maps x -> a x + b (b for prompts and for output), in order; samples of the last."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("prompt"), F.lit(0.0).alias("output"), F.lit(0.0).alias("samples"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc.a * x.a).alias("a"), (acc.prompt * x.a + x.prompt).alias("prompt"), (acc.output * x.a + x.output).alias("output"), x.samples.alias("samples"))

    return F.aggregate(maps, start, add)


def speed(samples: DataFrame, by: str, most: int = 200_000) -> DataFrame:
    """(by, prompt_tps, output_tps, samples): running mean of tokens a second, weighted by tokens; old samples fade once their weight reaches `most`.

    samples: (by, seq, prompt_ms, prompt_tokens, output_ms, output_tokens); one without any of these numbers is not
    counted. The weight of what came before a sample is min(most, sum of the weights before it), so each sample is an
    affine map of the mean, and maps compose: SEGMENT of them at a time, until each key has one.
    """
    numbers = ["prompt_ms", "prompt_tokens", "output_ms", "output_tokens"]
    rows = samples.select(by, "seq", *(F.col(c).cast("double").alias(c) for c in numbers)).filter(" and ".join(f"coalesce({c}, 0) <> 0" for c in numbers))
    rows = dealt(rows, by, "seq").withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows.select(by, "at", F.shiftright("at", 12).alias("segment"), (F.col("prompt_tokens") + F.col("output_tokens")).alias("w"), (F.col("prompt_tokens") / (F.col("prompt_ms") / 1000)).alias("p"), (F.col("output_tokens") / (F.col("output_ms") / 1000)).alias("o")))
    along = Window.partitionBy(by).orderBy("segment")
    sums = rows.groupBy(by, "segment").agg(F.sum("w").alias("w"))
    sums = sums.select(by, "segment", F.coalesce(F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("earlier"), (F.row_number().over(along) - 1).alias("k"))
    inside = F.sum("w").over(Window.partitionBy(by, "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0.0))).join(sums, [by, "segment"])
    old = F.least(F.col("earlier") + F.col("inside"), F.lit(float(most)))
    share = F.col("w") / (old + F.col("w"))
    maps = F.struct("at", (old / (old + F.col("w"))).alias("a"), (F.col("p") * share).alias("prompt"), (F.col("o") * share).alias("output"), (old + F.col("w")).alias("samples"))
    level = staged(rows.groupBy(by, "k").agg(_composed(F.array_sort(F.collect_list(maps))).alias("x")).select(by, "k", "x.*"))
    while (level.agg(F.max("k")).first()[0] or 0) > 0:
        group = F.floor(F.col("k") / SEGMENT).cast("int").alias("group")
        maps = F.struct("k", "a", "prompt", "output", "samples")
        level = staged(level.groupBy(by, group).agg(_composed(F.array_sort(F.collect_list(maps))).alias("x")).select(by, F.col("group").alias("k"), "x.*"))
    return level.select(by, F.col("prompt").alias("prompt_tps"), F.col("output").alias("output_tps"), "samples")


# running sums -------------------------------------------------------------------------------------------------------


def running(rows: DataFrame, by: str, order: str, totals: dict[str, str]) -> DataFrame:
    """rows with running sums ({new column: summed column}) along `by` by `order` (null keys are one key): sums inside segments, plus those of the segments before."""
    at = dealt(rows, by, order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_segment", F.shiftright("_at", 12))
    at = staged(at)
    sums = at.groupBy(by, "_segment").agg(*(F.sum(c).alias(f"_{n}") for n, c in totals.items()))
    before = Window.partitionBy(by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("_segment").alias("_of"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals))
    inside = Window.partitionBy(by, "_segment").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumns({n: F.sum(c).over(inside) for n, c in totals.items()}).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_segment") == F.col("_of")))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop("_at", "_segment", "_by", "_of", *(f"_{n}" for n in totals))
