"""Links between components that share a key, for sets that link at a Jaccard similarity of 3/4.

A key's rows are dealt by node over blocks of about BLOCK rows, and every pair of blocks is a cell of its own, so a key
with any share of the rows is many tasks, none of which holds more than two blocks. In a cell only pairs of different
components, of compatible sizes and with parity bitmaps that allow the similarity are looked at.

First a key's members are ordered by each of SIGNATURES min-hashes and neighbours of different components are paired:
a linear number of pairs that joins nearly all of a group of near copies. Of the components that are left, the rows that
have any partner across components stay open (at most the rows a cell has). Their sets come to the cells, where all pairs
across components are settled exactly; what leaves a cell is a spanning forest of its links, fewer rows than it has. So
rows that travel grow with the rows of a key (times its blocks), not with its pairs; only comparing bitmaps, and counting
the overlap of pairs that these allow and no link has joined yet, is work for each pair, spread over the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.llm import words as W
from vellichor.llm.components import merged
from vellichor.session import discard, settle, staged

NUMERATOR, DENOMINATOR = 3, 4  # similarity of 0.75
BITMAP = 1024  # bits of a set's parity bitmap
BLOCK = 2048
ELEMENTS = 1 << 20  # of a block's sets, about
SHARP = 2048  # bits of the bitmaps that are made where the sets are at hand
SIGNATURES = 6


def parity(elements: np.ndarray, bits: int = BITMAP) -> bytes:
    """For each bit whether an odd number of elements falls on it."""
    counts = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


_SALTS = W.mixed(np.arange(1, SIGNATURES + 1, dtype=np.uint64) * W.P3)[:, None]


def signatures(elements: np.ndarray) -> np.ndarray:
    """The least of the elements under each of SIGNATURES hash functions."""
    return W.mixed(elements[None, :] ^ _SALTS).min(axis=1).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Columns with whole runs of the first, the runs' begins, and whether the first run goes on from an earlier piece: a run longer than most is cut, its pieces overlapping by one row."""
    held: list[np.ndarray] | None = None
    cut = False
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(now[0]):
            continue
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        starts = np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))
        upto = int(starts[-1])
        if len(now[0]) - upto > most:
            yield now, starts, cut
            held, cut = [x[-1:] for x in now], True
        else:
            if upto:
                yield [x[:upto] for x in now], starts[:-1], cut
                cut = False
            held = [x[upto:] for x in now]
    if held is not None and len(held[0]):
        yield held, np.zeros(1, np.int64), cut


def _near(comp: np.ndarray, size: np.ndarray, side: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set of a cell in order of size: its place, the places of the later ones of other components that may link with it, and their bitmaps' distances. Rows of one side (not negative) are paired in another cell; comp may change meanwhile.

    Where the parity bitmaps of two sets differ in h bits, at least h elements are in one set only, so the overlap is at
    most (a + b - h) / 2: pairs that cannot reach the similarity are left out."""
    for i in range(len(size) - 1):  # partners of growing size
        to = int(np.searchsorted(size, size[i] * DENOMINATOR // NUMERATOR, "right"))
        j = np.flatnonzero((comp[i + 1 : to] != comp[i]) & ((side[i + 1 : to] != side[i]) | (side[i] < 0))) + i + 1
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        both = size[i] + size[j]
        may = (NUMERATOR + DENOMINATOR) * ((both - apart) // 2) >= NUMERATOR * both
        yield i, j[may], apart[may]


def _cells(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[np.ndarray]]:
    """The columns of each cell that has several components (comp is the first column)."""
    for (cell, *values), starts, _ in runs(batches, ("cell", *columns), 1 << 62):
        length = np.diff(np.append(starts, len(cell)))
        for s, k in zip(starts[length > 1], length[length > 1]):
            found = [x[s : s + k] for x in values]
            if (found[0] != found[0][0]).any():
                yield found


def _bits(bitmaps: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, n, node): pairs of different components in one cell that may still link."""
    for comp, side, node, n, bitmap in _cells(batches, "comp", "side", "node", "n", "bitmap"):
        for i, j, _ in _near(comp, n, side, _bits(bitmap)):
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, n, node): each (key, node) that may still link with a set of another component in its cell."""
    for comp, side, node, n, bitmap, key in _cells(batches, "comp", "side", "node", "n", "bitmap", "key"):
        may = np.zeros(len(node), bool)
        for i, j, _ in _near(comp, n, side, _bits(bitmap)):
            may[j] = True
            may[i] |= len(j) > 0
        if may.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[may]), pa.array(node[may])], names=["key", "node"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, n, node) with the sets' elements: links that join all components of a cell that any of its links joins, nearest pairs first; fewer than the cell has components."""
    for comp, side, node, n, elements in _cells(batches, "comp", "side", "node", "n", "elements"):
        comp, a, b = comp.copy(), [], []
        bits = _bits(np.array([parity(x.view(np.uint64), SHARP) for x in elements], object))
        for i, j, apart in _near(comp, n, side, bits):
            for k in j[np.argsort(apart, kind="stable")]:
                if comp[k] == comp[i]:
                    continue
                both = len(np.intersect1d(elements[i], elements[k], assume_unique=True))
                if both and DENOMINATOR * both >= NUMERATOR * (n[i] + n[k] - both):
                    comp[comp == comp[k]] = comp[i]
                    a.append(node[i])
                    b.append(node[k])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def dealt(rows: DataFrame, payload: str = "bitmap") -> DataFrame:
    """Rows (key, node, n, comp, payload) of keys that span several components, once for each cell they are in: (cell, side, key, node, n, comp, payload). Blocks of sets are bounded by their elements too."""
    size = F.count("*") / BLOCK if payload == "bitmap" else F.greatest(F.count("*") / BLOCK, F.sum("n") / ELEMENTS)
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(size).cast("int").alias("blocks")).filter("low < high").select("key", "blocks")
    blocks = rows.join(several, "key").withColumn("block", F.expr("cast(pmod(xxhash64(node, 1), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return blocks.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), F.expr("if(block = other, -1, block)").alias("side"), "key", "node", "n", "comp", payload)


def candidates(rows: DataFrame, parts: int) -> DataFrame:
    """Distinct (a, b) of rows (key, node, n, comp, bitmap) that may link across components: all pairs, for a small number of rows."""
    return dealt(rows).repartition(parts, "cell").sortWithinPartitions("cell", "n", "node").mapInArrow(_across, "a long, b long").distinct()


def open_rows(rows: DataFrame, parts: int) -> DataFrame:
    """The (key, node) of rows (key, node, n, comp, bitmap) that are in any pair that may link across components."""
    return dealt(rows).repartition(parts, "cell").sortWithinPartitions("cell", "n", "node").mapInArrow(_open, "key long, node long").distinct()


def settled(rows: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) of rows (key, node, n, comp, elements) that join what all their links across components join."""
    cells = dealt(rows, "elements").select("cell", "side", "node", "n", "comp", "elements")
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "n", "node").mapInArrow(_settled, "a long, b long").distinct()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, node): pairs of neighbours of one cell that are in different components."""
    for (cell, node, comp), _, _ in runs(batches, ("cell", "node", "comp"), 1 << 16):
        i = np.flatnonzero((cell[:-1] == cell[1:]) & (comp[:-1] != comp[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[i + 1])), pa.array(np.maximum(node[i], node[i + 1]))], names=["a", "b"])


def neighbours(rows: DataFrame, parts: int) -> DataFrame:
    """Distinct (a, b): of rows (key, node, comp, sigs), those next to each other in a key with an equal signature."""
    cells = rows.select("key", "node", "comp", F.posexplode("sigs").alias("s", "sig")).select(F.xxhash64("key", "s", "sig").alias("cell"), "node", "comp")
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "node").mapInArrow(_neighbours, "a long, b long").distinct()


def links_across(members: DataFrame, sets: DataFrame, joined: DataFrame, verify: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame | None:
    """Links (a, b) between sets that share a key: with the components that are joined already, they give those of all such links; None if there are none to look for.

    members: (key, node); sets: (node, n, bitmap, sigs); joined: (node, component); verify keeps the pairs (a, b) that
    link; elements gives (node, n, elements), n distinct hashes, for some nodes (node)."""

    def several(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        return staged(rows.join(keys, "key", "left_semi"))

    rows = several(members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
    if not rows.limit(1).count():
        return None
    first = staged(neighbours(rows.join(sets.select("node", "sigs"), "node"), parts))
    settle(rows.sparkSession)
    found = staged(verify(first))
    settle(rows.sparkSession)
    now = merged(rows.select("node", F.col("comp").alias("component")).distinct(), found).withColumnRenamed("component", "comp")
    last, rows = rows, several(rows.select("key", "node").join(now, "node"))
    discard(last, first)
    rest = staged(open_rows(rows.join(sets.select("node", "n", "bitmap"), "node"), parts))
    settle(rows.sparkSession)
    if not rest.limit(1).count():
        return found
    links = staged(settled(rest.join(rows, ["key", "node"]).join(elements(rest.select("node").distinct()), "node"), parts))
    settle(rows.sparkSession)
    return found.unionByName(links)
