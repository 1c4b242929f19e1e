"""Fuzzy line dedup by MinHash.

A line's set holds the shingles of SHINGLE characters of its text in lower case with single blanks. A one-permutation
MinHash of BINS values (empty bins are filled from the next one that is not) is cut into BANDS bands; lines that share
a band are candidates. In buckets of up to LIGHT lines all pairs are taken, in larger ones each line with the first and
with the previous line. Candidates are verified by the exact Jaccard similarity of their sets, at SIMILARITY or more,
and joined by distributed union-find. Larger buckets that then still span several components are paired again by
neighbouring signatures, and then all pairs between components that sizes and parity bitmaps allow are settled where the
bucket's sets meet (across.py). Of each component, over all documents, only the first line (by document id, then place)
stays.

So every pair that shares a band is joined or refused by its similarity. At a similarity of exactly 0.75 a pair shares a
band with a chance of 99 %, at 0.8 of 99.8 %.

Scale: equal lines are one node from the start (combined before the shuffle); long lines that differ in case or white
space only are nodes of their own that link, as their sets are equal. Nodes are written once, bucketed, and
those that share a bucket with others once more, so that verification reads these only and moves pairs and one of two
texts. Buckets are scanned run by run in sorted partitions, in pieces
of bounded length; the second scan deals a bucket over pairs of blocks. Node ids are 64-bit hashes: two different lines are one with a chance of 2^-64 a pair.

Defined results: blank lines stay; null text: no lines, stays null; lines shorter than SHINGLE characters are one
shingle, so they only match equal lines; equal lines in one document: the first stays; rows with equal id and text get
equal results; rows with equal id and different text are told apart; null ids come first; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellichor.llm import words as W
from vellichor.llm.across import links_across, parity, runs, signatures
from vellichor.llm.components import components, merged
from vellichor.session import partitions, settle, staged

SHINGLE = 8
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
SIMILARITY = 0.75
LIGHT = 8  # lines of a bucket of which all pairs are taken at once
BITMAP = 2048  # bits of a line's parity bitmap
CHARS = 1 << 16  # characters handled at once
HOT = 1000  # lines with more than this share (one in HOT) of all lines are salted
EMPTY = np.uint32(0xFFFFFFFF)


def normal(line: Column) -> Column:
    """Lower case with single blanks; most lines need no pattern for that."""
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\r\f\v":
        odd = odd | F.contains(line, F.lit(blank))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def _codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashed(codes: np.ndarray) -> np.ndarray:
    """The hash of the shingle at each place."""
    h = codes * W.P1 + np.uint64(1)
    for step in (1, 2, 4):
        h = h[:-step] * W.MULTIPLIER + (h[step:] ^ W.P2)
    return W.mixed(h)


def minhashes(lines: list[str]) -> np.ndarray:
    """One row of BINS values for each line."""
    length = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(length)
    begin = end - length
    out = np.full((len(lines), BINS), EMPTY, np.uint32)
    if len(codes) >= SHINGLE:
        h = codes * np.uint32(0x9E3779B1)
        h += np.uint32(0x85EBCA6B)
        for step in (1, 2, 4):  # 32 bits: numpy multiplies many at once
            h = h[:-step] * np.uint32(0x915F77F5) + (h[step:] ^ (h[step:] >> np.uint32(15)))
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        h ^= h >> np.uint32(16)
        bins = ((h >> np.uint32(16)) * np.uint32(BINS)) >> np.uint32(16)
        h *= np.uint32(0x2C1B3C6D)
        h &= np.uint32(0xFFFFFFFE)
        over = (end[:, None] - np.arange(1, SHINGLE)).reshape(-1)  # where shingles would reach into the next line
        h[over[(over >= 0) & (over < len(h))]] = EMPTY
        at = np.repeat(np.arange(0, len(lines) * BINS, BINS), length)[: len(h)]
        at += bins
        np.minimum.at(out.reshape(-1), at, h)
    for i in np.flatnonzero(length < SHINGLE):  # one shingle: the line
        value = 1
        for c in codes[begin[i] : end[i]]:
            value = (value * int(W.MULTIPLIER) + int(c)) & W.MASK
        out[i] = np.uint32(value >> 33)
    bare = out == EMPTY
    rows = np.flatnonzero(bare.any(axis=1))
    if len(rows):
        twice = np.concatenate([bare[rows]] * 2, axis=1)
        place = np.where(twice, 4 * BINS, np.arange(2 * BINS))
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        away = (following - np.arange(BINS)).astype(np.uint32)
        out[rows] = np.take_along_axis(out[rows], following % BINS, axis=1) + away * np.uint32(0x9E3779B1)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        at = 0
        while at < len(lines):
            to, chars = at, 0
            while to < len(lines) and (to == at or chars + len(lines[to]) <= CHARS):
                chars += len(lines[to])
                to += 1
            found = minhashes(lines[at:to]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * W.P1
            for r in range(ROWS):
                key = W.mixed(key ^ found[:, :, r]) * W.MULTIPLIER
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes[at:to], BANDS))], names=["bucket", "node"])
            at = to


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (bucket, node) sorted: the pairs of small buckets, chain and star of large ones, and for each node of a large bucket a row (node, node, bucket)."""
    for (bucket, node), starts, cut in runs(batches, ("bucket", "node"), 1 << 16):
        length = np.diff(np.append(starts, len(bucket)))
        run = np.repeat(np.arange(len(starts)), length)
        large = length > LIGHT
        large[0] |= cut
        long = large[run]
        i = np.zeros(0, np.int64)
        left, right = [i], [i]
        for step in range(1, LIGHT):
            i = np.flatnonzero(run[:-step] == run[step:])
            if step > 1:
                i = i[~long[i]]
            if not len(i):
                break
            left.append(i)
            right.append(i + step)
        i = np.flatnonzero(long)
        left.append(starts[run[i]])
        right.append(i)
        left, right = np.concatenate(left), np.concatenate(right)
        a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
        order = np.lexsort((b, a))
        order = order[a[order] != b[order]]
        a, b = a[order], b[order]
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b = np.concatenate([a[keep], node[long]]), np.concatenate([b[keep], node[long]])
        of = pa.array(np.concatenate([np.zeros(int(keep.sum()), np.int64), bucket[long]]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), of], names=["a", "b", "bucket"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, bitmap, sigs) of lines of SHINGLE characters or more."""
    for batch in batches:
        found = [np.unique(_hashed(_codes([x]))) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([parity(x, BITMAP) for x in found], pa.binary()), pa.array([signatures(x) for x in found], pa.list_(pa.int64()))], names=["node", "n", "bitmap", "sigs"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, elements) of lines of SHINGLE characters or more."""
    for batch in batches:
        found = [np.unique(_hashed(_codes([x]))).view(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "elements"])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def overlaps(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in both, shingles in either) of each pair of lines of SHINGLE characters or more, by 45-bit hashes within the pair; at most 2^17 pairs."""
    lines = [x for pair in zip(left, right) for x in pair]
    length = np.array([len(x) for x in lines], np.int64)
    n = length - SHINGLE + 1
    h = _hashed(_codes(lines))
    h = h[np.repeat(np.cumsum(length) - length - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), n)
    # One number for pair, hash and side: a plain sort brings a pair's equal shingles together.
    key = ((line >> np.uint64(1)) << np.uint64(46)) | ((h >> np.uint64(19)) << np.uint64(1)) | (line & np.uint64(1))
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]  # each side's set
    both = key[1:][key[1:] ^ key[:-1] == 1]  # a shingle's two sides are neighbours
    pair = (key >> np.uint64(46)).astype(np.int64)
    shared = np.bincount((both >> np.uint64(46)).astype(np.int64), minlength=len(left))
    return shared, np.bincount(pair, minlength=len(left)) - shared


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        chars = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
        # A line of fewer characters than a shingle is like nothing but equal lines, which are one node.
        long = np.array([min(len(x), len(y)) >= SHINGLE for x, y in zip(left, right)], bool)
        piece = np.cumsum(chars) // CHARS
        keep = np.zeros(len(left), bool)
        for k in np.unique(piece[long]):
            i = np.flatnonzero(long & (piece == k))
            both, either = overlaps([left[j] for j in i], [right[j] for j in i])
            keep[i] = both >= SIMILARITY * either
        yield batch.select([0, 1]).filter(pa.array(keep))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def place() -> Column:
    """By this lines are ordered: document id (null first), row, line."""
    return F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), "row", "line_no")


def lines_of(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line, node) of every line that is not empty. Short lines are equal where their normal form is, others where all characters are: that form is made for each node, not for each line."""
    split = documents.select(row_key().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = split.select("row", "doc_id", "line_no", F.trim("line").alias("line")).filter("line <> ''")
    return bare.withColumn("node", F.xxhash64(F.when(F.octet_length("line") < 4 * SHINGLE, normal(F.col("line"))).otherwise(F.col("line"))))


def joined_nodes(nodes: DataFrame, parts: int) -> DataFrame:
    """(node, component) of the nodes (node, norm) that link with others."""
    # Shorter lines are like nothing but equal lines, which are one node.
    buckets = nodes.select("node", "norm").filter(F.length("norm") >= SHINGLE).mapInArrow(_bands, "bucket long, node long")
    # By one number, which sorts by radix; the order within a bucket does not matter.
    found = staged(buckets.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_chained, "a long, b long, bucket long").distinct())
    settle(nodes.sparkSession)
    # Most lines share no bucket: what follows reads the texts of the others only.
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = staged(nodes.select("node", "norm").join(ends.hint("shuffle_hash"), "node", "left_semi"), bucket=(parts, "node"))
    settle(nodes.sparkSession)
    left, right = texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a")), texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "norm_a", "norm_b").mapInArrow(_alike, "a long, b long")

    # Lines that only white space makes long are like those of the same normal form, whose hash is their node.
    short = nodes.filter(F.length("norm") < SHINGLE).select(F.col("node").alias("a"), F.xxhash64("norm").alias("b")).filter("a <> b")
    known = staged(verify(found.filter("a <> b")).unionByName(short))
    settle(nodes.sparkSession)
    joined = components(known)
    members = found.filter("a = b").select(F.col("bucket").alias("key"), F.col("a").alias("node"))
    if not members.limit(1).count():
        return joined
    sets = staged(texts.join(members.select("node").distinct(), "node").select("node", "norm").mapInArrow(_bitmaps, "node long, n long, bitmap binary, sigs array<long>"))

    def elements(some: DataFrame) -> DataFrame:
        return texts.join(some, "node").select("node", "norm").mapInArrow(_elements, "node long, n long, elements array<long>")

    more = links_across(members, sets, joined, verify, elements, parts)
    return joined if more is None else merged(joined, more)


def left_over() -> Column:
    """text without the lines at the places of gone (ascending), from lines, all its lines: the runs of lines between those places, so that the work grows with the lines."""
    before, after = lambda k: F.coalesce(F.get("gone", k - 1), F.lit(-1)), lambda k: F.coalesce(F.get("gone", k), F.size("lines"))
    kept = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", before(k) + 2, after(k) - before(k) - 1))
    return F.encode(F.array_join(F.flatten(kept), "\n"), "ISO-8859-1").cast("string")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with text cut to the lines that stay, and n_lines, n_removed; where the documents have columns of these names, theirs stay and the counts are left out."""
    spark = documents.sparkSession
    parts = partitions(spark)
    lines = lines_of(documents)
    # By the hash alone, so that texts are dealt once: a task has whole buckets, and one file each.
    # A text has no fixed width, so this sorts; a place may be a structure then.
    nodes = lines.withColumn("place", place()).groupBy("node").agg(F.first("line").alias("line"), F.min("place").alias("first"), F.count("*").alias("copies"))
    nodes = nodes.select("node", normal(F.col("line")).alias("norm"), "first", "copies").filter("norm <> ''")
    nodes = staged(nodes, bucket=(parts, "node"))
    settle(spark)
    joined = joined_nodes(nodes, parts)
    settle(spark)
    known = nodes.select("node", "first", "copies")
    stays = known.join(joined, "node").groupBy("component").agg(F.min("first").alias("stays"))
    grouped = joined.join(stays, "component").select("node", "stays")
    several = known.join(grouped, "node", "left").filter("copies > 1 or stays is not null").select("node", "copies", F.coalesce("stays", "first").alias("stays"))
    several = staged(several)
    # At most HOT lines have so many copies that they are salted: a bounded broadcast.
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = several.filter(F.col("copies") > max(total // HOT, 1)).select("node", F.ceil(F.col("copies") * HOT / F.lit(max(total, 1))).cast("int").alias("salts"))
    salted = lines.select("row", "doc_id", "line_no", "node").join(F.broadcast(hot), "node", "left").withColumn("salt", F.pmod(F.xxhash64("row", "line_no"), F.coalesce("salts", F.lit(1))))
    targets = several.join(F.broadcast(hot), "node", "left").select("node", "stays", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    gone = salted.join(targets, ["node", "salt"]).filter(place() != F.col("stays"))
    places = gone.groupBy("row").agg(F.collect_set("line_no").alias("places"))
    # The caller's other columns go as one, so that no name of theirs is also one of these.
    others = [(c, t) for c, t in documents.dtypes if c != "text"]
    kept = documents.select(F.struct(*(F.col(f"`{c}`") for c, _ in others)).alias("given"), "text", row_key().alias("row")).join(places.hint("shuffle_hash"), "row", "left").select("given", "text", "places")
    # A character a byte, so that bytes that are no UTF-8 stay as they are: in UTF-8 a byte 0x0A is a line's end and nothing else.
    lines_there = F.split(F.decode(F.col("text").cast("binary"), "ISO-8859-1"), "\n")
    cut = kept.select("given", "text", F.sort_array("places").alias("gone"), F.when(F.col("places").isNotNull(), lines_there).alias("lines"))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    out = cut.select("given", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left_over()).alias("text"), n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
    counts = [c for c in ("n_lines", "n_removed") if c not in documents.columns]
    return out.select(*(F.col("text") if c == "text" else F.col("given").getField(c).alias(c) for c in documents.columns), *counts)
