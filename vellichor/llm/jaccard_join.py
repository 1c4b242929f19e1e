"""N-gram Jaccard join by a size-aware heavy-light method.

A document's set holds its distinct SHINGLE-word shingles (64-bit hashes); two documents link at a Jaccard similarity
of SIMILARITY or more. Equal sets are one node from the start.

* Order a set's shingles in one global order; two linked sets share at least l of their first
  n - ceil(SIMILARITY * n) + l shingles (the l-prefix).
* Small sets: every PAIR of shingles of the 2-prefix is enumerated as a key. Two linked small sets share such a pair,
  and pairs are far rarer than single shingles.
* Large sets: each shingle of the l-prefix is a key of an inverted list, with a slack of l - 1 shingles more than one.
* The boundary is the size up to which enumerating pairs costs fewer keys than ENUMERATE times the l-prefix. Sets just
  above it also enumerate, so that a pair across the boundary meets.

Light lists (up to HEAVY sets) are scanned for pairs of compatible sizes. Of heavy lists only a chain and a star are
taken; what they may miss is found exactly: a set with fewer heavy shingles in its prefix than the l of its smallest
partner still shares a light one with every partner. Only sets with more of them (large groups of near copies, boilerplate) go through a second
round, with shingles ordered by their true frequency among these sets; there, lists that still span several components
after the verified links are joined are paired by neighbouring signatures; then all pairs between components that the
sets' parity bitmaps allow are settled where a list's sets meet, dealt over pairs of blocks (across.py).

Candidates are verified by the exact Jaccard similarity of the whole texts' sets. Lists are scanned run by run in
sorted partitions; no list, group or component is collected, and nothing grows on the driver.

Defined results: null or empty text and texts of white space: 0 shingles, linked with nothing, a component of their
own; fewer than SHINGLE words: the whole sequence is the one shingle; repeated ids: their sets are joined in one
component; null ids are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.llm import words as W
from vellichor.llm.across import links_across, parity, runs, signatures
from vellichor.llm.components import components, merged
from vellichor.session import discard, partitions, settle, staged

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4  # similarity of 0.75
HEAVY = 16
ENUMERATE = 2.0
PAIR_WEIGHT = 1 << 20  # a heavy pair key counts as many heavy shingles: no slack covers it


def required(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-NUMERATOR * n // DENOMINATOR)


def slack(n: np.ndarray) -> np.ndarray:
    return 2 + n // 32


def boundary() -> int:
    """The largest size for which pairs of the 2-prefix are cheap enough."""
    n = np.arange(1, 10_000)
    two, many = n - required(n) + 2, n - required(n) + 1 + slack(n)
    return int(n[two * (two - 1) / 2 <= ENUMERATE * many].max())


BOUNDARY = boundary()
#: Sets up to this size may have a small partner.
REACH = BOUNDARY * DENOMINATOR // NUMERATOR


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for found in W.slices(texts, lower=True):
        whole = W.window_hashes(found.hash, SHINGLE)
        counts = found.counts()
        for d, row in enumerate(found.rows):
            a, n = int(found.first[d]), int(counts[d])
            if n >= SHINGLE:
                yield row, np.unique(whole[a : a + n - SHINGLE + 1])
            elif n:
                yield row, W.window_hashes(found.hash[a : a + n], n)
            else:
                yield row, np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, sig, prefix): sig stands for the whole set, prefix is its l-prefix in the order of hashes."""
    for batch in batches:
        for at in range(0, len(batch), 1024):
            some = batch.slice(at, 1024)
            n, sig, prefix = np.zeros(len(some), np.int64), np.zeros(len(some), np.uint64), [np.zeros(0, np.uint64)] * len(some)
            for row, found in shingle_sets(some.column(1)):
                k = len(found)
                n[row] = k
                if k:
                    sig[row] = W.mixed(np.add.reduce(W.mixed(found ^ W.P1), keepdims=True) + np.uint64(k))[0]
                    prefix[row] = found[: min(k, k + 1 - int(required(k)) + int(slack(k)))]
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(sig.view(np.int64)), lists], names=["doc_id", "n", "sig", "prefix"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n, pairwise) of nodes with their prefixes: pairs for small sets, single shingles for large ones."""
    for batch in batches:
        node, size = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        offsets, values = batch.column("prefix").offsets.to_numpy(), batch.column("prefix").values.to_numpy().view(np.uint64)
        large = size > BOUNDARY
        length = np.diff(offsets)
        single = np.repeat(large, length)
        keys = [values[offsets[0] : offsets[-1]][single]]
        owner = [np.repeat(np.arange(len(node)), length)[single]]
        paired = [np.zeros(len(keys[0]), np.int64)]
        for r in np.flatnonzero((size <= REACH) & (size > 0)):
            mine = values[offsets[r] : offsets[r + 1]][: size[r] - int(required(size[r])) + 2]
            if len(mine) == 1:  # a set of one shingle: its only partner is equal to it
                continue
            i, j = np.triu_indices(len(mine), 1)
            keys.append(W.mixed(mine[i] * W.MULTIPLIER + mine[j]))
            owner.append(np.full(len(i), r))
            paired.append(np.ones(len(i), np.int64))
        key, own, pairwise = np.concatenate(keys), np.concatenate(owner), np.concatenate(paired)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[own]), pa.array(size[own] * 2 + pairwise)], names=["key", "node", "n2"])


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes a <= b of two sets that may link."""
    return DENOMINATOR * a >= NUMERATOR * b


PAIR = "a long, b long, shared long, need long, heavy long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (key, n2, node): candidate pairs with the number of lists that gave them and the least number that a linked pair shares (heavy = 0), and for each set in a heavy list a row (node, node, 0, 0, number of heavy keys)."""
    for (key, node, n2), starts, cut in runs(batches, ("key", "node", "n2"), 1 << 16):
        length = np.diff(np.append(starts, len(key)))
        run = np.repeat(np.arange(len(starts)), length)
        n = n2 >> 1
        heavy_run = length > HEAVY
        heavy_run[0] |= cut
        long = heavy_run[run]
        least = np.where(n2 & 1, 1, 1 + slack(n))  # of pairs whose smaller set this is
        i = np.zeros(0, np.int64)
        a, b, need = [i], [i], [i]
        for step in range(1, min(HEAVY, len(key))):
            i = np.flatnonzero(run[:-step] == run[step:])
            if step > 1:
                i = i[~long[i]]
            if not len(i):
                break
            i = i[_compatible(n[i], n[i + step])]
            a.append(node[i])
            b.append(node[i + step])
            need.append(least[i])
        i = np.flatnonzero(long)
        first = starts[run[i]]
        ok = _compatible(n[first], n[i]) & (first < i)
        a.append(node[first[ok]])
        b.append(node[i[ok]])
        need.append(least[first[ok]])
        a, b, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        order = order[a[order] != b[order]]
        a, b, need = a[order], b[order], need[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(a)))
        heavy, owner = np.unique(node[long], return_inverse=True)
        often = np.bincount(owner, np.where(n2[long] & 1, PAIR_WEIGHT, 1), len(heavy))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in ((a[at], heavy), (b[at], heavy), (times, np.zeros(len(heavy))), (need[at], np.zeros(len(heavy))), (np.zeros(len(times)), often))], names=["a", "b", "shared", "need", "heavy"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, elements) of every text."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            found = [x.view(np.int64) for _, x in shingle_sets(some.column(1))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "elements"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            left, right = dict(shingle_sets(some.column("text_a"))), dict(shingle_sets(some.column("text_b")))
            both = np.array([len(np.intersect1d(left[r], right[r], assume_unique=True)) for r in range(len(some))], np.int64)
            union = np.array([len(left[r]) + len(right[r]) for r in range(len(some))], np.int64) - both
            keep = pa.array((DENOMINATOR * both >= NUMERATOR * union) & (union > 0))
            yield some.select(["a", "b"]).filter(keep)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents that link; texts: (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def link_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text)."""
    spark = documents.sparkSession
    parts = partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sets = staged(rows.mapInArrow(_sets, "doc_id long, n long, sig long, prefix array<long>"))
    nodes = sets.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = nodes.select("node", "n", "prefix").mapInArrow(_keys, "key long, node long, n2 long")
    found = postings.repartition(parts, "key").sortWithinPartitions("key", "n2", "node").mapInArrow(_pairs, PAIR)
    found = staged(found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"), F.sum("heavy").alias("heavy")))
    whole, sets = sets, staged(sets.select("doc_id", "n", "sig"))
    discard(whole)
    settle(spark)

    sizes = sets.filter("n > 0").groupBy("doc_id").agg(F.max("n").alias("n"))
    often = found.filter("heavy > 0").select(F.col("a").alias("node"), "heavy")
    heavy = often.join(sizes.withColumnRenamed("doc_id", "node"), "node")
    unsafe = staged(heavy.filter(F.col("heavy") > 2 + F.floor(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) / 32)).select("node", "n"))
    texts = rows.withColumnRenamed("doc_id", "node")
    # Two linked sets share at least need keys; those that are in no light list are heavy for both.
    pairs = found.filter("shared > 0").join(often.selectExpr("node as a", "heavy as heavy_a"), "a", "left").join(often.selectExpr("node as b", "heavy as heavy_b"), "b", "left")
    links = staged(verified(pairs.filter("shared >= need - least(coalesce(heavy_a, 0), coalesce(heavy_b, 0))"), texts))
    settle(spark)

    joined = _second_round(unsafe, texts, links, parts) if unsafe.limit(1).count() else components(links)
    settle(spark)
    return _classes(sets, joined)


def _second_round(unsafe: DataFrame, texts: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """(node, component) by the links and those between sets whose prefixes are full of heavy keys: by prefixes in the order of true frequency among these."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                row, found = zip(*shingle_sets(some.column(1)))
                n = np.array([len(x) for x in found])
                node = some.column(0).to_numpy()[list(row)]
                first = np.zeros(int(n.sum()), bool)
                first[np.cumsum(n) - n] = True  # a set's bitmap goes with its first row
                bitmaps, sigs = np.full(len(first), None, object), np.full(len(first), None, object)
                bitmaps[first] = [parity(x) for x in found]
                for place, x in zip(np.flatnonzero(first), found):
                    sigs[place] = signatures(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n)), pa.array(bitmaps, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["key", "node", "n", "bitmap", "sigs"])

    full = staged(texts.join(unsafe, "node", "left_semi").select("node", "text").mapInArrow(whole, "key long, node long, n long, bitmap binary, sigs array<long>"))
    often = full.groupBy("key").agg(F.count("*").alias("df"))
    ranked = full.join(often, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ordered"))
    prefix = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1).cast("int"))
    postings = staged(ranked.select("node", "n", F.explode(prefix.getField("key")).alias("key")))
    chained = postings.select("key", "node", (F.col("n") * 2).alias("n2")).repartition(parts, "key").sortWithinPartitions("key", "n2", "node").mapInArrow(_pairs, PAIR)
    known = links.select("a", "b")
    new = verified(chained.filter("shared > 0").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), texts)
    joined = components(known.unionByName(new))
    long = postings.groupBy("key").count().filter(F.col("count") > HEAVY).select("key")
    members = postings.select("key", "node").join(long, "key", "left_semi")
    bitmaps = full.filter("bitmap is not null").select("node", "n", "bitmap", "sigs")

    def elements(some: DataFrame) -> DataFrame:
        return texts.join(some, "node", "left_semi").select("node", "text").mapInArrow(_elements, "node long, n long, elements array<long>")

    rest = links_across(members, bitmaps, joined, lambda pairs: verified(pairs, texts), elements, parts)
    return joined if rest is None else merged(joined, rest)


def _classes(sets: DataFrame, joined: DataFrame) -> DataFrame:
    same = sets.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"))
    own = sets.select("doc_id", "n", "sig")
    out = own.filter("n > 0").join(same, "sig").join(joined, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    return out.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
