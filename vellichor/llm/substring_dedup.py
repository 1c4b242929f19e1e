"""Substring dedup by difference-cover anchors.

A window of WINDOW consecutive words is removed where its word sequence also starts in a document with a smaller id.
Positions modulo PERIOD that lie in COVER form a difference cover: whatever the two positions of a repeated window, at
one of its first PERIOD offsets both are cover positions. So only shorter anchor windows at cover positions (3 of 7)
are hashed and grouped; a repeated window shares at least one aligned anchor. Windows around shared anchors are then
extended to full length and compared by the hash of all their words, of which the smallest document keeps its own.

Scale: texts are written once, bucketed by id; later passes move only (hash, id, place). Groups are never collected:
a sorted partition is scanned run by run with a carry of one document. Before either shuffle each slice settles what it
can by itself (an anchor that two of its documents share is known to be shared; a window whose smaller document is in
the slice is known to be removed), so that a hash is sent at most once for a slice and document however hot it is.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes have 64 bits: two different windows are taken for
equal with a chance of 2^-64 a pair.

Defined results: null or empty text: no words; fewer than WINDOW words: nothing is removed; repeated ids: each row is
judged by itself against smaller ids; null ids are larger than all others and remove nothing from each other; an empty
table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellichor.llm import words as W
from vellichor.session import partitions, settle, staged

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
POSTING = "key long, doc long, place long"
#: place = tie << TIE | word; tie tells rows of one id apart. A settled place is sent as -1 - place.
TIE = 40
NO_ID = (1 << 63) - 1


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names.split())


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys for settled rows: they only travel to their document, by any partition."""
    return W.mixed(doc.astype(np.uint64) * W.P1 + place.astype(np.uint64))


def _settled(key: np.ndarray, doc: np.ndarray, place: np.ndarray, anchors: bool) -> pa.RecordBatch:
    """Postings of a slice after what the slice itself decides."""
    order = np.lexsort((place, doc, key))
    key, doc, place = key[order], doc[order], place[order]
    if len(key):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(key)) - 1
        if anchors:
            known = (doc[begin] != doc[end])[run]
            sent = ~known | new  # one posting stands for the slice
        else:
            known = doc != doc[begin][run]
            sent = ~known
        key, doc, place = (np.concatenate(x) for x in ((key[sent], _spread(doc[known], place[known])), (doc[sent], doc[known]), (place[sent], -1 - place[known])))
    return _batch("key doc place", key, doc, place)


def _places(found: W.Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each document in the slice: its id and its tie, shifted."""
    ids = batch.column("doc").to_numpy()[found.rows.start : found.rows.stop]
    ties = batch.column("tie").to_numpy()[found.rows.start : found.rows.stop]
    return ids, ties << TIE


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    in_cover = np.isin(np.arange(PERIOD), COVER)
    for batch in batches:
        for found in W.slices(batch.column("text")):
            counts = found.counts()
            at = W.window_starts(found, ANCHOR)
            of = found.doc()[at] if len(at) else at
            local = at - found.first[:-1][of]
            keep = in_cover[local % PERIOD] & (counts[of] >= WINDOW)
            at, of, local = at[keep], of[keep], local[keep]
            ids, ties = _places(found, batch)
            yield _settled(W.window_hashes(found.hash, ANCHOR)[at], ids[of], ties[of] + local, True)


def _scan(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, sorted by document. single: rows of a run's first document wait until another is seen."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # (doc, place) of the last run while it has one document
    last: tuple | None = None  # (key, first document, whether it has others)
    for batch in batches:
        key, doc, place = (batch.column(c).to_numpy() for c in ("key", "doc", "place"))
        settled = place < 0
        out = [(doc[settled], -1 - place[settled])]
        key, doc, place = key[~settled], doc[~settled], place[~settled]
        if len(key):
            new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            run = np.cumsum(new)  # 0: goes on from the last batch
            begin = np.flatnonzero(new)
            first = np.concatenate([[last[1] if last is not None else 0], doc[begin]])
            end = np.append(begin[1:], len(key)) - 1
            others = np.concatenate([[False], doc[begin] != doc[end]])
            if not new[0]:
                upto = begin[0] if len(begin) else len(key)
                others[0] = last[2] or doc[upto - 1] != last[1]
            if single:
                if held and others[0]:
                    out += held
                if len(begin) or others[0]:
                    held = []
                take = others[run]
                if not others[-1]:
                    tail = run == len(begin)
                    held.append((doc[tail], place[tail]))
            else:
                take = doc != first[run]
            out.append((doc[take], place[take]))
            last = (key[-1], first[-1], bool(others[-1]))
        yield _batch("doc place", *(np.concatenate(x) for x in zip(*out)))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of anchors that two documents have."""
    yield from _scan(batches, True)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows that a smaller document has."""
    yield from _scan(batches, False)


def _listed(batch: pa.RecordBatch, name: str = "places") -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    return lists.offsets.to_numpy(), lists.values.to_numpy()


def _own(values: np.ndarray, tie: int) -> np.ndarray:
    return values[(values >> TIE) == tie] & ((1 << TIE) - 1)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full windows around shared anchors."""
    for batch in batches:
        offsets, values = _listed(batch)
        for found in W.slices(batch.column("text")):
            ids, ties = _places(found, batch)
            begin = found.first[:-1]
            near = np.zeros(len(found.hash), bool)
            for d, r in enumerate(found.rows):
                at = _own(values[offsets[r] : offsets[r + 1]], int(ties[d] >> TIE)) + begin[d]
                near[at] = True
            marked = near.copy()
            for back in range(1, PERIOD):
                marked[:-back] |= near[back:]
            at = W.window_starts(found, WINDOW)
            at = at[marked[at]] if len(at) else at
            of = found.doc()[at] if len(at) else at
            yield _settled(W.window_hashes(found.hash, WINDOW)[at], ids[of], ties[of] + at - begin[of], False)


def _cut(texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _listed(batch)
            out: list[list] = [[], [], [], []]
            for r, (text, tie) in enumerate(zip(batch.column("text"), batch.column("tie").to_pylist())):
                found = (text.as_py() or "").encode().split()
                at = _own(values[offsets[r] : offsets[r + 1]], tie)
                if len(at):
                    marks = np.zeros(len(found) + WINDOW + 1, np.int32)
                    at = np.unique(at)
                    marks[at] += 1
                    marks[at + WINDOW] -= 1
                    gone = np.cumsum(marks)[: len(found)] > 0
                    kept = [w for w, g in zip(found, gone.tolist()) if not g]
                else:
                    kept = found
                joined = b" ".join(kept)
                for column, value in zip(out, (len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), *([pa.array(out[3], pa.string())] if texts else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if texts else [])])

    return cut


def remove_repeats(documents: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) for every row of documents; text is what is kept."""
    spark = documents.sparkSession
    n = partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(n, "doc").withColumn("tie", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"))).cast("long") - 1)
    rows = staged(rows, bucket=(n, "doc"))
    settle(spark)

    def grouped(postings: DataFrame, scan: Callable) -> DataFrame:
        found = postings.repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(scan, "doc long, place long")
        places = staged(found.groupBy("doc").agg(F.collect_list("place").alias("places")))
        settle(spark)  # the postings' shuffle is done with
        return rows.join(places, "doc", "left").withColumn("places", F.coalesce("places", F.array().cast("array<long>")))

    near = grouped(rows.select("doc", "tie", "text").mapInArrow(anchors, POSTING), shared)
    gone = grouped(near.filter(F.size("places") > 0).select("doc", "tie", "text", "places").mapInArrow(windows, POSTING), repeated)
    return gone.select("doc_id", "tie", "text", "places").mapInArrow(_cut(texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)
