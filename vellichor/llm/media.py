"""Chroma audio fingerprints and the alignment of recordings by them.

A recording (16-bit little-endian mono samples) becomes frames of 12 pitch-class energies. FILTERS, differences of
rectangle sums read from an integral image over (frame, pitch class), are each quantised to two bits in Gray code and
packed into one 32-bit integer a frame. Two recordings are aligned at an offset if at least OVERLAP frames overlap there
with a bit error rate of at most ERROR.

Search: KEY integers in a row are a key of an inverted index over every recording (of a run of one key its two ends); the queries' keys meet it in
an equi-join, hits are counted by (query, recording, offset), an offset histogram, and every offset with a hit is
verified by its bit errors; of those that pass, the one with most hits (of equal ones the largest) is the result. Recordings with equal fingerprints are one class from the start, so copies multiply nothing; results
are pairs of class representatives plus every row's class.

Scale: fingerprints are made in Arrow batches and written once; hits are combined before they move; only fingerprints of
candidate pairs are compared. Nothing reaches the driver.

Defined results: null or too short samples: an empty fingerprint, a class of its own kind, aligned with nothing; silence
gives equal integers everywhere; repeated rows are members of one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.session import staged

RATE, FRAME, HOP = 4000, 512, 128
PITCHES, LOW, HIGH = 12, 60.0, 1900.0  # Hz that count
SPAN = 16  # frames under a filter at most
#: (kind, first pitch class, height, width): kinds part the rectangle by pitch, by time, crosswise, or middle from sides.
FILTERS = tuple((k % 4, (5 * k) % 9, 4 if k % 8 < 4 else 3, (4, 8, 16, 6)[k // 4]) for k in range(16))
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
KEY = 2
OVERLAP, ERROR = 40, 0.2
QUERY_STEP = 20


def pitch_classes() -> np.ndarray:
    """(bins of a frame's spectrum, pitch classes): 1 where a bin belongs to a class."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    of = np.zeros((len(hz), PITCHES))
    used = (hz >= LOW) & (hz <= HIGH)
    of[np.flatnonzero(used), np.round(PITCHES * np.log2(hz[used] / 440.0)).astype(int) % PITCHES] = 1.0
    return of


_CLASSES, _WINDOW = pitch_classes(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energies, each frame scaled to length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _WINDOW
    energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _CLASSES
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return energy / np.where(size > 1e-9, size, 1.0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that SPAN frames follow."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, PITCHES + 1))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, height, width) in enumerate(FILTERS):
        high, mid, half = low + height, low + height // 2, width // 2
        whole = area(0, width, low, high)
        if kind == 0:
            a = area(0, width, low, mid)
        elif kind == 1:
            a = area(0, half, low, high)
        elif kind == 2:
            a = area(0, half, low, mid) + area(half, width, mid, high)
        else:
            a = area(width // 4, width - width // 4, low, high)
        ratio = np.log((1.0 + a) / (1.0 + whole - a))
        out |= GRAY[np.searchsorted(CUTS, ratio, "right")] << np.uint32(2 * k)
    return out


def tones(vector: np.ndarray) -> np.ndarray:
    """A recording for a vector: each component is a tone of 64 ms whose pitch follows its value."""
    pitch = 48.0 * np.tanh(2.0 * np.nan_to_num(vector.astype(np.float64)))
    step = np.repeat(440.0 * 2.0 ** (np.clip(np.round(pitch / 2), -24, 24) / PITCHES), RATE * 64 // 1000) / RATE
    return (np.sin(2 * np.pi * np.cumsum(step)) * 12000).astype("<i2")


def recordings(embeddings: DataFrame) -> DataFrame:
    """(id, pcm): the media column made from vectors."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                pcm = [None if v is None else tones(np.array([x or 0.0 for x in v])).tobytes() for v in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pcm, pa.binary())], names=["id", "pcm"])

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>")).mapInArrow(made, "id long, pcm binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, marks): media has id and pcm."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                marks = [fingerprint(np.frombuffer(x.as_py() or b"", "<i2")[: len(x.as_py() or b"") // 2].astype(np.float64)).view(np.int32) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([m.tolist() for m in marks], pa.list_(pa.int32()))], names=["id", "marks"])

    return media.select("id", "pcm").mapInArrow(marked, "id long, marks array<int>")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(wrong bits, frames) of a against b moved by offset: frame i of a meets frame i + offset of b."""
    low, high = max(0, -offset), min(len(a), len(b) - offset)
    if high <= low:
        return 0, 0
    return int(np.bitwise_count(a[low:high].view(np.uint32) ^ b[low + offset : high + offset].view(np.uint32)).sum()), high - low


def align(media: DataFrame) -> DataFrame:
    """One row per recording (id, class_id, n_marks, query_id, offset, bit_error): its class, and for each aligned query class the best offset; null where no query aligns."""
    marked = staged(fingerprints(media))
    keyed = marked.withColumn("whole", F.xxhash64("marks"))
    classes = keyed.groupBy("whole").agg(F.min("id").alias("class_id"), F.first("marks").alias("marks"), F.max((F.col("id") % QUERY_STEP == 0).cast("int")).alias("asked"))
    classes = staged(classes)
    key = F.transform(F.sequence(F.lit(0), F.size("marks") - KEY), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get("marks", i + k) for k in range(KEY)]).alias("key")))
    # A run of one key (silence, a held tone) is kept at its two ends only: two runs meet at four places, not at all pairs
    # of places, and at an offset where two recordings agree some end of a run agrees too.
    keys = F.filter("keys", lambda x, i: (i == 0) | (i == F.size("keys") - 1) | (F.get("keys", i - 1).key != x.key) | (F.get("keys", i + 1).key != x.key))
    posted = classes.filter(F.size("marks") >= KEY).select("class_id", "asked", key.alias("keys")).select("class_id", "asked", F.explode(keys).alias("x")).select("class_id", "asked", "x.at", "x.key")
    asked = posted.filter("asked = 1").select(F.col("class_id").alias("query_id"), F.col("at").alias("query_at"), "key")
    hits = asked.join(posted, "key").filter("query_id <> class_id").groupBy("query_id", "class_id", (F.col("at") - F.col("query_at")).alias("offset")).count()
    # A pair has at most as many offsets as both recordings have frames.
    bins = F.reverse(F.array_sort(F.collect_list(F.struct("count", "offset")))).getField("offset").alias("offsets")
    best = hits.groupBy("query_id", "class_id").agg(bins)
    marks = classes.select("class_id", "marks")
    pairs = best.join(marks, "class_id").join(marks.select(F.col("class_id").alias("query_id"), F.col("marks").alias("query_marks")), "query_id")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, offset, rate = [], [], []
            for r, (a, b, offsets) in enumerate(zip(batch.column("query_marks"), batch.column("marks"), batch.column("offsets").to_pylist())):
                a, b = np.array(a.as_py(), np.int32), np.array(b.as_py(), np.int32)
                for o in offsets:
                    wrong, n = bit_errors(a, b, o)
                    if n >= OVERLAP and wrong <= ERROR * 32 * n:
                        row.append(r)
                        offset.append(o)
                        rate.append(wrong / (32 * n))
                        break
            some = batch.select(["query_id", "class_id"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(offset, pa.int64()), pa.array(rate, pa.float64())], names=["query_id", "class_id", "offset", "bit_error"])

    aligned = pairs.select("query_id", "class_id", "offsets", "marks", "query_marks").mapInArrow(checked, "query_id long, class_id long, offset long, bit_error double")
    members = keyed.select("id", "whole", F.size("marks").cast("long").alias("n_marks")).join(classes.select("whole", "class_id"), "whole").select("id", "class_id", "n_marks")
    return members.join(aligned.withColumnRenamed("class_id", "rep"), F.col("id") == F.col("rep"), "left").select("id", "class_id", "n_marks", "query_id", "offset", "bit_error")
