"""Toxicity by compression distance.

Two dictionaries are trained by zstandard on labelled documents, one on toxic and one on ordinary text. Toxic documents
are mostly ordinary prose, so of them the word beginnings are trained on that are significantly more frequent in toxic
than in ordinary documents (in different surroundings: copied passages count once): a dictionary of whole documents would hold the prose and miss all but the most frequent of
these stretches (held-out recall on sf0.1 0.42). A window of WINDOW words is compressed with the ordinary dictionary and with both; the
difference of the lengths says how much of it only toxic text explains. A document's windows form a histogram of length
differences, and the threshold on it is calibrated by logistic regression on labelled documents that neither dictionary
was trained on.

The toxic dictionary lies before the ordinary dictionary, so matches in that cost the same with and without them. Windows
are compressed in front of a fixed tail that both dictionaries hold: a compressor looks for no match in the last bytes
of its input, and the tail gives every frame the same overhead.

The model is fitted on a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_ORDINARY documents, by hash of the
id, of at most SAMPLE_CHARS characters each: at most 48 MB); every text is scored whole, in Arrow batches.

Defined results: null text counts as empty; empty texts get the model's score of no windows; no usable labels, or
labels of one class only: score 0.0 (no toxic) or 1.0 (no ordinary); a document with several labels is toxic if any
label says so, null labels do not count; repeated rows are scored alike. label, lang, source and id are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2000, 4000, 8000
TOXIC_BYTES, ORDINARY_BYTES = 8_000, 16_000  # of the trained dictionaries
SEGMENT, STEP = 24, 6  # bytes of a trained dictionary's segments, and of the sequences that training counts
SEQUENCES, AROUND = (6, 7, 8, 9), 6  # bytes of the word beginnings (with a blank) that are compared, and of their surroundings
LEAST_PLACES, LEAST_G2, LEAST_ODDS = 3, 20.0, 1.5  # of a beginning to train the toxic dictionary: surroundings, significance, log odds
WINDOW = 3  # words
LOWEST, HIGHEST = -2, 8  # length differences told apart
TAIL = bytes(range(128, 160))
AT_ONCE = 20_000  # windows compressed in one call
#: Everything in ASCII that is no letter parts words; bytes above 127 belong to words.
DELIMITERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
RIDGE = 0.1


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    constant: float | None = None


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(DELIMITERS).split()


def windows(text: str | None) -> list[bytes]:
    """WINDOW words after each other, with their blanks and the tail, ready to be compressed."""
    found = words(text)
    return [b" " + b" ".join(found[i : i + WINDOW]) + b" " + TAIL for i in range(0, len(found), WINDOW)]


def parameters(dict_size: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(5, dict_size=dict_size, source_size=256, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4, strategy=zstandard.STRATEGY_GREEDY, target_length=0, hash_log=16)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content + TAIL
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = parameters(len(content))
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; where they are too few for training, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STEP).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def sequences(text: bytes, size: int) -> np.ndarray:
    """A number for the size bytes from each place on: the bytes themselves up to 8, else a hash of them."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(len(data) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(256 if size <= 8 else 0x5851F42D4C957F2D) + data[j : j + n]
    return out


def beginnings(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, with the blank before them; the number of size bytes from there on)."""
    found = sequences(text, size)
    at = np.flatnonzero(np.frombuffer(text, np.uint8)[: len(found)] == 32)
    return at, found[at]


def placed(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word beginnings, and in how many different surroundings each is."""
    pairs = []
    for text in texts:
        at, found = beginnings(text, size)
        around = sequences(b" " * AROUND + text + b" " * (size + AROUND), AROUND)
        pairs.append(np.stack([found, around[at] * np.uint64(0x9E3779B97F4A7C15) + around[at + AROUND + size]], axis=1))
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    fresh = np.append(True, (both[1:] != both[:-1]).any(axis=1)) if len(both) else np.zeros(0, bool)
    return np.unique(both[fresh, 0], return_counts=True)


def over_represented(toxic: list[bytes], ordinary: list[bytes], size: int) -> np.ndarray:
    """The word beginnings that are significantly more frequent in toxic documents."""
    known, a = placed(toxic, size)
    n1, n0 = float(a.sum()), 0.0
    known, a = known[a >= LEAST_PLACES], a[a >= LEAST_PLACES].astype(float)
    others, times = placed(ordinary, size)
    n0 = float(times.sum())
    b = np.zeros(len(known))
    if len(others):
        at = np.minimum(np.searchsorted(others, known), len(others) - 1)
        b = np.where(others[at] == known, times[at], 0).astype(float)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    expected = (a + b) * n1 / (n0 + n1)
    g2 = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(np.maximum(b, 1) / (a + b - expected)), 0))
    return known[(odds > LEAST_ODDS) & (g2 > LEAST_G2)]


def stretches(text: bytes, marked: dict[int, np.ndarray]) -> bytes:
    """What the marked word beginnings cover of a text, one stretch after the other."""
    covered = np.zeros(len(text) + 1, bool)
    for size, known in marked.items():
        at, found = beginnings(text, size)
        for i in at[np.isin(found, known)]:
            covered[i : i + size] = True
    edges = np.flatnonzero(np.diff(np.append(False, covered).astype(np.int8)))
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))


class Distances:
    """How much shorter windows get with the toxic dictionary, counted from LOWEST on."""

    def __init__(self, model: Model):
        self.both, self.ordinary = compressor(model.toxic + model.ordinary), compressor(model.ordinary)

    def shorter(self, framed: list[bytes]) -> np.ndarray:
        both, ordinary = self.both.compress, self.ordinary.compress
        return np.array([len(ordinary(w)) - len(both(w)) for w in framed], np.int64)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text: 1, log counts of its windows by their difference, log of its windows."""
        bins = HIGHEST - LOWEST + 1
        counts = np.zeros((len(texts), bins), np.int64)
        held, owner = [], []

        def count() -> None:
            found = np.clip(self.shorter(held), LOWEST, HIGHEST) - LOWEST
            np.add.at(counts.reshape(-1), np.array(owner, np.int64) * bins + found, 1)
            held.clear()
            owner.clear()

        for row, text in enumerate(texts):
            own = windows(text)
            held += own
            owner += [row] * len(own)
            if len(held) >= AT_ONCE:
                count()
        if held:
            count()
        return np.column_stack([np.ones(len(texts)), np.log1p(counts), np.log1p(counts.sum(axis=1))])


def dictionaries(texts: list[str], toxic: list[bool]) -> tuple[bytes, bytes]:
    """(toxic dictionary, ordinary dictionary) of labelled texts."""
    samples = [b" " + b" ".join(words(t)) + b" " for t in texts]
    bad, good = [x for x, t in zip(samples, toxic) if t], [x for x, t in zip(samples, toxic) if not t]
    marked = {size: over_represented(bad, good, size) for size in SEQUENCES}
    left = [x for x in (stretches(t, marked) for t in bad) if x]
    return trained(left, TOXIC_BYTES) if left else b"", trained(good, ORDINARY_BYTES)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (p - y) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, usable: str = "true") -> Model:
    """usable: SQL condition on doc_id for rows whose labels may be learned from."""
    known = labels.filter("toxic is not null").filter(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    text = documents.select("doc_id", "text").filter(f"length(text) <= {SAMPLE_CHARS}")
    ids = known.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(SAMPLE_ORDINARY))
    rows = sorted(text.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic").collect(), key=lambda r: (r.h, r.doc_id, r.text))  # bounded by the sample
    texts, toxic = [r.text for r in rows], [bool(r.toxic) for r in rows]
    if not any(toxic) or all(toxic):
        return Model(b" ", b" ", (), 1.0 if toxic and all(toxic) else 0.0)
    half = [r.h % 2 == 0 for r in rows]
    if len({(t, h) for t, h in zip(toxic, half)}) < 4:  # too few rows to part
        half = [True] * len(rows)
        rest = half
    else:
        rest = [not h for h in half]
    model = Model(*dictionaries([t for t, h in zip(texts, half) if h], [t for t, h in zip(toxic, half) if h]), ())
    x = Distances(model).features([t for t, r in zip(texts, rest) if r])
    y = np.array([float(t) for t, r in zip(toxic, rest) if r])
    return Model(model.toxic, model.ordinary, tuple(calibrated(x, y)))


def scored(texts: pa.Array, model: Model, distances: Distances) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    found = distances.features(texts.to_pylist()) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(found, -30, 30)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                out = scored(some.column(1), model, distances)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(judged, "doc_id long, score double, predicted int")


def keep_ordinary(documents: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that are not predicted toxic: decided within the row, without a shuffle."""
    at = documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                yield some.filter(pa.array(scored(some.column(at), model, distances) < 0.5))

    return documents.mapInArrow(kept, documents.schema)
