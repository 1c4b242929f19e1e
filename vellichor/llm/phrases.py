"""Phrase collocations mined over compressed position bitmaps.

A shard is a slice of texts cut between pieces. In a shard every word has a bitmap of its positions, compressed to pairs
of (box, mask), a box being BITS positions and only boxes with a set bit being kept; a position without a word lies
between two pieces. A phrase is extended by a word by shifting the phrase's bitmap by one position, taking the AND with
the word's, and counting the bits left; since a box holds BITS words at most, one join by box extends a phrase by every
word that follows it. Phrases are extended depth-first, from runs of first words that fit in memory; the counts of
all shards are summed.

Three passes over the texts:

1. words of each language are counted;
2. pairs of words that are frequent everywhere are counted (depth 2);
3. phrases of 2 to LONGEST words, all of whose neighbouring pairs are frequent, are counted (depth LONGEST).

What is frequent reaches the next pass as a hashed bit filter, 32 bits an entry and at most 2^MOST_BITS bits (32 MB)
whatever the corpus: a word that it lets through by chance only costs time, since all counts are compared afterwards.
So a full filter costs speed and never a phrase.

Scale: texts are never shuffled; a shard's counts are combined in its task before they move. Whatever comes after the
third pass works on phrases with MIN or more occurrences. The first 2,000 of a language are found by a rank that Spark
limits before the shuffle, and only their words are looked up.

Words are runs of bytes other than 0x20, 0x09 and the piece ends; A-Z are lower-cased. Defined results: null text is
empty; null lang is `und`, as is the lang `und`; empty pieces hold no words; repeated rows count each; a language
without candidates has no rows; an empty table has none. Extra columns are not read. Words and languages have 64-bit
keys: two words are taken for one with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellichor.llm import words as W
from vellichor.session import staged

MIN, LONGEST, SHORTEST_KEPT, SHOWN = 30, 4, 80, 2000  # occurrences, words, percent of a shorter phrase's, phrases of a language
SLICE = 4 << 20  # bytes of a shard, unless a piece is longer
BITS = 8  # positions in a box
EXPAND = 1 << 18  # rows of a join by box at most, unless one word has more: a few MB for each of its arrays
HASHED = 1 << 16  # words hashed at once
MOST_BITS, LEAST_BITS, PER_ENTRY = 28, 16, 32
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
APART = ENDS_PIECE.copy()
APART[[0x20, 0x09]] = True
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


# shards -----------------------------------------------------------------------------------------------------------


@dataclass
class Shard:
    """Words of a slice: bytes, begin, end, key of (language, word), document's place in the batch, and position; neighbours in a piece have positions that differ by one."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def language_keys(langs: pa.Array) -> np.ndarray:
    """One 64-bit number a row."""
    coded = langs.dictionary_encode()
    keys = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return keys[coded.indices.to_numpy()] if len(keys) else np.zeros(0, np.uint64)


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where the slice that begins at `at` ends: between two pieces, SLICE bytes on or less if possible."""
    to = at + SLICE
    if to >= len(data):
        return len(data)
    bound = int(offsets[np.searchsorted(offsets, to, "right") - 1])
    inside = np.flatnonzero(ENDS_PIECE[data[at:to]])
    before = max(bound, at + int(inside[-1]) + 1 if len(inside) else at)
    if before > at:
        return before
    after = int(offsets[np.searchsorted(offsets, to, "right")])
    while to < after:
        inside = np.flatnonzero(ENDS_PIECE[data[to : min(after, to + SLICE)]])
        if len(inside):
            return to + int(inside[0]) + 1
        to += SLICE
    return after


def shards(batch: pa.RecordBatch) -> Iterator[Shard]:
    """The words of a batch of (text, lang), slice by slice."""
    texts = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    langs, at = language_keys(batch.column("lang")), int(offsets[0])
    while at < len(data):
        to = _cut(data, offsets, at)
        yield _shard(data[at:to], offsets, at, langs)
        at = to


def _shard(data: np.ndarray, offsets: np.ndarray, at: int, langs: np.ndarray) -> Shard:
    data = data + np.uint8(32) * ((data - np.uint8(65)) < 26)
    inside = ~APART[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + len(data))] - at
    begins[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start + at, "right") - 1
    piece = np.cumsum(ENDS_PIECE[data], dtype=np.int32)[start]
    gap = np.ones(len(start), np.int64)
    if len(start):
        gap[1:] += (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    key = np.empty(len(start), np.uint64)
    for i in range(0, len(start), HASHED):  # hashing takes some 40 bytes for each byte of a word
        j = slice(i, i + HASHED)
        key[j] = W.mixed(W._hashed(data, start[j], end[j]) ^ langs[doc[j]])
    return Shard(data, start, end, key, doc, np.cumsum(gap))


def _spelt(shard: Shard, which: np.ndarray) -> pa.Array:
    """The words at the given places of a shard."""
    start, length = shard.start[which], (shard.end - shard.start)[which]
    ends = np.append(0, np.cumsum(length))
    data = shard.data[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, word, f) of the words of each shard."""
    for batch in batches:
        for shard in shards(batch):
            coded = pa.array(shard.key).dictionary_encode()
            which = np.zeros(len(coded.dictionary), np.int64)
            codes = coded.indices.to_numpy()
            which[codes] = np.arange(len(codes))  # any of a word's places
            lang = batch.column("lang").take(pa.array(shard.doc[which]))
            counts = np.bincount(codes, minlength=len(which))
            yield pa.RecordBatch.from_arrays([lang, pa.array(coded.dictionary.to_numpy().view(np.int64)), _spelt(shard, which), pa.array(counts)], names=["lang", "key", "word", "f"])


# filters ----------------------------------------------------------------------------------------------------------


class Filter:
    """A bit for each of 2^bits hashed keys; never misses a key that is in it."""

    def __init__(self, bits: int, set_bits: np.ndarray | None = None):
        self.bits, self.set = bits, np.zeros(1 << bits - 6, np.uint64) if set_bits is None else set_bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        top = keys >> np.uint64(64 - self.bits)
        return (self.set[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) > 0


def filter_of(keys: DataFrame) -> Filter:
    """The filter of a table of distinct (key): at most 2^(MOST_BITS - 6) numbers reach the driver."""
    n = keys.count()
    out = Filter(min(MOST_BITS, max(LEAST_BITS, (PER_ENTRY * n).bit_length())))
    top = F.shiftrightunsigned("key", 64 - out.bits)
    # Bits combine before they are shuffled; a negative number is the 64th bit.
    rows = keys.groupBy(F.shiftright(top, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - out.bits}) & 63 as int))")).alias("bits")).toArrow()
    out.set[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def sent(found: Filter, spark: SparkSession) -> Broadcast:
    return spark.sparkContext.broadcast((found.bits, found.set))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mixed(left * W.MULTIPLIER + right)


# bitmaps ----------------------------------------------------------------------------------------------------------


@dataclass
class Bitmaps:
    """Compressed bitmaps of several phrases, in their order: phrase, box and mask of every box with a set bit. words: one row of word numbers a phrase."""

    words: np.ndarray
    of: np.ndarray
    box: np.ndarray
    mask: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, np.bitwise_count(self.mask), len(self.words)).astype(np.int64)

    def chosen(self, low: int, high: int) -> Bitmaps:
        """The boxes from low to high, whole phrases only; phrases keep their numbers."""
        return Bitmaps(self.words, self.of[low:high], self.box[low:high], self.mask[low:high])


def packed(code: np.ndarray, box: np.ndarray, mask: np.ndarray, words: np.ndarray) -> Bitmaps:
    """Bitmaps of rows in any order, of which no two share a bit."""
    order = np.sort((code.astype(np.uint64) << np.uint64(40)) | (box.astype(np.uint64) << np.uint64(8)) | mask)
    return Bitmaps(words, (order >> np.uint64(40)).astype(np.int64), ((order >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64), order.astype(np.uint8))


class Positions:
    """The bitmaps of a shard's words, also in the order of their boxes."""

    def __init__(self, shard: Shard, usable: Filter):
        use = usable.has(shard.key)
        coded = pa.array(shard.key[use]).dictionary_encode()
        self.keys = coded.dictionary.to_numpy()
        at, code = shard.at[use], coded.indices.to_numpy().astype(np.uint64)
        order = np.sort((code << np.uint64(40)) | at.astype(np.uint64))
        code, at = (order >> np.uint64(40)).astype(np.int64), (order & np.uint64((1 << 40) - 1)).astype(np.int64)
        box, bit = at // BITS, np.left_shift(np.uint8(1), (at % BITS).astype(np.uint8))
        new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (box[1:] != box[:-1]))) if len(at) else np.zeros(0, np.int64)
        mask = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        self.all = Bitmaps(np.arange(len(self.keys))[:, None], code[new], box[new], mask)
        n_boxes = int(box.max()) + 2 if len(box) else 1
        by_box = np.argsort(self.all.box, kind="stable")
        self.word, self.mask = self.all.of[by_box], self.all.mask[by_box]
        self.first = np.append(0, np.cumsum(np.bincount(self.all.box, minlength=n_boxes + 1)))

    def runs(self, phrases: Bitmaps) -> Iterator[Bitmaps]:
        """phrases in runs of whole phrases whose joins by box have about EXPAND rows at most."""
        cost = np.cumsum(self.first[phrases.box + 1] - self.first[phrases.box])
        ends = np.flatnonzero(np.append(phrases.of[1:] != phrases.of[:-1], True)) + 1 if len(phrases.of) else np.zeros(0, np.int64)
        low = 0
        while low < len(phrases.of):
            done = cost[low - 1] if low else 0
            k = max(np.searchsorted(ends, low, "right"), np.searchsorted(cost[ends - 1], done + EXPAND, "right") - 1)
            yield phrases.chosen(low, int(ends[k]))
            low = int(ends[k])

    def extended(self, phrases: Bitmaps, pairs: Filter | None) -> Bitmaps:
        """Every phrase with every word that follows it somewhere: shift, AND."""
        moved, over = phrases.mask << np.uint8(1), np.flatnonzero(phrases.mask >> np.uint8(BITS - 1))
        of, box, mask = np.concatenate([phrases.of, phrases.of[over]]), np.concatenate([phrases.box, phrases.box[over] + 1]), np.concatenate([moved, np.ones(len(over), np.uint8)])
        n = self.first[box + 1] - self.first[box]
        row = np.repeat(np.arange(len(of)), n)
        entry = np.arange(len(row)) + np.repeat(self.first[box] - (np.cumsum(n) - n), n)
        both = mask[row] & self.mask[entry]
        some = np.flatnonzero(both)
        row, word, both = row[some], self.word[entry[some]], both[some]
        of, box = of[row], box[row]
        if pairs is not None:
            likely = np.flatnonzero(pairs.has(pair_keys(self.keys[phrases.words[of, -1]], self.keys[word])))
            of, box, word, both = of[likely], box[likely], word[likely], both[likely]
        coded = pa.array(of * len(self.keys) + word).dictionary_encode()
        found = coded.dictionary.to_numpy()
        words = np.concatenate([phrases.words[found // max(len(self.keys), 1)], (found % max(len(self.keys), 1))[:, None]], axis=1)
        return packed(coded.indices.to_numpy(), box, both, words)

    def grown(self, phrases: Bitmaps, pairs: Filter | None, longest: int) -> Iterator[Bitmaps]:
        """Extensions of phrases, depth first."""
        for run in self.runs(phrases):
            longer = self.extended(run, pairs)
            yield longer
            if len(longer.words) and longer.words.shape[1] < longest:
                yield from self.grown(longer, pairs, longest)


def counted(words: Broadcast, pairs: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of each shard: without a filter of pairs (key, f) of every pair of words, else (w1, ..., f) of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usable, neighbours = Filter(*words.value), pairs and Filter(*pairs.value)
        for batch in batches:
            for shard in shards(batch):
                there = Positions(shard, usable)
                shard = found = keys = None  # nothing of a shard stays while the next one is cut
                for found in there.grown(there.all, neighbours, LONGEST if pairs else 2):
                    keys, f = there.keys[found.words], pa.array(found.counts())
                    if pairs is None:
                        yield pa.RecordBatch.from_arrays([pa.array(pair_keys(keys[:, 0], keys[:, 1]).view(np.int64)), f], names=["key", "f"])
                    else:
                        columns = [pa.array(keys[:, i].view(np.int64)) if i < keys.shape[1] else pa.array(np.zeros(len(keys), np.int64)) for i in range(LONGEST)]
                        yield pa.RecordBatch.from_arrays([*columns, f], names=[*WORDS, "f"])

    return run


# phrases ----------------------------------------------------------------------------------------------------------


def _part(low: int, high: int) -> list[Column]:
    """Words low to high (from 0, high not included) of a phrase as a phrase."""
    return [F.col(WORDS[low + i]).alias(w) if low + i < high else F.lit(0).cast("long").alias(w) for i, w in enumerate(WORDS)]


def _parts(ranges: Callable[[int], list[tuple]], *more: Callable[..., Column]) -> Column:
    """An array of structs for each length; a phrase takes its length's."""
    out = None
    for size in range(2, LONGEST + 1):
        structs = F.array(*(F.struct(*(c for x in r for c in (x if isinstance(x, list) else [x]))) for r in ranges(size)))
        out = F.when(F.col("size") == size, structs) if out is None else out.when(F.col("size") == size, structs)
    return out


def scored(phrases: DataFrame, every: DataFrame) -> DataFrame:
    """phrases (w1.., size, a) with score, l, r of the lowest-scoring cut. every: (w1.., f) of words and phrases."""
    cuts = _parts(lambda n: [(F.lit(k).alias("k"), F.struct(*_part(0, k)).alias("left"), F.struct(*_part(k, n)).alias("right")) for k in range(1, n)])
    rows = phrases.select(*WORDS, "size", "a", F.explode(cuts).alias("cut"))
    for side in ("left", "right"):
        known = every.select(*(F.col(w).alias(f"{side}_{w}") for w in WORDS), F.col("f").alias(side[0]))
        rows = rows.withColumns({f"{side}_{w}": F.col(f"cut.{side}.{w}") for w in WORDS}).join(known, [f"{side}_{w}" for w in WORDS])
    # Whole-number division of decimals is exact.
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("best")
    return rows.groupBy(*WORDS, "size", "a").agg(best).select(*WORDS, "size", "a", "best.score", "best.l", "best.r")


def uncovered(phrases: DataFrame) -> DataFrame:
    """phrases that no longer one with SHORTEST_KEPT percent of their occurrences holds."""
    inner = _parts(lambda n: [(_part(i, i + m),) for m in range(2, n) for i in range(n - m + 1)] or [(_part(0, n),)])
    held = phrases.filter("size > 2").select(F.col("a").alias("longer"), F.explode(inner).alias("part")).groupBy(*(F.col(f"part.{w}").alias(w) for w in WORDS)).agg(F.max("longer").alias("longer"))
    covered = F.expr(f"longer is not null and cast(100 as decimal(10,0)) * cast(longer as decimal(20,0)) >= cast({SHORTEST_KEPT} as decimal(10,0)) * cast(a as decimal(20,0))")
    return phrases.join(held, WORDS, "left").filter(~covered).drop("longer")


def collocations(documents: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first SHOWN phrases of each language."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    known = staged(texts.mapInArrow(vocabulary, "lang string, key long, word string, f long").groupBy("lang", "key", "word").agg(F.sum("f").alias("f")))
    frequent = staged(known.filter(F.col("f") >= MIN))
    words = sent(filter_of(frequent.select("key")), spark)
    likely = texts.mapInArrow(counted(words, None), "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= MIN).select("key")
    pairs = sent(filter_of(staged(likely)), spark)
    columns = ", ".join(f"{w} long" for w in WORDS)
    size = sum((F.when(F.col(w) != 0, 1).otherwise(0) for w in WORDS), F.lit(0))
    found = texts.mapInArrow(counted(words, pairs), f"{columns}, f long").groupBy(*WORDS).agg(F.sum("f").alias("a")).filter(F.col("a") >= MIN).withColumn("size", size)
    phrases = staged(found)

    every = frequent.select(F.col("key").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in WORDS[1:]), "f").unionByName(phrases.select(*WORDS, F.col("a").alias("f")))
    kept = scored(uncovered(phrases), every).join(frequent.select(F.col("key").alias("w1"), "lang"), "w1")
    order = [F.desc("score"), F.desc("a")]
    near = kept.withColumn("k", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= SHOWN)
    near = staged(near.select("lang", *WORDS, "a", "l", "r", "score"))
    spelt = near.select("*", F.posexplode(F.array(*WORDS)).alias("i", "key")).filter("key <> 0").join(frequent.select("key", "word"), "key")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ")  # LONGEST words at most
    named = spelt.groupBy("lang", *WORDS, "a", "l", "r", "score").agg(phrase.alias("phrase"))
    totals = known.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= SHOWN)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
