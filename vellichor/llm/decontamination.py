"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are runs of letters and digits, in lower case. A seed hashes the words at the fixed places of a mask and ignores
those between. The two MASKS together hit, at some offset, every pair of WINDOW aligned words with at most TOLERANCE
substitutions (all 78 patterns of two substitutions were enumerated; the tests do so again). Around each hit the
document and the benchmark item are compared along the diagonal: a document leaks an item if some WINDOW consecutive
aligned words differ in at most TOLERANCE places.

Scale: the seeds of a document are made as one array in its row and meet the benchmark's in a broadcast hash join while
the benchmark has at most BROADCAST_WORDS words (that is checked), else in a shuffle join. Only hits remain: their
distinct diagonals, combined before they move, are joined back to the texts, each of which is hashed once for all its
hits. A passage that many documents hold makes no group larger than one document's own hits.

Items too short for a mask are hashed whole, and so are the runs of as many words of the documents, for the lengths that
the benchmark has (six numbers at most); the two meet by length and hash, and the first match of an item is verified.

Defined results: items of fewer than WINDOW words leak only where all their words match in a row, be it one word; null or
empty texts have no words; documents with equal ids are one, those without an id are told apart by their text; items are
told apart by id and text, and an item without an id leaks as one whose id is null; empty tables give no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 5, 7, 9))
SPAN = max(m[-1] for m in MASKS) + 1
SHORTEST = min(m[-1] for m in MASKS) + 1
WINDOW, TOLERANCE = 13, 2
BROADCAST_WORDS = 500_000  # about 24 MB of seeds


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def seed_at(words: str, k: int) -> Callable[[Column], Column]:
    """The hash of mask k laid at a place."""
    return lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(words), i + p) for p in MASKS[k]])


def seeded(rows: DataFrame, ids: list[str], words: str, at: str) -> DataFrame:
    """(ids, place, seed) for each place and mask. The hashes are made per row, as one array: no words travel with a place."""
    # Outer explodes and no filter on the words: Spark would move such a filter below them and make them again in it.
    size = F.size(words)
    rows = rows.select(*ids, words, F.when(size >= SHORTEST, F.sequence(F.lit(0), size - SHORTEST)).alias("places"))
    laid = [F.transform("places", seed_at(words, k)) for k in range(len(MASKS))]
    rows = rows.select(*ids, F.size("places").alias("n"), F.concat(*laid).alias("seeds"))
    return rows.select(*ids, "n", F.posexplode_outer("seeds").alias("k", "seed")).select(*ids, (F.col("k") % F.col("n")).alias(at), "seed")


def short_hits(docs: DataFrame, items: DataFrame, small: bool) -> DataFrame | None:
    """(*DOC, item, diagonal): where each document first holds an item of fewer words than a mask spans; None if there are no such items."""
    short = items.filter((F.size("b") > 0) & (F.size("b") < SHORTEST)).select("item", F.size("b").alias("n"), F.xxhash64("b").alias("seed"))
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # fewer than SHORTEST numbers
    if not lengths:
        return None
    runs = lambda n: F.transform(F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.xxhash64(F.slice("h", i + 1, n)).alias("seed")))
    none = F.array().cast("array<struct<n:int,i:int,seed:long>>")
    laid = docs.select(*DOC, F.explode_outer(F.concat(*(F.coalesce(runs(n), none) for n in lengths))).alias("x")).select(*DOC, "x.*")
    return laid.join(F.broadcast(short) if small else short, ["n", "seed"]).groupBy(*DOC, "item").agg(F.min("i").alias("diagonal"))


def leak_of(x: Column, diagonal: Column) -> Column:
    """Of an item x (item_id, b) on a diagonal: the best window and the words that match in all."""
    low, high = F.greatest(F.lit(0), -diagonal), F.least(F.size(x.b), F.size("h") - diagonal)
    equal = F.transform(F.sequence(low, F.greatest(low, high - 1)), lambda q: F.coalesce((F.get(x.b, q) == F.get("h", q + diagonal)).cast("int"), F.lit(0)))
    window = F.least(F.lit(WINDOW), F.size(x.b))
    total = lambda part: F.aggregate(part, F.lit(0), lambda sum_, e: sum_ + e)

    def judged(e: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(e) - window + 1)), lambda s: total(F.slice(e, s, window))))
        return F.struct(x.item_id.alias("item_id"), best.alias("best"), total(e).alias("matched"), F.size(x.b).alias("item_words"), diagonal.alias("diagonal"))

    return F.get(F.transform(F.array(equal), judged), 0)


def verified(hits: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Of distinct hits (*DOC, item, diagonal): the leaks, by document and item. A text is hashed once for all its hits."""
    # An item's words go once with each document that it hits, with all its diagonals there.
    grouped = hits.groupBy(*DOC, "item").agg(F.collect_list("diagonal").alias("diagonals"))
    listed = grouped.join(items, "item").groupBy(*DOC).agg(F.collect_list(F.struct("item_id", "diagonals", "b")).alias("found"))
    rows = docs.select(*DOC, "text").join(listed, DOC).select(*DOC, "found", word_hashes(F.col("text")).alias("h"))
    leaked = F.flatten(F.transform("found", lambda x: F.transform(x.diagonals, lambda d: leak_of(x, d))))
    rows = rows.select(*DOC, F.explode_outer(leaked).alias("x")).select(*DOC, "x.*")
    long = F.col("item_words") >= WINDOW
    leaking = rows.filter(F.col("best") >= F.when(long, WINDOW - TOLERANCE).otherwise(F.col("item_words")))
    return leaking.groupBy(*DOC, "item_id").agg(F.max("best").cast("long").alias("best_window"), F.max("matched").cast("long").alias("matched_words"), F.max("item_words").cast("long").alias("item_words"), F.min("diagonal").cast("long").alias("first_at"))


DOC = ["doc", "unnamed"]


def identity() -> list[Column]:
    """What tells documents apart, never null: the id, or a hash of the text where there is none, and which of the two it is."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.col("doc_id").isNull()]


def found_leaks(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(*DOC, item_id, best_window, matched_words, item_words, first_at)."""
    texts = documents.select(*(c.alias(n) for c, n in zip(identity(), DOC)), "text")
    docs = texts.select(*DOC, word_hashes(F.col("text")).alias("h"))
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", word_hashes(F.col("text")).alias("b")).dropDuplicates(["item"])
    total = items.agg(F.coalesce(F.sum(F.size("b")), F.lit(0))).first()[0]
    small = total <= broadcast_words
    wanted = seeded(items, ["item"], "b", "j")
    wanted = F.broadcast(wanted) if small else wanted
    hits = seeded(docs, DOC, "h", "i").join(wanted, "seed").select(*DOC, "item", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    short = short_hits(docs, items, small)
    return verified(hits if short is None else hits.unionByName(short), texts, items)


def leaks(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, best_window, matched_words, item_words, first_at): documents that hold passages of items."""
    found = found_leaks(documents, benchmark, broadcast_words)
    return found.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "item_id", "best_window", "matched_words", "item_words", "first_at")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing."""
    gone = found_leaks(documents, benchmark).select(*(F.col(c).alias(f"leaking_{c}") for c in DOC)).distinct()
    doc, unnamed = identity()
    return documents.join(gone, (doc == F.col("leaking_doc")) & (unnamed == F.col("leaking_unnamed")), "left_anti")
