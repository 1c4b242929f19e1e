"""Conflict-constrained best-fit packing of documents into bins of CAPACITY words.

Documents longer than a bin are cut into whole bins and a rest. Pieces go, longest first, into the bin with the least
residual that still holds them and is compatible: no two pieces of one source, and none of one duplicate cluster, share
a bin. Bins are ordered by residual (a bitmap of the residuals in use gives the next one that is large enough); each
carries a bitmap of its sources and one of its clusters. The successor search goes on until the tightest compatible bin
is found; only if there is none, a new bin opens.

Scale: only (id, piece, length, source, cluster) moves, never a text. Pieces are dealt by a hash of their id over shards
of about SHARD pieces, each packed by itself: a hot source or cluster is spread over all shards, and each shard loses
at most its last few bins' room.

Defined results: null, empty and white-space texts have no words and no bin (bin and place are null); a null source
or cluster conflicts with nothing; repeated rows are packed each; an empty table gives no rows. Extra columns are not
read. A cluster, unless a column names it, is the hash of the text.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.session import staged

CAPACITY = 2048
SHARD = 2000
SCHEMA = "doc_id long, piece long, begin long, n_words long, bin long, place long"


class Bin:
    __slots__ = ("number", "residual", "sources", "clusters", "used")

    def __init__(self, number: int, capacity: int):
        self.number, self.residual, self.sources, self.clusters, self.used = number, capacity, 0, 0, 0


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.by_residual: dict[int, list[Bin]] = {}
        self.in_use = 0  # bit r: some bin has residual r

    def _put(self, bin_: Bin) -> None:
        self.by_residual.setdefault(bin_.residual, []).append(bin_)
        self.in_use |= 1 << bin_.residual

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words in it before) for a piece with these conflict bits."""
        larger = self.in_use >> length << length
        while larger:
            residual = (larger & -larger).bit_length() - 1
            row = self.by_residual[residual]
            for k, found in enumerate(row):
                if not (found.sources & source or found.clusters & cluster):
                    row.pop(k)
                    if not row:
                        self.in_use ^= 1 << residual
                    return self._add(found, length, source, cluster)
            larger &= larger - 1
        self.count += 1
        return self._add(Bin(self.count - 1, self.capacity), length, source, cluster)

    def _add(self, bin_: Bin, length: int, source: int, cluster: int) -> tuple[int, int]:
        before = bin_.used
        bin_.used += length
        bin_.residual -= length
        bin_.sources |= source
        bin_.clusters |= cluster
        if bin_.residual:
            self._put(bin_)
        return bin_.number, before


def bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs more than once; 0 for null and for values that cannot conflict."""
    counts = values.value_counts()
    of = {v: 1 << i for i, v in enumerate(counts.index[counts > 1])}
    return [of.get(v, 0) if not pd.isna(v) else 0 for v in values]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    bins = Bins(capacity)
    placed = [bins.place(n, s, c) for n, s, c in zip(rows["n_words"].tolist(), bits(rows["source"]), bits(rows["cluster"]))]
    rows["bin"] = [int(shard) << 32 | b for shard, (b, _) in zip(rows["shard"], placed)]
    rows["place"] = [p for _, p in placed]
    return rows[["doc_id", "piece", "begin", "n_words", "bin", "place"]]


def pack(documents: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, begin (its first word in the document), n_words, bin, place (words before it in the bin)."""
    spark = documents.sparkSession
    n = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("words"), F.col("source").cast("string").alias("source"), (F.col(cluster) if cluster else F.xxhash64("text")).cast("string").alias("cluster"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("long")).cast("array<long>"))
    pieces = docs.select("*", piece.alias("piece")).withColumn("begin", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("begin")))
    pieces = staged(pieces.select("doc_id", "piece", "begin", "n_words", "source", "cluster"))
    shards = max(1, math.ceil(pieces.count() / SHARD))
    dealt = pieces.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(rows, capacity)

    none = pieces.filter("n_words = 0").select("doc_id", "piece", "begin", "n_words", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("place"))
    return dealt.groupBy("shard").applyInPandas(packed, SCHEMA).unionByName(none)
