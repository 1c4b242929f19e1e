"""Token ids as Parquet list columns.

Documents are range-partitioned and sorted by id, encoded in the tasks, and written by Spark's committer as
(doc_id, part, row, n_tokens, ids): dictionary-encoded int lists (delta encoding where the dictionary grows too large:
version 2 pages), row groups of ROW_GROUP bytes and pages of PAGE bytes with column and offset indexes, so that a
reader that filters on doc_id or reads only the metadata columns touches few pages. Where a document's ids start in the
whole sequence follows from the sums of the parts (one number for each part reaches the driver).

Encoding: the tokenizers library on pieces of text. A byte-level pre-tokenizer never joins what stands on both sides of
the cuts that `cuts` makes, so each distinct piece is encoded once in a worker's life, and a batch's ids are gathered
from the distinct pieces' by array operations. Texts that hold an added token's text, and all texts of tokenizers that
work otherwise, are encoded whole.

Defined results: null text is empty (only the end id); repeated ids stay separate rows, in the order of their texts'
hashes, and are dealt over partitions by them; null ids come first; an empty table gives empty files. Extra columns of
the input are not read.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellichor.session import partitions, shared_dir

END_ID = 2
ROW_GROUP, PAGE = 16 << 20, 256 << 10
CACHE, LONGEST, JOINED = 800_000, 64, 4000  # pieces remembered by a worker, the bytes of the longest of them, and pieces encoded in one call
SLICE = 1 << 20  # bytes of text handled at once; a longer text is a slice of its own

SPACE, LETTER, STOP = 1, 2, 4  # classes of ASCII bytes: white space, letters and digits, other visible signs
SIGN = LETTER | STOP
CLASSES = bytes(SPACE if c == 0x20 or 0x09 <= c <= 0x0D else 0 if not 0x20 < c < 0x7F else LETTER if chr(c).isalnum() else STOP for c in range(256))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places (after the first) of UTF-8 text where a byte-level pre-tokenizer begins a new token, whatever follows.

    Its tokens are white space or, after one blank at most, letters, digits or other signs (or an apostrophe with some
    letters), so a token ends before white space that follows a sign, before a stop that follows a letter or digit, and
    after a line end that stands alone between signs. Of characters beyond ASCII only U+00C0-U+00FF are judged."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = np.frombuffer(data.tobytes().translate(CLASSES), np.uint8)
    before, now = kind[:-1], kind[1:]
    sign = (before & SIGN) != 0
    letter = (before & LETTER) != 0
    at = np.flatnonzero(data[:-2] == 0xC3) + 1  # second bytes, as places in before
    at = at[data[at] >= 0x80]
    sign[at] = True
    letter[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = True  # without the signs for times and divided
    cut = ((now & SPACE) != 0) & sign
    cut |= ((now & STOP) != 0) & letter
    cut[1:] |= (data[1:-1] == 0x0A) & ((kind[:-2] & SIGN) != 0) & ((now[1:] & SIGN) != 0)
    return np.flatnonzero(cut) + 1


def remembered(path: str) -> dict[bytes, bytes]:
    """Ids of pieces, kept for a worker's life: this module travels by value, so its own globals last for one task."""
    kept = sys.modules.setdefault("vellichor_worker_state", types.ModuleType("vellichor_worker_state"))
    return kept.__dict__.setdefault("piece_ids", {}).setdefault(path, {})


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.known = remembered(path)
        before = t.pre_tokenizer
        self.in_pieces = isinstance(t.model, models.BPE) and not t.model.dropout and t.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and not t.truncation and not t.padding

        if self.in_pieces:
            vocabulary = t.get_vocab(with_added_tokens=True)
            self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.n_bytes[i] = len(token)  # byte-level vocabularies write a byte as one character

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learned(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece. Pieces whose joint is a sure cut (a sign, then one blank and a sign) are encoded as one text, whose ids fall apart by their bytes."""
        joint = [len(p) > 1 and p[0] == 32 and bool(CLASSES[p[1]] & SIGN and CLASSES[p[-1]] & SIGN) for p in pieces]
        rest = [p for p, j in zip(pieces, joint) if not j]
        found = dict(zip(rest, self._encoded(rest)))
        joined = [p for p, j in zip(pieces, joint) if j]
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(p) for p in some]), "right") * 4
            data, begin = ids.tobytes(), 0
            for piece, end in zip(some, ends.tolist()):
                found[piece] = data[begin:end]
                begin = end
        return found

    def _of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, pieces))
        new = [k for k, ids in enumerate(found) if ids is None]
        fresh = self._learned([pieces[k] for k in new])
        for k in new:
            found[k] = fresh[pieces[k]]
        if len(known) > CACHE:
            known.clear()
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
        return found

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of data[offsets[k]:offsets[k + 1]]."""
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] if not self.in_pieces or any(x in data.tobytes() for x in self.added) else []
        whole = [k for k, t in enumerate(texts) if not self.in_pieces or any(x in t for x in self.added)]
        if len(whole) == len(offsets) - 1:
            ids = self._encoded(texts)
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts(data)] = True
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        found = self._of_pieces(pieces.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int32, len(found)) // 4
        begin = np.cumsum(length, dtype=np.int32) - length
        which = pieces.indices.to_numpy()
        n = length[which]
        upto = np.cumsum(n, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[which] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
        counts = np.diff(np.append(0, upto)[np.searchsorted(starts, offsets)]).astype(np.int64)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in zip(whole, self._encoded([texts[k] for k in whole])):
                parts[k] = np.frombuffer(x, "<u4")
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, number of ids of each row) of slices of texts; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield at, to, *self.slice(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text and write the files under path."""
    spark = documents.sparkSession

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for at, to, ids, counts in encoder.encode(batch.column(1)):
                values = np.full(len(ids) + len(counts), end_id, np.int32)  # the end id stays where no other is put
                ends = np.cumsum(np.append(0, counts + 1))
                inside = np.ones(len(values), bool)
                inside[ends[1:] - 1] = False
                values[inside] = ids
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(counts + 1), lists], names=["doc_id", "n_tokens", "ids"])

    n = partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    out = dealt.mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>").withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33).cast("int"))
    out.select("doc_id", "part", "row", "n_tokens", "ids").write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE)).parquet(path)


def read_tokens(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """(doc_id, part, row, n_tokens, ids); condition on doc_id, part or n_tokens is pushed down to pages."""
    rows = spark.read.schema("doc_id long, part int, row long, n_tokens long, ids array<int>").parquet(path)
    return rows.filter(condition) if condition else rows


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    sizes = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each part
    before = np.cumsum([0, *(n for _, n in sizes)])
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "part int, base long")
    rows = files.select("doc_id", "part", "row", "ids").mapInArrow(summed, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    earlier = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.coalesce(earlier, F.lit(0)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, read back, digest."""
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/tokens_{uuid.uuid4().hex}"
    write_tokens(documents, path, tokenizer or default_tokenizer())
    return digests(read_tokens(spark, path))
