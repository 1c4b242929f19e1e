"""From an analysed corpus to books that can be kept: ids in reading order, JSON, checks, migration, reports, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = 1
#: Provenances in the order of the report.
VIA_ORDER = ["inquit_after", "inquit_before", "inquit_paragraph", "pronoun", "continuation", "same_paragraph", "alternation", "proximity", "unknown", "llm", "user"]
TYPES = ["p", "h1", "h2", "quote", "verse"]


def numbered(prefix: str, number: Column, width: int) -> Column:
    """b00001: digits are added beyond the width, never cut."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def book_ids(blocks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with block_id, spans with annotation_id), counted through a book in reading order. spans: (book_id, chapter_ord, block_ord, s, ...)."""
    at = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord")
    ids = blocks.withColumn("block_id", numbered("b", F.row_number().over(at), 5))
    order = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord", "s")
    return ids, spans.withColumn("annotation_id", numbered("a", F.row_number().over(order), 6))


def final_cast(cast: DataFrame) -> DataFrame:
    """Figures that speak or are pinned, by lines, then name: (…, place). cast: (book_id, speaker, name, lines, pinned)."""
    order = Window.partitionBy("book_id").orderBy(F.desc("lines"), "name", "speaker")
    return cast.filter("lines > 0 or pinned").withColumn("place", F.row_number().over(order).cast("long"))


def preset_index(presets: DataFrame) -> DataFrame:
    """(book_id, key, speaker) by which kept figures are found: names first, then aliases.

    An alias that is another figure's name takes that figure over: all its keys lead to the alias' owner. Of several
    owners of a key the last in order wins. presets: (book_id, ord, speaker, name, aliases)."""
    slot = F.struct("ord", "speaker")
    names = presets.select("book_id", F.lower("name").alias("key"), "ord", "speaker").groupBy("book_id", "key").agg(F.max(slot).alias("x")).select("book_id", "key", F.col("x.speaker").alias("speaker"))
    aliases = presets.select("book_id", "ord", "speaker", F.explode("aliases").alias("key")).withColumn("key", F.trim(F.lower("key"))).groupBy("book_id", "key").agg(F.max(slot).alias("x")).select("book_id", "key", F.col("x.speaker").alias("owner"))
    both = names.join(aliases, ["book_id", "key"], "full")
    gone = both.filter("speaker is not null and owner is not null and speaker <> owner").select("book_id", F.col("speaker").alias("lost"), F.col("owner").alias("to"))
    found = both.select("book_id", "key", F.coalesce("owner", "speaker").alias("speaker"))
    return found.join(gone.groupBy("book_id", F.col("lost").alias("speaker")).agg(F.max("to").alias("to")), ["book_id", "speaker"], "left").select("book_id", "key", F.coalesce("to", "speaker").alias("speaker"))


def mapped_speakers(speakers: DataFrame, index: DataFrame, known: DataFrame) -> DataFrame:
    """Figures of one book named as those of another: by name or alias, else by id, else ?id. speakers: (book_id, speaker, names in order); index: (book_id, key, target); known: (book_id, speaker)."""
    tried = speakers.select("book_id", "speaker", F.posexplode("names").alias("k", "name")).withColumn("key", F.lower("name")).join(index, ["book_id", "key"])
    first = tried.groupBy("book_id", "speaker").agg(F.min_by("target", "k").alias("by_name"))
    rows = speakers.select("book_id", "speaker").join(first, ["book_id", "speaker"], "left").join(known.select("book_id", "speaker", F.lit(True).alias("same")), ["book_id", "speaker"], "left")
    return rows.select("book_id", "speaker", F.coalesce("by_name", F.when(F.col("same"), F.col("speaker")), F.concat(F.lit("?"), "speaker")).alias("mapped"))


def chapter_json(blocks: DataFrame) -> DataFrame:
    """A chapter as JSON, blocks in reading order: (book_id, chapter_ord, json). blocks: (…, block_id, type, text)."""
    rows = F.array_sort(F.collect_list(F.struct("block_ord", F.struct(F.col("block_id").alias("id"), "type", "text").alias("block"))))
    return blocks.groupBy("book_id", "chapter_ord").agg(F.to_json(F.transform(rows, lambda r: r.block)).alias("json"))


def schema_violations(blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(book_id, rule, detail) for every value out of its set or range. blocks: (…, block_id, type, sentences, n); annotations: (…, id, kind, conf)."""
    bound = F.exists("sentences", lambda x: (x.s > x.e) | (x.e > F.col("n")))
    rules = [
        (blocks, ~F.col("type").isin(TYPES), "block type", "block_id"),
        (blocks, ~F.col("block_id").rlike(r"^b\d{5,}$"), "block id", "block_id"),
        (blocks, bound, "sentence bounds", "block_id"),
        (annotations, ~F.col("kind").isin("speech", "quote", "emphasis", "note", "retake", "bookmark", "pause", "breath"), "annotation type", "id"),
        (annotations, ~F.col("conf").between(0, 1), "confidence", "id"),
    ]
    found = [rows.filter(F.coalesce(wrong, F.lit(True))).select("book_id", F.lit(rule).alias("rule"), F.col(detail).alias("detail")) for rows, wrong, rule, detail in rules]
    return reduce(DataFrame.unionByName, found)


def version_gate(books: DataFrame, current: int = VERSION, steps: tuple[int, ...] = ()) -> DataFrame:
    """What a stored book's version allows: (book_id, outcome, from_version). steps: versions that a migration starts from."""
    v = F.col("version")
    ok = F.lit(True)
    for k in range(1, current):
        ok = ok & ((v > k) | F.lit(k in steps))
    outcome = F.when(F.col("format").isNull() | (F.col("format") != "book"), "no book").when(v.isNull() | (v != F.floor(v)) | (v < 1), "bad version").when(v > current, "newer").when(v == current, "current").when(ok, "migrate").otherwise("no migration")
    return books.select("book_id", outcome.alias("outcome"), v.alias("from_version"))


def info_report(stats_by_via: DataFrame, cast: DataFrame, most: int = 15) -> tuple[DataFrame, DataFrame]:
    """(provenances in their fixed order with their percentage, the most figures by lines and how many more there are)."""
    place = F.array_position(F.array(*[F.lit(v) for v in VIA_ORDER]), F.col("via"))
    order = Window.partitionBy("book_id").orderBy(F.when(place > 0, place).otherwise(99), "via")
    via = stats_by_via.select("book_id", F.row_number().over(order).cast("long").alias("place"), "via", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("book_id")), 1).alias("percent"))
    ranked = cast.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("lines"), "name")).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("book_id")))
    return via, ranked.filter(F.col("place") <= most).select("book_id", "place", "name", "lines", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))


def accuracy_table(compared: DataFrame) -> DataFrame:
    """Counts of a comparison with their percentage of what was found: (book_id, measure, n, percent)."""
    names = ["correct", "wrong", "unattributed", "queued", "silent_wrong"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in names]))
    rows = compared.select("book_id", "found", cells.alias("x"))
    return rows.select("book_id", "x.measure", "x.n", F.when(F.col("found") > 0, F.round(100.0 * F.col("x.n") / F.col("found"), 1)).alias("percent"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last put of each key; keys whose last step is a deletion are gone. snapshots: (book_id, seq, op, saved, position, blocks)."""
    last = snapshots.groupBy("book_id").agg(F.max_by(F.struct("seq", "op", "saved", "position", "blocks"), "seq").alias("x")).select("book_id", "x.*")
    return last.filter("op = 'put'").select("book_id", "seq", "saved", "position", "blocks")


def recent(snapshots: DataFrame) -> DataFrame:
    """Kept books, newest first, with the share of blocks read: (book_id, saved, percent)."""
    rows = latest_snapshots(snapshots)
    percent = F.when(F.col("blocks") > 0, F.floor(100.0 * F.coalesce("position", F.lit(0)) / F.col("blocks") + 0.5)).otherwise(0).cast("long")
    return rows.select("book_id", "saved", percent.alias("percent")).orderBy(F.desc("saved"), "book_id")


def conditional_writes(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Which writes may go on: (path, outcome). wanted: (path, expected_sha, forced); stored: (path, sha). A write that expects a state is refused if the file has another one or is gone."""
    rows = wanted.join(stored, "path", "left")
    outcome = F.when(F.col("forced") | F.col("expected_sha").isNull(), "written").when(F.col("sha").isNull(), "vanished").when(F.col("sha") == F.col("expected_sha"), "written").otherwise("conflict")
    return rows.select("path", outcome.alias("outcome"))
