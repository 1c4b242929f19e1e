"""Views on books: search, rendering, marks, progress, comparison of versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import SPACE, clipped, letter_words, word_count


def tolerant(query: str) -> str | None:
    """A pattern for what was typed: any apostrophe, quote or blank stands for its kind; null under two signs."""
    query = query.strip()
    if len(query) < 2:
        return None
    kinds = {"'’‘`": "['’‘`]", "\"„“”»«": "[\"„“”»«]"}
    out = ""
    for part in re.split(r"(\s+|['’‘`]|[\"„“”»«])", query):
        if part.isspace():
            out += SPACE + "+"
        else:
            out += next((to for signs, to in kinds.items() if part and part in signs), "\\Q" + part + "\\E" if part else "")
    return "(?iu)" + out


def hits(blocks: DataFrame, query: str) -> DataFrame:
    """A row per hit with its offsets."""
    from vellichor.operators.segment import MARK, pieces

    pattern = tolerant(query)
    if pattern is None:
        return blocks.select("book_id", "chapter_ord", "block_ord", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e")).limit(0)
    parts = pieces(F.regexp_replace("text", f"({pattern})", MARK + "$1" + MARK))
    found = F.filter(parts, lambda p, i: (i % 2) == 1)
    return blocks.filter(F.col("text").rlike(pattern)).select("book_id", "chapter_ord", "block_ord", F.explode(found).alias("x")).select("book_id", "chapter_ord", "block_ord", "x.s", "x.e")


def hit_count(text: Column, query: str) -> Column:
    return F.regexp_count(text, F.lit(tolerant(query))).cast("long")


def render_pieces(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Blocks cut at every edge of a mark: (…, ix, s, e, ids) with the marks that cover each piece. marks: (book_id, block_ord, id, s, e)."""
    keys = ["book_id", "block_ord"]
    grouped = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "id"))).alias("marks"))
    rows = blocks.select(*keys, F.length("text").cast("long").alias("n")).join(grouped, keys, "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<s:long,e:long,id:string>>")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("n")), F.transform("marks", lambda m: m.s), F.transform("marks", lambda m: m.e))))
    rows = rows.withColumn("edges", F.filter(edges, lambda x: (x >= 0) & (x <= F.col("n"))))
    pairs = F.transform(F.slice("edges", 1, F.size("edges") - 1), lambda x, i: F.struct(x.alias("s"), F.get("edges", i + 1).alias("e")))
    cut = rows.select(*keys, "marks", F.posexplode(pairs).alias("ix", "x"))
    covering = F.filter("marks", lambda m: (m.s <= F.col("x.s")) & (m.e >= F.col("x.e")))
    return cut.select(*keys, F.col("ix").cast("long").alias("ix"), "x.s", "x.e", F.array_join(F.transform(covering, lambda m: m.id), ",").alias("ids"))


def progress(blocks: DataFrame, wpm: int = 150) -> DataFrame:
    """Letter words before each block, percent of the book's words, minutes left."""
    order = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("w", letter_words(F.col("text"))).withColumn("t", word_count(F.col("text")))
    rows = rows.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0)).cast("long")).withColumn("total", F.sum("t").over(Window.partitionBy("book_id")))
    left = F.greatest(F.col("total") - F.col("before"), F.lit(0))
    return rows.select("book_id", "chapter_ord", "block_ord", "before", F.round(F.when(F.col("total") > 0, F.col("before") * 100.0 / F.col("total")).otherwise(0.0), 4).alias("percent"), F.floor(left / wpm + 0.5).cast("long").alias("minutes_left"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of two versions that are the n-th with the same text: (book_id, block_ord, other_ord)."""
    numbered = lambda rows: rows.withColumn("key", F.regexp_replace(F.trim("text"), r"\s+", " ")).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "key").orderBy("chapter_ord", "block_ord")))
    return numbered(left).select("book_id", "key", "k", "block_ord").join(numbered(right).select("book_id", "key", "k", F.col("block_ord").alias("other_ord")), ["book_id", "key", "k"]).select("book_id", "block_ord", "other_ord")


def compared(reference: DataFrame, found: DataFrame) -> DataFrame:
    """Accuracy per book of found spans against reference spans that overlap at least by half: both have (book_id, block_ord, s, e, speaker), found has conf."""
    pairs = reference.alias("r").join(found.alias("f"), (F.col("r.book_id") == F.col("f.book_id")) & (F.col("r.block_ord") == F.col("f.block_ord")) & (F.col("f.s") < F.col("r.e")) & (F.col("r.s") < F.col("f.e")), "left")
    overlap = F.least("r.e", "f.e") - F.greatest("r.s", "f.s")
    rows = pairs.select(F.col("r.book_id").alias("book_id"), F.col("r.block_ord").alias("block_ord"), F.col("r.s").alias("s"), F.col("r.e").alias("e"), F.col("r.speaker").alias("wanted"), F.col("f.speaker").alias("speaker"), F.col("f.conf").alias("conf"), F.when(overlap * 2 >= F.col("r.e") - F.col("r.s"), overlap).alias("overlap"))
    best = rows.groupBy("book_id", "block_ord", "s", "e", "wanted").agg(F.max_by(F.struct("speaker", "conf", "overlap"), F.coalesce("overlap", F.lit(-1))).alias("b"))
    hit = F.col("b.overlap").isNotNull()
    right, none = F.col("b.speaker") == F.col("wanted"), F.col("b.speaker").isNull()
    low = F.col("b.conf") < 0.5
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return best.groupBy("book_id").agg(F.count("*").alias("reference"), n(hit).alias("found"), n(hit & right).alias("correct"), n(hit & ~none & ~right).alias("wrong"), n(hit & none).alias("unattributed"), n(hit & (none | low)).alias("queued"), n(hit & ~none & ~right & ~low).alias("silent_wrong"))


def mark_list(marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Marks in reading order with the text they mark. marks: (book_id, block_ord, id, type, s, e, note)."""
    rows = marks.join(blocks.select("book_id", "chapter_ord", "block_ord", "text"), ["book_id", "block_ord"])
    order = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord", "s", "id")
    marked = clipped(F.expr("substring(text, cast(s as int) + 1, cast(e - s as int))"), 60)
    return rows.select("book_id", F.row_number().over(order).cast("long").alias("place"), "chapter_ord", "block_ord", "id", "type", marked.alias("marked"), "note")


def csv_field(x: Column) -> Column:
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike("[\";\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: Kinds of marks and columns as users read them.
KINDS = {"retake": "Retake", "bookmark": "Lesezeichen", "note": "Notiz", "emphasis": "Betonung"}
HEADER = "Art;Kapitel;Kapiteltitel;Satz;Text;Notiz;Farbe"


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[kind], kind)


def marks_csv(listed: DataFrame) -> DataFrame:
    """One CSV per book: header, semicolons, CRLF, a byte order mark. listed: (book_id, place, type, chapter_ord, title, sentence, marked, note, pen)."""
    line = F.concat_ws(";", csv_field(kind_label(F.col("type"))), csv_field(F.col("chapter_ord") + 1), *[csv_field(F.col(c)) for c in ("title", "sentence", "marked", "note", "pen")])
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return listed.groupBy("book_id").agg(F.concat(F.lit("\ufeff" + HEADER + "\r\n"), F.array_join(F.transform(rows, lambda r: r.line), "\r\n"), F.lit("\r\n")).alias("csv"))


def marks_text(listed: DataFrame) -> DataFrame:
    """One text per book, a line per mark: kind (pen) · Kap. n, Satz m: text – note."""
    pen = F.when(F.col("pen").isNotNull(), F.concat(F.lit(" ("), "pen", F.lit(")"))).otherwise("")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" – "), "note")).otherwise("")
    line = F.concat(kind_label(F.col("type")), pen, F.lit(" · Kap. "), (F.col("chapter_ord") + 1).cast("string"), F.lit(", Satz "), F.col("sentence").cast("string"), F.lit(": "), "marked", note)
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return listed.groupBy("book_id").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("text"))


def speech_steps(spans: DataFrame) -> DataFrame:
    """For each span of a figure the place of its next and previous one, across chapters; null at the ends."""
    order = Window.partitionBy("book_id", "speaker").orderBy("chapter_ord", "block_ord", "s")
    place = F.struct("chapter_ord", "block_ord", "s")
    rows = spans.filter("speaker is not null").withColumn("next", F.lead(place).over(order)).withColumn("previous", F.lag(place).over(order))
    return rows.select("book_id", "speaker", "chapter_ord", "block_ord", "s", F.col("next.block_ord").alias("next_block"), F.col("next.s").alias("next_s"), F.col("previous.block_ord").alias("previous_block"), F.col("previous.s").alias("previous_s"))


def review_context(queue: DataFrame, blocks: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """The blocks around each unsure span, without headings: (book_id, place, block_ord, text)."""
    near = queue.select("book_id", "place", F.explode(F.sequence(F.col("block_ord") - before, F.col("block_ord") + after)).alias("block_ord"))
    return near.join(blocks.filter("type not in ('h1', 'h2')").select("book_id", "block_ord", "text"), ["book_id", "block_ord"]).select("book_id", "place", "block_ord", "text")
