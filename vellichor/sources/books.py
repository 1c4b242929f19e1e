"""Book tables from the driver's tables.

blocks: (book_id, chapter_ord, block_ord, type, text). The script corpus makes a book of every conversation: a turn is
a block, eight turns a chapter, and the utterance is set in quotes with or without a clause that names its speaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAPTER_TURNS = 8
#: Role -> figure.
FIGURES = {"user": "Anna", "assistant": "Jonas", "system": "Paul"}
#: Signs that an utterance must not hold: quotes, line ends and ends of sentences.
NOT_IN_SPEECH = r"[»«„“”‚‘›‹\"\r\n.!?…:]"


def script(conversations: DataFrame, chars: int | None = None) -> DataFrame:
    """(book_id, chapter_ord, block_ord, kind, who, type, text); chars: only so many characters of each utterance."""
    who = F.when(F.col("role") == "user", "Anna").when(F.col("role") == "assistant", "Jonas").otherwise("Paul")
    said = F.regexp_replace("text" if chars is None else F.substring("text", 1, chars), NOT_IN_SPEECH, " ")
    kind = (F.col("turn") % 3).cast("int")
    text = F.when(F.col("kind") == 0, F.concat(F.lit("»"), "said", F.lit("«, sagte "), "who", F.lit("."))).when(F.col("kind") == 1, F.concat("who", F.lit(" sagte: »"), "said", F.lit("«"))).otherwise(F.concat(F.lit("»"), "said", F.lit("«")))
    rows = conversations.select(F.col("conv_id").alias("book_id"), F.floor(F.col("turn") / CHAPTER_TURNS).cast("long").alias("chapter_ord"), F.col("turn").alias("block_ord"), kind.alias("kind"), who.alias("who"), said.alias("said"))
    return rows.select("book_id", "chapter_ord", "block_ord", "kind", "who", F.lit("p").alias("type"), text.alias("text"))


def text_blocks(documents: DataFrame) -> DataFrame:
    """A block for each line of a document that is not blank; the document is a book of one chapter."""
    lines = documents.select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("book_id", F.lit(0).cast("long").alias("chapter_ord"), F.col("line").cast("long").alias("block_ord"), F.lit("p").alias("type"), F.trim("text").alias("text")).filter("text <> ''")


def chapters(blocks: DataFrame, heading: str = r"(?i)^(kapitel|chapter|teil|part)\b|^[IVXLC]+\.?$") -> DataFrame:
    """Chapters by headings: a short block that looks like one opens a chapter; headings in a row are one."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id").orderBy("block_ord")
    is_head = (F.length("text") < 80) & F.col("text").rlike(heading)
    marked = blocks.withColumn("head", is_head)
    opens = F.col("head") & ~F.coalesce(F.lag("head").over(order), F.lit(False))
    return marked.withColumn("opens", opens).withColumn("chapter_ord", F.sum(F.col("opens").cast("long")).over(order)).withColumn("type", F.when(F.col("head") & F.col("opens"), "h1").when(F.col("head"), "h2").otherwise(F.col("type"))).drop("head", "opens")


def chosen_chapters(blocks: DataFrame, ranges: str | None = None, min_words: int = 0) -> DataFrame:
    """Chapters of a 1-based list such as "2-13" or "1,3,5-" and, among these, of enough words."""
    from vellichor.functions.text import word_count

    if ranges:
        wanted = F.lit(False)
        for part in ranges.split(","):
            low, dash, high = part.strip().partition("-")
            number = F.col("chapter_ord") + 1
            wanted = wanted | ((number >= int(low or 1)) & ((number <= int(high)) if high else F.lit(True)) if dash else number == int(low))
        blocks = blocks.filter(wanted)
    if min_words:
        enough = blocks.groupBy("book_id", "chapter_ord").agg(F.sum(word_count(F.col("text"))).alias("w")).filter(F.col("w") >= min_words)
        blocks = blocks.join(enough, ["book_id", "chapter_ord"], "left_semi")
    return blocks
