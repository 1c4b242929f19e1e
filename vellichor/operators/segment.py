"""Sentences of blocks, with one boundary pattern: a boundary is marked, the text is split there, and offsets follow
from the lengths of the pieces. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import letter_words, word_count

#: Abbreviations after which a period ends no sentence, and months after an ordinal.
ABBREVIATIONS = """
z b zb dh ua ggf bzw ca evtl usw usf vgl bspw inkl exkl max min mind sog u a d h nr abb tab kap bd jh jhd chr geb gest
verst ebd ff f s str pl hrsg aufl od bzgl etc dr prof dipl ing med phil jur rer nat hc hr fr frl mr mrs ms st hl kl gr
nachm vorm mio mrd tsd gez i v m e o n z.b mt jr sr vs eg ie approx dept univ co inc ltd cf al ed vol pp fig no esp
""".split()
MONTHS = """
januar februar märz april mai juni juli august september oktober november dezember jänner
january february march may june july october december
""".split()
#: Signs that may open and close a sentence, and signs that begin one.
OPENERS, CLOSERS = "«»„“”‘’‚‹›\"'([{–—-", "«»“”‘’‹›\"')]}"
UPPER = "A-ZÄÖÜÁÀÂÉÈÊÍÎÓÔÚÛÑÇŠŽŁ0-9"
MARK = "\u0001"


def _class(signs: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-\"'" else c for c in signs) + "]"


def boundary() -> str:
    """The pattern of a sentence end: its stop and the closing signs after it."""
    no_token = r"(?<![\p{L}\p{N}.])"
    names = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=lambda a: (-len(a), a)))
    period = (
        r"(?<![.!?…])\.(?![.!?…])"
        + rf"(?<!{no_token}(?i:{names})\.)"
        + rf"(?<!{no_token}\p{{L}}\.)"
        + rf"(?<!{no_token}(?:[0-2]?[0-9]|3[01])\.)"
        + rf"(?!(?<={no_token}[0-9]{{3,9}}\.)\s*(?i:{'|'.join(MONTHS)})(?!\p{{L}}))"
    )
    ellipsis = rf"(?<![.!?…])(?:…[.!?…]*|\.\.\.(?![.!?…]))(?={_class(CLOSERS)}*\s*[{UPPER}»„“\"])"
    others = r"(?<![.!?…])(?!…|\.\.\.(?![.!?…])|\.(?![.!?…]))[.!?…]+"
    follows = rf"(?=\s*(?:[{UPPER}]|{_class(OPENERS)}|$))"
    return rf"((?:{period}|{ellipsis}|{others}){_class(CLOSERS)}*+)(?!(?<=[0-9][.!?…]{{1,9}})[0-9]){follows}"


BOUNDARY = boundary()


def pieces(marked: Column) -> Column:
    """Of text split at marks: array of (s, e, text), offsets in the text without marks. Only the running sums of lengths are folded, no texts."""
    parts = F.split(marked, MARK)
    none = F.array(F.lit(0).cast("long"))
    ends = F.aggregate(parts, none, lambda acc, p: F.concat(acc, F.array((F.element_at(acc, -1) + F.length(p)).cast("long"))))
    return F.zip_with(parts, F.slice(ends, 2, 1 << 30), lambda p, e: F.struct((e - F.length(p)).cast("long").alias("s"), e.alias("e"), p.alias("text")))


def sentence_spans(text: Column) -> Column:
    """array<struct<s, e>>: sentences without the white space before them."""
    parts = F.filter(pieces(F.regexp_replace(text, BOUNDARY, "$1" + MARK)), lambda p: F.trim(p.text) != "")
    return F.transform(parts, lambda p: F.struct((p.s + F.length(p.text) - F.length(F.regexp_replace(p.text, r"^\s+", ""))).alias("s"), p.e.alias("e")))


def with_sentences(blocks: DataFrame) -> DataFrame:
    """Adds words and sentences; headings have none."""
    none = F.array().cast("array<struct<s:long,e:long>>")
    return blocks.withColumn("words", word_count(F.col("text"))).withColumn("sentences", F.when(F.col("type").isin("h1", "h2"), none).otherwise(sentence_spans(F.col("text"))))


def sentences(blocks: DataFrame) -> DataFrame:
    """A row per sentence: sid counts from 1 in its chapter, gsid in its book.

    Numbers are running sums of the blocks' counts plus the place in the block, so sentences and their texts are made
    after the exchange, which moves whole blocks once."""
    keys = ["book_id", "chapter_ord", "block_ord"]
    rows = with_sentences(blocks).select(*keys, "text", "sentences", F.size("sentences").cast("long").alias("n"))
    book = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(book), F.lit(0)))
    first = F.min("before").over(Window.partitionBy("book_id", "chapter_ord"))
    rows = rows.withColumn("chapter_before", first)
    # An outer explode, filtered afterwards: a filter that Spark infers from an inner one would find the bounds twice.
    rows = rows.select(*keys, "text", "before", "chapter_before", F.posexplode_outer("sentences").alias("sent_ix", "span")).filter("span is not null")
    text = F.col("text").substr(F.col("span.s").cast("int") + 1, (F.col("span.e") - F.col("span.s")).cast("int"))
    rows = rows.select(*keys, F.col("sent_ix").cast("long").alias("sent_ix"), F.col("span.s").alias("s"), F.col("span.e").alias("e"), (F.col("before") - F.col("chapter_before") + F.col("sent_ix") + 1).cast("long").alias("sid"), (F.col("before") + F.col("sent_ix") + 1).cast("long").alias("gsid"), text.alias("text"))
    return rows.withColumn("words", letter_words(F.col("text")))


def plain_sentences(text: Column) -> Column:
    """Number of sentences by stops alone."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s) != "")).cast("long")


def running_numbers(blocks: DataFrame) -> DataFrame:
    """Number of each block's first sentence in its chapter, from per-block counts."""
    order = Window.partitionBy("book_id", "chapter_ord").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("n", plain_sentences(F.col("text")))
    return rows.select("book_id", "chapter_ord", "block_ord", "n", (F.lit(1) + F.coalesce(F.sum("n").over(order), F.lit(0))).cast("long").alias("first_no"))
