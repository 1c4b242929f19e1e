"""A block of text as it is shown: cut at every edge, each piece with what covers it.

Edges are events: a running sum of +1 and -1 along a block tells which kinds are active on a piece (sweep line). Which of
the active speeches and emphases counts, the last in the book's order, is a stabbing query: an interval is a handful of
dyadic buckets, (level, place) stands for [place * 2^level, (place + 1) * 2^level), of which only the last annotation is
kept, and a piece lies in one bucket of each level. So no piece meets every annotation of its block, and everything
joins on equal keys.

annotations: (book_id, block_ord, id, ord, type, s, e, at, speaker, confidence, origin, color, note, length), pauses and
breaths with at, the others with s and e; ord is their order in the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import letter_words
from vellichor.session import staged

KEYS = ["book_id", "block_ord"]
LEVELS = 32
REVIEW = 0.5  # certainty below which a speaker is to be reviewed
PENS = 6
COUNTED = ["speech", "quote", "emphasis", "retake", "note", "bookmark", "em", "strong"]
BEGIN = ["retake", "note", "bookmark"]  # kinds that are named where they begin
#: Fixed value: signs that may stand between a sentence's final period and its end.
TRAILING = "«»“”‘’‹›\"')\\]}"


def buckets(s: str, e: str) -> Column:
    """array<struct<level, node>>: the dyadic buckets that make up [s, e)."""
    low, high = f"shiftright({s} + shiftleft(1L, L) - 1, L)", f"shiftright({e}, L)"
    pair = f"array(if({low} % 2 = 1, named_struct('level', L, 'node', {low}), null), if({high} % 2 = 1, named_struct('level', L, 'node', {high} - 1), null))"
    some = f"filter(if({low} < {high}, {pair}, array()), x -> x is not null)"
    return F.expr(f"flatten(transform(sequence(0, cast(ceil(log2({e} + 1)) as int)), L -> {some}))")


def around(at: str, levels: str) -> Column:
    """array<struct<level, node>>: the buckets of each level up to `levels` that hold at."""
    return F.expr(f"transform(sequence(0, {levels}), L -> named_struct('level', L, 'node', shiftright({at}, L)))")


def covering(annotations: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (book_id, block_ord, offset) with each annotation's id that covers the offset; one without length covers its first sign. Points cover nothing."""
    ranged = annotations.filter("type not in ('pause', 'breath')").withColumn("z", F.greatest(F.col("e"), F.col("s") + 1)).filter("z > 0").withColumn("a", F.greatest("s", F.lit(0).cast("long")))
    held = ranged.select(*KEYS, "id", F.inline(buckets("a", "z")))
    return hits.select(*KEYS, "offset").distinct().select(*KEYS, "offset", F.inline(around("offset", str(LEVELS)))).join(held, [*KEYS, "level", "node"]).select(*KEYS, "offset", "id")


def without_final_period(text: Column) -> Column:
    return F.regexp_replace(text, rf"\.([{TRAILING}]*\s*)$", "$1")


def segments(sentences: Column, n: Column) -> Column:
    """array<struct<sentence, a, z>>: sentences (array of s, e) and the gaps between them, whose sentence is null."""
    part = lambda i, a, z: F.struct(i.cast("long").alias("sentence"), a.cast("long").alias("a"), z.cast("long").alias("z"))
    gap = F.lit(None)
    none = F.array().cast("array<struct<sentence:long,a:long,z:long>>")
    before = lambda i: F.coalesce(F.get(sentences, i - 1).e, F.lit(0))
    inner = F.transform(sentences, lambda x, i: F.concat(F.when(x.s > before(i), F.array(part(gap, before(i), x.s))).otherwise(none), F.array(part(i, x.s, x.e))))
    end = F.when(F.size(sentences) > 0, F.element_at(F.transform(sentences, lambda x: x.e), -1)).otherwise(F.lit(0))
    return F.concat(F.flatten(inner), F.when((end < n) | (F.size(sentences) == 0), F.array(part(gap, end, n))).otherwise(none))


def rendered(blocks: DataFrame, annotations: DataFrame, formats: DataFrame, cast: DataFrame, strip_periods: bool = True) -> DataFrame:
    """Rows of kind text, point and start, in the order of (seg, s, ix) within a block.

    blocks: (book_id, block_ord, text, sentences array<struct<s, e>>); formats: (book_id, block_ord, kind em or strong,
    s, e); cast: (book_id, speaker, badge). A text is a piece between two edges, with the speech that covers it (the badge
    on its first piece), the pen of its emphasis, and whether other kinds do. A point is a pause or breath, once, in the
    first segment that reaches it, before the text at its place. A start is where a retake, note or bookmark begins. The
    last piece of a sentence loses its final period. Edges outside a text are moved to its ends; points outside are lost.
    """
    blocks = blocks.select(*KEYS, "text", F.coalesce("sentences", F.array().cast("array<struct<s:long,e:long>>")).alias("sentences"), F.length("text").cast("long").alias("n"))
    zero = F.lit(0).cast("long")
    clamp = lambda c: F.least(F.greatest(F.col(c).cast("long"), zero), F.col("n"))
    sized = annotations.join(blocks.select(*KEYS, "n"), KEYS)
    ranged = sized.filter("type not in ('pause', 'breath')").withColumn("a", clamp("s")).withColumn("z", clamp("e"))
    points = sized.filter("type in ('pause', 'breath') and at between 0 and n")
    styles = formats.join(blocks.select(*KEYS, "n"), KEYS).select(*KEYS, F.col("kind").alias("type"), clamp("s").alias("a"), clamp("e").alias("z"))

    both = ranged.select(*KEYS, "type", "a", "z").unionByName(styles)
    edges = both.select(*KEYS, F.inline(F.array(F.struct(F.col("a").alias("pos"), F.when(F.col("a") < F.col("z"), F.col("type")).alias("type"), F.lit(1).alias("step")), F.struct(F.col("z").alias("pos"), F.when(F.col("a") < F.col("z"), F.col("type")).alias("type"), F.lit(-1).alias("step")))))
    ends = F.concat(F.array(zero, F.col("n")), F.transform("sentences", lambda x: F.least(F.greatest(x.s, zero), F.col("n"))), F.transform("sentences", lambda x: F.least(F.greatest(x.e, zero), F.col("n"))))
    bare = blocks.select(*KEYS, F.explode(ends).alias("pos")).unionByName(points.select(*KEYS, F.col("at").cast("long").alias("pos")))
    edges = edges.unionByName(bare.withColumn("type", F.lit(None).cast("string")).withColumn("step", F.lit(0)))
    cuts = edges.groupBy(*KEYS, "pos").agg(*(F.sum(F.when(F.col("type") == k, F.col("step")).otherwise(0)).alias(k) for k in COUNTED))

    parts = blocks.select(*KEYS, "text", F.posexplode(segments(F.col("sentences"), F.col("n"))).alias("seg", "x")).filter("x.a < x.z")
    words = F.when(F.col("x.sentence").isNotNull(), letter_words(F.expr("substring(text, cast(x.a as int) + 1, cast(x.z - x.a as int))"))).otherwise(0)
    parts = parts.select(*KEYS, F.col("x.a").alias("pos"), F.struct("seg", "x.sentence", "x.z", words.cast("long").alias("words")).alias("part"))
    along = Window.partitionBy(*KEYS).orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = cuts.join(parts, [*KEYS, "pos"], "left").withColumns({"part": F.last("part", ignorenulls=True).over(upto), "next": F.lead("pos").over(along), **{k: F.sum(k).over(upto) > 0 for k in COUNTED}})
    rows = staged(rows.withColumn("part_before", F.lag("part").over(along)))

    last = F.max_by(F.struct("id", "speaker", "confidence", "origin", "color", "a"), "ord").alias("top")
    held = ranged.filter("type in ('speech', 'emphasis') and a < z").select(*KEYS, "type", "ord", "id", "speaker", "confidence", "origin", "color", "a", F.inline(buckets("a", "z")))
    held = held.groupBy(*KEYS, "type", "level", "node").agg(F.max("ord").alias("ord"), last)
    active = rows.filter("next is not null and (speech or emphasis)").join(blocks.select(*KEYS, "n"), KEYS).select(*KEYS, "pos", F.inline(around("pos", "cast(ceil(log2(n + 1)) as int)")))
    tops = active.join(held, [*KEYS, "level", "node"]).groupBy(*KEYS, "pos").agg(*(F.max_by(F.when(F.col("type") == k, F.col("top")), F.when(F.col("type") == k, F.col("ord"))).alias(f"top_{k}") for k in ("speech", "emphasis")))

    said = F.col("top_speech")
    texts = rows.filter("next is not null").join(blocks.select(*KEYS, "text"), KEYS).join(tops, [*KEYS, "pos"], "left").join(cast.select("book_id", F.col("speaker").alias("who"), "badge"), (F.col("who") == said.speaker) & (cast["book_id"] == rows["book_id"]), "left").drop(cast["book_id"])
    whole = F.expr("substring(text, cast(pos as int) + 1, cast(next - pos as int))")
    shown = F.when(F.col("part.sentence").isNotNull() & (F.col("next") == F.col("part.z")), without_final_period(whole)).otherwise(whole) if strip_periods else whole
    null = lambda t: F.lit(None).cast(t)
    pen = F.col("top_emphasis.color")
    texts = texts.select(
        *KEYS, F.col("part.seg").cast("long").alias("seg"), F.col("part.sentence").alias("sentence"), "part.words", F.lit("text").alias("kind"), F.col("pos").alias("s"), F.col("next").alias("e"), shown.alias("text"),
        said.id.alias("id"), said.speaker.alias("speaker"), (F.coalesce(said.origin, F.lit("")) != "user").alias("open"), said.confidence.alias("confidence"), F.when(said.a == F.col("pos"), F.coalesce("badge", F.lit("?"))).alias("badge"),
        "quote", "emphasis", F.when((pen >= 0) & (pen < PENS), pen).alias("pen"), "retake", "note", "bookmark", F.col("em").alias("italic"), F.col("strong").alias("bold"), F.lit(1).alias("rank"), null("long").alias("ord"),
    )
    weak = F.when(F.col("id").isNotNull(), F.col("open") & (F.col("speaker").isNull() | (F.col("confidence") < REVIEW)))
    texts = texts.withColumn("weak", weak).withColumn("user", F.when(F.col("id").isNotNull(), ~F.col("open"))).drop("open", "confidence").withColumn("mark", null("string")).withColumn("long", null("boolean"))

    flags = {k: null("boolean") for k in ("quote", "emphasis", "retake", "note", "bookmark", "italic", "bold", "weak", "user")} | {"speaker": null("string"), "badge": null("string"), "pen": null(dict(annotations.dtypes)["color"])}
    at = rows.select(*KEYS, "pos", "part", "part_before")
    part = F.coalesce("part_before", "part")
    dots = points.select(*KEYS, F.col("at").cast("long").alias("pos"), "id", "ord", "type", "length").join(at, [*KEYS, "pos"])
    dots = dots.select(*KEYS, F.coalesce(part.seg, F.lit(0)).cast("long").alias("seg"), part.sentence.alias("sentence"), F.coalesce(part.words, zero).alias("words"), F.lit("point").alias("kind"), F.col("pos").alias("s"), F.col("pos").alias("e"), null("string").alias("text"), "id", F.lit(0).alias("rank"), "ord", F.col("type").alias("mark"), F.coalesce((F.col("type") == "pause") & (F.col("length") == "long"), F.lit(False)).alias("long")).withColumns(flags)
    begins = ranged.filter(F.col("type").isin(BEGIN) & (F.col("a") < F.col("z"))).select(*KEYS, F.col("a").alias("pos"), "id", "ord", "type", F.col("note").alias("said")).join(at.drop("part_before"), [*KEYS, "pos"])
    begins = begins.select(*KEYS, F.col("part.seg").cast("long").alias("seg"), F.col("part.sentence").alias("sentence"), "part.words", F.lit("start").alias("kind"), F.col("pos").alias("s"), F.col("pos").alias("e"), F.when(F.col("type") == "note", F.col("said")).when((F.col("type") == "retake") & (F.col("said") != ""), F.col("said")).alias("text"), "id", F.lit(2).alias("rank"), "ord", F.col("type").alias("mark"), null("boolean").alias("long")).withColumns(flags)
    out = texts.unionByName(dots).unionByName(begins)
    order = Window.partitionBy(*KEYS).orderBy("seg", "s", "rank", "ord")
    return out.withColumn("ix", F.row_number().over(order).cast("long") - 1).drop("rank", "ord")
