"""Direct speech: the quotation style of a book, and the spans of its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import count_of
from vellichor.operators.segment import MARK, pieces

#: Style -> (opening, closing) sign.
STYLES = {"guillemets_de": ("»", "«"), "guillemets_fr": ("«", "»"), "low_high_de": ("„", "“"), "curly_en": ("“", "”"), "straight": ('"', '"'), "dash": ("—", "")}
INNER = (("‚", "‘"), ("›", "‹"), ("‹", "›"))
DASH = r"^\s*[–—]\s+"


def quote_scores(blocks: DataFrame) -> DataFrame:
    """Counts per book that decide its style."""
    c = lambda sign: F.sum(count_of(F.col("text"), sign))
    a, z = F.instr("text", "»"), F.instr("text", "«")
    both = (a > 0) & (z > 0)
    return blocks.groupBy("book_id").agg(
        c("»").alias("right"), c("«").alias("left"), c("„").alias("low"), c("“").alias("high"), c("”").alias("curly"), c('"').alias("double"),
        F.count_if(both & (a < z)).alias("de"), F.count_if(both & (z < a)).alias("fr"),
        F.count_if(F.col("type") == "p").alias("paragraphs"), F.count_if((F.col("type") == "p") & F.col("text").rlike(DASH)).alias("dashes"),
    )


def quote_style(blocks: DataFrame) -> DataFrame:
    """(book_id, style, open, close): the style with most pairs; dialogue by dashes if there are none."""
    s = quote_scores(blocks).withColumn("guillemets", F.least("right", "left")).withColumn("straight", F.floor(F.col("double") / 2))
    best = F.greatest("guillemets", "low", "curly", "straight")
    s = s.withColumn("best", best)
    name = (
        F.when((F.col("best") > 0) & (F.col("guillemets") == F.col("best")), F.when(F.col("de") >= F.col("fr"), "guillemets_de").otherwise("guillemets_fr"))
        .when((F.col("best") > 0) & (F.col("low") == F.col("best")), "low_high_de")
        .when((F.col("best") > 0) & (F.col("curly") == F.col("best")), "curly_en")
        .when((F.col("best") > 0) & (F.col("straight") == F.col("best")), "straight")
        .when(F.col("dashes") / F.greatest("paragraphs", F.lit(1)) > 0.2, "dash").otherwise("none")
    )
    of = lambda k: F.create_map(*[F.lit(x) for style, signs in STYLES.items() for x in (style, signs[k])])
    close = F.when((F.col("style") == "low_high_de") & (F.col("high") < F.col("curly")), "”").otherwise(of(1)[F.col("style")])
    return s.withColumn("style", name).select("book_id", "style", F.coalesce(of(0)[F.col("style")], F.lit("")).alias("open"), F.coalesce(close, F.lit("")).alias("close"))


SPAN = "struct<s:long,e:long,open_end:boolean,inner:boolean>"


def _paired(text: Column, opening: Column, closing: Column, inner: bool) -> Column:
    """Spans from an opening sign to the next closing one, or to the end."""
    pattern = F.concat(F.lit("("), opening, F.lit("[^"), closing, F.lit("]*(?:"), closing, F.lit("|$))"))
    parts = pieces(F.regexp_replace(text, pattern, F.lit(MARK + "$1" + MARK)))
    spans = F.filter(parts, lambda p, i: (i % 2) == 1)
    return F.transform(spans, lambda p: F.struct(p.s.alias("s"), p.e.alias("e"), (~(F.substring(p.text, -1, 1) == closing) | (F.length(p.text) == 1)).alias("open_end"), F.lit(inner).alias("inner")))


def speech_spans(blocks: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """A row per span: book_id, chapter_ord, block_ord, span_ix, s, e, open_end, cont, inner."""
    styles = quote_style(blocks) if styles is None else styles
    rows = blocks.join(styles, "book_id").filter(~F.col("type").isin("h1", "h2") & (F.col("open") != ""))
    none = F.array().cast(f"array<{SPAN}>")
    dash = F.regexp_extract("text", r"^(\s*[–—]\s+(?:(?!\s[–—]\s)[\s\S])*)", 1)
    dashed = F.when(dash != "", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.length(dash).cast("long").alias("e"), F.lit(False).alias("open_end"), F.lit(False).alias("inner")))).otherwise(none)
    outer = F.when(F.col("style") == "dash", dashed).otherwise(_paired(F.col("text"), F.col("open"), F.col("close"), False))
    rows = rows.withColumn("outer", outer)
    within = F.flatten(F.array(*[_paired(F.col("text"), F.lit(a), F.lit(b), True) for a, b in INNER]))
    rows = rows.withColumn("within", F.filter(within, lambda x: F.exists("outer", lambda o: (o.s < x.s) & (x.e <= o.e))))
    ordered = F.array_sort(F.concat("outer", "within"), lambda x, y: F.when(x.s < y.s, -1).when(x.s > y.s, 1).when(x.e > y.e, -1).when(x.e < y.e, 1).otherwise(0))
    rows = rows.withColumn("spans", ordered)
    order = Window.partitionBy("book_id", "chapter_ord").orderBy("block_ord")
    last = F.element_at("spans", -1)
    open_before = F.coalesce(F.lag(F.when(F.size("spans") > 0, last.open_end & ~last.inner).otherwise(False)).over(order), F.lit(False))
    rows = rows.withColumn("carry", open_before)
    out = rows.select("book_id", "chapter_ord", "block_ord", "carry", F.posexplode("spans").alias("span_ix", "x"))
    return out.select("book_id", "chapter_ord", "block_ord", F.col("span_ix").cast("long").alias("span_ix"), "x.s", "x.e", "x.open_end", (F.col("carry") & (F.col("span_ix") == 0) & ~F.col("x.inner")).alias("cont"), "x.inner")
