"""Positioned text of PDF pages to lines, and lines to paragraphs: items are (doc_id, page, str, x, y, width, size).

A page is small; a document may have any number of them. So lines meet within their page, and what goes on from page to
page (the line before a page's first, the number of the paragraph) is one row a page. Between the steps lines are written
in buckets of whole pages (by `leaf`, a hash of document and page): texts move once to their page and once to their
paragraph, and all else happens in the buckets or moves numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.session import partitions, staged

# Page numbers, ends of sentences, a hyphen at a line's end before a small letter.
PAGE_NUMBER = r"(?iu)^\s*[-–—\[(]?\s*(?:seite\s+|page\s+)?(?:\d{1,4}|[ivxlcdm]{1,7})\s*[-–—\])]?\s*$"
SENTENCE_END = r"[.!?…:»«\"'”“]\s*$"
HYPHENATED = r"(?<=\p{L})[-­‐‑]\n(?=\p{Ll})"
# Sizes and gaps, as multiples of the body's size or of the usual gap and width.
HEADING, INDENT, CENTRED, GAP, SHORT = 1.2, 0.8, 2.0, 1.6, 0.72
LONG = 20  # characters beyond which a line counts for sizes and widths


LEAF = ["leaf", "doc_id", "page"]


def _by_leaf(rows: DataFrame) -> DataFrame:
    if "leaf" in rows.columns:
        return rows
    return rows.withColumn("leaf", F.xxhash64("doc_id", "page")).repartition(partitions(rows.sparkSession), "leaf")


def lines(items: DataFrame) -> DataFrame:
    """Items on one baseline are a line; a gap of more than 0.15 of the size is a blank. Lines run down the page."""
    page = Window.partitionBy(*LEAF).orderBy(F.desc("y"), "x")
    near = F.abs(F.col("y") - F.lag("y").over(page)) <= F.greatest(F.lit(1.5), 0.45 * F.least("size", F.lag("size").over(page)))
    rows = _by_leaf(items).filter("trim(str) <> ''").withColumn("opens", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("line", F.sum("opens").over(page))
    row = Window.partitionBy(*LEAF, "line").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(row)
    rows = rows.withColumn("piece", F.concat(F.when(gap > 0.15 * F.col("size"), " ").otherwise(""), "str"))
    parts = F.array_sort(F.collect_list(F.struct("x", "piece")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p.piece), ""), r"\s+", " "))
    return rows.groupBy(*LEAF, "line").agg(text.alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max("y").alias("y"), F.max("size").alias("size"))


def _pages(rows: DataFrame) -> DataFrame:
    """Lines written in buckets of whole pages."""
    return staged(_by_leaf(rows), bucket=(partitions(rows.sparkSession), "leaf"))


def without_running_heads(found: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines without running heads and feet: from the top of a page every line that is a page number or is, but for digits, the first of many pages, until one is neither; then the same from the bottom.

    Many is a quarter of the pages, three at least. pages: (doc_id, pages) where some have no lines. A line goes if all
    lines from its edge of the page on are such lines: a running minimum.
    """
    found = _pages(found)
    key = F.lower(F.regexp_replace("text", r"\d+", "#"))
    edges = found.groupBy(*LEAF).agg(F.min_by("text", "line").alias("top"), F.max_by("text", "line").alias("bottom"))
    edges = staged(edges.select("doc_id", *(F.lower(F.regexp_replace(c, r"\d+", "#")).alias(c) for c in ("top", "bottom"))))
    total = edges.groupBy("doc_id").agg(F.count("*").alias("pages")) if pages is None else pages.select("doc_id", "pages")
    many = F.greatest(F.lit(3), F.floor(F.col("pages") / 4))
    # A quarter of the pages each, or three of fewer than sixteen: five keys a document at most.
    often = [edges.groupBy("doc_id", F.col(c).alias("key")).agg(F.count("*").alias("n")).join(total, "doc_id").filter(F.col("n") >= many).groupBy("doc_id").agg(F.collect_list("key").alias(f"{c}s")) for c in ("top", "bottom")]
    # Keys go to the pages (a row each), pages to their lines in the buckets: a join by leaf alone moves no line.
    leaves = found.select(*LEAF).distinct().join(often[0], "doc_id", "left").join(often[1], "doc_id", "left")
    rows = found.join(leaves.select("leaf", "tops", "bottoms"), "leaf")
    number = F.col("text").rlike(PAGE_NUMBER)
    known = lambda keys: number | F.coalesce(F.array_contains(keys, key), F.lit(False))
    page = Window.partitionBy(*LEAF)
    rows = rows.withColumns({"top": known("tops"), "bottom": known("bottoms")})  # in one step, so that both share what they look at
    rows = rows.withColumn("from_top", F.min("top").over(page.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("from_bottom", F.min("bottom").over(page.orderBy("line").rowsBetween(0, Window.unboundedFollowing)))
    return rows.filter("not from_top and not from_bottom").select(*found.columns)


def _median(counts: DataFrame, name: str) -> DataFrame:
    """(doc_id, name): the upper median of a histogram (doc_id, v, n)."""
    counts = counts.groupBy("doc_id", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("half", F.floor(F.sum("n").over(Window.partitionBy("doc_id")) / 2))
    return rows.filter("upto > half").groupBy("doc_id").agg(F.min("v").alias(name))


def measures(found: DataFrame) -> DataFrame:
    """(doc_id, body, margin, width, gap) of lines (…, long): size of the body, its left margin, its width, the usual distance of lines. Lines become histograms before they meet the size of the body."""
    count = F.count("*").alias("n")
    sizes = found.groupBy("doc_id", "size", "long", F.round("x0").alias("start")).agg(count)
    body = _median(sizes.filter("long").select("doc_id", (F.round(F.col("size") * 2) / 2).alias("v"), "n"), "body")
    out = staged(sizes.select("doc_id").distinct().join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0))))
    usual = "abs(size - body) < body * 0.15"
    starts = sizes.join(out, "doc_id").filter(usual).groupBy("doc_id", "start").agg(F.sum("n").alias("n"))
    margin = starts.groupBy("doc_id").agg(F.max_by("start", F.struct("n", -F.col("start"))).alias("margin"))
    out = staged(out.join(margin, "doc_id", "left").withColumn("margin", F.coalesce("margin", F.lit(0.0))))
    ends = found.filter("long").groupBy("doc_id", "size", "x1").agg(count)
    width = _median(ends.join(out, "doc_id").filter(usual).select("doc_id", (F.col("x1") - F.col("margin")).alias("v"), "n"), "width")
    step = F.lag("y").over(Window.partitionBy(*LEAF).orderBy("line")) - F.col("y")
    steps = found.select("doc_id", step.alias("v")).filter("v > 0").groupBy("doc_id", "v").agg(count)
    gap = _median(steps.join(out, "doc_id").filter("v < body * 3").select("doc_id", "v", "n"), "gap")
    out = out.join(width, "doc_id", "left").join(gap, "doc_id", "left")
    return out.select("doc_id", "body", "margin", F.coalesce("width", F.lit(400.0)).alias("width"), F.coalesce("gap", F.col("body") * 1.2).alias("gap"))


def paragraphs(found: DataFrame) -> DataFrame:
    """(doc_id, para, text, type, page): lines to paragraphs.

    A heading (larger) or a centred line stands alone, but goes on with one of its kind; a larger gap, an indent, or a
    short line with the end of a sentence before it opens a paragraph. A hyphen before a small letter is joined.
    """
    found = _pages(found.withColumns({"long": F.length("text") > LONG, "closed": F.col("text").rlike(SENTENCE_END)}))
    leaves = staged(found.select(*LEAF).distinct().join(measures(found), "doc_id"))
    heading = F.col("size") >= F.col("body") * HEADING
    left = F.col("x0") - F.col("margin")
    centred = (left > F.col("body") * CENTRED) & (F.abs(left - (F.col("margin") + F.col("width") - F.col("x1"))) < F.col("body") * 3)
    short = (F.col("x1") - F.col("margin") < F.col("width") * SHORT) & F.col("closed")
    state = F.struct("heading", "alone", "short", "page", "y")
    before_page, on_page = Window.partitionBy("doc_id").orderBy("page"), Window.partitionBy(*LEAF).orderBy("line")

    def known(leaves: DataFrame) -> DataFrame:
        """The lines with what is known of their pages; they stay in their buckets."""
        rows = found.join(leaves.drop("doc_id", "page"), "leaf")
        return rows.withColumns({"heading": heading, "alone": heading | centred, "short": short})

    # Page by page: the last line of the page before, then the paragraphs that begin before the page.
    last = known(leaves).groupBy(*LEAF).agg(F.max_by(state, "line").alias("last")).select("leaf", F.lag("last").over(before_page).alias("across"))
    leaves = staged(leaves.join(last, "leaf"))
    opened = lambda leaves: known(leaves).withColumn("before", F.coalesce(F.lag(state).over(on_page), "across")).withColumn("opens", _opens(left))
    sums = opened(leaves).groupBy(*LEAF).agg(F.sum("opens").alias("n")).select("leaf", F.coalesce(F.sum("n").over(before_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = opened(staged(leaves.join(sums, "leaf"))).withColumn("para", F.col("earlier") + F.sum("opens").over(on_page))
    parts = F.array_sort(F.collect_list(F.struct("page", "line", "text", "heading")))
    whole = numbered.groupBy("doc_id", "para").agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p.text), "\n")
    text = F.regexp_replace(F.regexp_replace(joined, HYPHENATED, ""), "\n", " ")
    return whole.select("doc_id", "para", text.alias("text"), F.when(F.get("parts", 0).heading, "h2").otherwise("p").alias("type"), F.get("parts", 0).page.alias("page"))


def _opens(left: Column) -> Column:
    """1 where a line opens a paragraph, 0 where it goes on with the line before."""
    same_page = F.col("before.page") == F.col("page")
    far = same_page & (F.col("before.y") - F.col("y") > F.col("gap") * GAP)
    indent = (left > F.col("body") * INDENT) & ~F.col("alone")
    run = F.col("alone") & F.col("before.alone") & (F.col("heading") == F.col("before.heading")) & ~far
    ends = F.col("alone") | F.col("before.alone") | far | indent | F.col("before.short")
    return F.when(F.col("before").isNull() | (~run & ends), 1).otherwise(0).cast("long")
