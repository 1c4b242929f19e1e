"""Work for a language model as tables: what is asked, prompts, answers, costs. The call itself is an injected transport."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import clipped, confidence, is_local_url

SURE = 0.9
APPLY_MERGE, PRESELECT_MERGE = 0.85, 0.8
EXPECTED_LEAST, EXPECTED_SHARE = 1500, 0.6
FIGURES, SAMPLES = 150, 2


def is_asked(recheck: bool = False, include_sure: bool = False) -> Column:
    """Spans (origin, suggested_by, speaker, conf) that a model is asked about: never a user's, unless recheck none it has judged, unless include_sure none that is sure."""
    judged = F.lit(recheck) | (~F.col("origin").eqNullSafe("llm") & ~F.col("suggested_by").eqNullSafe("llm"))
    return ~F.col("origin").eqNullSafe("user") & judged & (F.lit(include_sure) | F.col("speaker").isNull() | (F.col("conf") < SURE))


def asked_passages(spans: DataFrame, recheck: bool = False, include_sure: bool = False) -> DataFrame:
    """The asked spans, numbered R1, R2 ... in each chapter: (…, passage)."""
    order = Window.partitionBy("book_id", "chapter_ord").orderBy("block_ord", "s")
    return spans.filter(is_asked(recheck, include_sure)).withColumn("passage", F.concat(F.lit("R"), F.row_number().over(order)))


def count_asked(spans: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(book_id, asked): how many spans would be asked, in the chapters (book_id, chapter_ord) if given."""
    rows = spans.filter(is_asked())
    if chapters is not None:
        rows = rows.join(chapters, ["book_id", "chapter_ord"], "left_semi")
    return rows.groupBy("book_id").agg(F.count("*").alias("asked"))


def prompts(blocks: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, chapter_ord, chunk, passages, prompt): blocks with asked spans marked as [Rn: …] and settled ones as [name: …], in reading order.

    spans: (…, block_ord, s, e, passage, speaker); chunks: (book_id, block_ord, chunk)."""
    keys = ["book_id", "block_ord"]
    edge = lambda at, ord_, text: F.struct(F.col(at).cast("long").alias("at"), F.lit(ord_).alias("ord"), text.alias("text"))
    opened = F.concat(F.lit("["), F.coalesce("passage", "speaker", F.lit("?")), F.lit(": "))
    marks = spans.select(*keys, "passage", F.explode(F.array(edge("s", 1, opened), edge("e", 0, F.lit("]")))).alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("marks"), F.count_distinct("passage").alias("n"))
    rows = blocks.join(marks, keys, "left").join(chunks.select(*keys, "chunk"), keys)
    points = F.concat(F.coalesce("marks", F.array().cast("array<struct<at:long,ord:int,text:string>>")), F.array(F.struct(F.length("text").cast("long").alias("at"), F.lit(2).alias("ord"), F.lit("").alias("text"))))
    rows = rows.withColumn("points", points)
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("points", i - 1).at)
    marked = F.array_join(F.transform("points", lambda p, i: F.concat(F.substr("text", (before(i) + 1).cast("int"), F.greatest(p.at - before(i), F.lit(0)).cast("int")), p.text)), "")
    lines = F.array_sort(F.collect_list(F.struct("block_ord", marked.alias("line"))))
    return rows.groupBy("book_id", "chapter_ord", "chunk").agg(F.sum(F.coalesce("n", F.lit(0))).alias("passages"), F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("prompt"))


def extracted_json(answer: Column) -> Column:
    """A variant from a model's answer: the whole of it, a fenced block, or what is between its outermost braces; null if none parses."""
    text = F.trim(answer)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    inner = F.when(text.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(braces)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.trim(inner)))


def safe(value: Column, path: str, kind: str, fallback: object = None) -> Column:
    """A field of a variant as a type, or the fallback."""
    return F.coalesce(F.try_variant_get(value, path, kind), F.lit(fallback))


def judgements(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(book_id, chapter_ord, passage, speaker, confidence): the first judgement of each asked passage; unknown passages and repeats are dropped. answers: (book_id, chapter_ord, answer)."""
    items = answers.select("book_id", "chapter_ord", F.expr("try_variant_get(a, '$.items', 'array<variant>')").alias("items")) if "a" in answers.columns else answers.withColumn("a", extracted_json(F.col("answer"))).select("book_id", "chapter_ord", F.expr("try_variant_get(a, '$.items', 'array<variant>')").alias("items"))
    rows = items.select("book_id", "chapter_ord", F.posexplode("items").alias("k", "x"))
    rows = rows.select("book_id", "chapter_ord", "k", F.trim(safe(F.col("x"), "$.id", "string", "")).alias("passage"), F.nullif(F.trim(safe(F.col("x"), "$.speaker", "string", "")), F.lit("")).alias("speaker"), confidence(safe(F.col("x"), "$.confidence", "double", 0.5)).alias("confidence"))
    keys = ["book_id", "chapter_ord", "passage"]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("speaker", "confidence"), "k").alias("x"))
    return first.join(asked.select(*keys), keys, "left_semi").select(*keys, "x.speaker", "x.confidence")


def merge_suggestions(items: DataFrame, figures: DataFrame) -> DataFrame:
    """Suggested merges that can be: (book_id, from_id, into_id, confidence, apply, preselect); of several for one figure the first. items: (book_id, k, from_id, into_id, confidence)."""
    known = figures.select("book_id", F.col("speaker").alias("id"))
    rows = items.filter("from_id <> into_id").join(known.withColumnRenamed("id", "from_id"), ["book_id", "from_id"], "left_semi").join(known.withColumnRenamed("id", "into_id"), ["book_id", "into_id"], "left_semi")
    first = rows.groupBy("book_id", "from_id").agg(F.min_by(F.struct("into_id", "confidence"), "k").alias("x"))
    c = confidence(F.col("x.confidence"))
    return first.select("book_id", "from_id", "x.into_id", c.alias("confidence"), (c >= APPLY_MERGE).alias("apply"), (c >= PRESELECT_MERGE).alias("preselect"))


def figure_cards(cast: DataFrame, spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a model is told of each figure: (book_id, speaker, name, lines, where, samples). The FIGURES with most lines of a book; samples are the first SAMPLES utterances.

    A figure's chapters are counted before they are gathered, and only SAMPLES utterances of each are kept."""
    keys = ["book_id", "speaker"]
    spoken = spans.filter("speaker is not null")
    lines = spoken.groupBy(*keys, "chapter_ord").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("lines"), F.array_sort(F.collect_list(F.col("chapter_ord") + 1)).alias("chapters"))
    order = Window.partitionBy(*keys).orderBy("chapter_ord", "block_ord", "s")
    few = spoken.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLES).join(blocks.select("book_id", "block_ord", "text"), ["book_id", "block_ord"])
    said = clipped(F.substr("text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")), 110)
    samples = few.select(*keys, "k", said.alias("said")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x.said), " | ").alias("samples"))
    rows = cast.join(lines, keys, "left").join(samples, keys, "left").withColumn("lines", F.coalesce(F.col("lines"), F.lit(0)))
    many = F.concat(F.element_at("chapters", 1).cast("string"), F.lit("–"), F.element_at("chapters", -1).cast("string"))
    where = F.when(F.col("chapters").isNull(), "").when(F.size("chapters") > 4, many).otherwise(F.array_join(F.transform("chapters", lambda x: x.cast("string")), ", "))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("lines"), "speaker"))
    return rows.withColumn("place", place).filter(F.col("place") <= FIGURES).select(*keys, "name", "lines", where.alias("where"), F.coalesce("samples", F.lit("")).alias("samples"))


def estimated_seconds(jobs: DataFrame, prompt_tps: float, output_tps: float, per: str = "book_id") -> DataFrame:
    """(per, seconds) of jobs (per, input, output) in tokens."""
    return jobs.groupBy(per).agg((F.sum("input") / prompt_tps + F.sum("output") / output_tps).alias("seconds"))


def eta(jobs: DataFrame, per: str = "book_id") -> DataFrame:
    """(per, done_share): work done by weight, a token written counting as five read. jobs: (per, input, output, done)."""
    weight = F.col("input") + 5 * F.col("output")
    return jobs.groupBy(per).agg(F.round(F.try_divide(F.sum(F.when(F.col("done"), weight).otherwise(0)), F.sum(weight)), 4).alias("done_share"))


def truncated(chars: Column, used: Column) -> Column:
    """Whether a server read only part of a prompt: far fewer tokens than its characters make."""
    expected = F.ceil(chars / 3)
    return (used > 0) & (expected > EXPECTED_LEAST) & (used < expected * EXPECTED_SHARE)


def allowed(url: Column, allow_cloud: Column) -> Column:
    """Whether a request may leave: to local hosts always, to others only where that is allowed."""
    return F.coalesce(allow_cloud, F.lit(False)) | is_local_url(url)


def run_summary(calls: DataFrame, price_in: float, price_out: float, per: str = "book_id") -> DataFrame:
    """(per, done, failed, skipped, input, output, cost) of calls (per, state, input, output); prices for a million tokens."""
    n = lambda state: F.count_if(F.col("state") == state).alias(state)
    used = lambda c: F.coalesce(F.sum(F.when(F.col("state") == "done", F.col(c))), F.lit(0)).alias(c)
    rows = calls.groupBy(per).agg(n("done"), n("failed"), n("skipped"), used("input"), used("output"))
    return rows.withColumn("cost", F.round((F.col("input") * price_in + F.col("output") * price_out) / 1e6, 8))


def open_terms(terms: DataFrame, recheck: bool = False) -> DataFrame:
    """Terms that still need a suggestion, by how often they occur: (…, place). terms: (book_id, term, n, hint, origin, verified)."""
    fresh = F.lit(recheck) | ((F.col("hint") == "") & (F.col("origin") != "llm"))
    order = Window.partitionBy("book_id").orderBy(F.desc("n"), "term")
    return terms.filter(~F.col("verified") & (F.col("origin") != "user") & fresh).select("book_id", "term", "n", F.row_number().over(order).cast("long").alias("place"))


def scripted_transport(answers: dict[str, str], otherwise: str = "{}"):
    """A transport for tests without a model: the answer of the first pattern that a prompt matches."""
    compiled = [(re.compile(k), v) for k, v in answers.items()]
    return lambda prompt: next((v for k, v in compiled if k.search(prompt)), otherwise)
