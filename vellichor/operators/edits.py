"""Decisions on books as an append-only journal.

A journal row is (book_id, seq, edit, target, value). State is never changed in place: a version is the journal up to a
point, and since every command here sets or removes something by key, the version follows from the last command for
each key, a window over the journal, however long it is. Undo drops a suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Command -> the property of its target that it sets.
PROPERTIES = {"setSpeaker": "speaker", "confirmSpeech": "speaker", "removeAnnotation": "exists", "addMark": "exists", "setNote": "note", "setEmphasisColor": "color", "setCastColor": "color", "updateCast": "name", "setProgress": "progress"}


def property_of(edit: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PROPERTIES.items() for x in pair])[edit]


def version(journal: DataFrame, upto: int | None = None) -> DataFrame:
    """The last value of each (book, target, property)."""
    rows = journal.withColumn("property", property_of(F.col("edit"))).filter("property is not null")
    if upto is not None:
        rows = rows.filter(F.col("seq") <= upto)
    last = F.max_by(F.struct("seq", "edit", "value"), "seq")
    return rows.groupBy("book_id", "target", "property").agg(last.alias("x"), F.count("*").alias("n_edits")).select("book_id", "target", "property", "x.seq", "x.edit", "x.value", "n_edits")


def apply_speakers(spans: DataFrame, journal: DataFrame) -> DataFrame:
    """Spans (book_id, id, speaker, conf, via) with users' decisions: certain, and theirs."""
    said = version(journal).filter("property = 'speaker'").select("book_id", F.col("target").alias("id"), "edit", "value")
    gone = version(journal).filter("property = 'exists' and edit = 'removeAnnotation'").select("book_id", F.col("target").alias("id"))
    rows = spans.join(gone, ["book_id", "id"], "left_anti").join(said, ["book_id", "id"], "left")
    mine = F.col("edit").isNotNull()
    return rows.select("book_id", "id", F.when(F.col("edit") == "setSpeaker", F.col("value")).otherwise(F.col("speaker")).alias("speaker"), F.when(mine, 1.0).otherwise(F.col("conf")).alias("conf"), F.when(mine, "user").otherwise(F.col("via")).alias("via"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What differs between two versions, one row per key and column: also the way back (old)."""
    a = before.select(*keys, F.lit(True).alias("in_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = after.select(*keys, F.lit(True).alias("in_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    both = a.join(b, keys, "full")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in columns]))
    op = F.when(F.col("in_a").isNull(), "add").when(F.col("in_b").isNull(), "remove").otherwise("replace")
    return both.select(*keys, op.alias("op"), cells.alias("x")).select(*keys, "op", "x.column", "x.old", "x.new").filter("not (old <=> new)")


def suggested(rows: DataFrame) -> DataFrame:
    """A model's suggestions (suggested, confidence) against rules (speaker, conf, via): agreement raises, clear cases take over, others are kept for review."""
    rc, lc = F.col("conf"), F.col("confidence")
    user, asked = F.col("via") == "user", F.col("suggested").isNotNull()
    agree = F.col("speaker").eqNullSafe(F.col("suggested"))
    over = (rc < 0.9) & (lc >= rc + 0.15)
    raised = F.least(F.lit(0.97), 1 - (1 - rc) * (1 - lc))
    taken = F.when(lc >= 0.8, F.round(lc * 0.9, 2)).otherwise(F.least(F.lit(0.45), lc))
    decision = F.when(user | ~asked, "kept").when(agree, "confirmed").when(over, "changed").when(lc >= 0.7, "queued").otherwise("noted")
    rows = rows.withColumn("decision", decision)
    return rows.withColumn("new_conf", F.when(F.col("decision") == "confirmed", raised).when(F.col("decision") == "changed", taken).when(F.col("decision") == "queued", F.least(rc, F.lit(0.45))).otherwise(rc)).withColumn("new_speaker", F.when(F.col("decision") == "changed", F.col("suggested")).otherwise(F.col("speaker")))


def opening(stamps: DataFrame) -> DataFrame:
    """What to open: the file, the unsaved state, or ask. stamps: (book_id, dirty, own_sha, file_sha)."""
    same = F.col("own_sha") == F.col("file_sha")
    return stamps.select("book_id", F.when(~F.col("dirty"), "file").when(F.coalesce(same, F.lit(False)), "resume").otherwise("conflict").alias("decision"))


def violations(annotations: DataFrame, blocks: DataFrame, cast: DataFrame) -> DataFrame:
    """(book_id, rule, detail): ids used twice, unknown blocks and figures, ranges out of bounds. annotations: (book_id, id, block_id, s, e, speaker); blocks: (book_id, block_id, n)."""
    twice = lambda rows, c, rule: rows.groupBy("book_id", c).count().filter("count > 1").select("book_id", F.lit(rule).alias("rule"), F.col(c).alias("detail"))
    lost = annotations.join(blocks, ["book_id", "block_id"], "left_anti").select("book_id", F.lit("unknown block").alias("rule"), F.col("id").alias("detail"))
    out = annotations.join(blocks, ["book_id", "block_id"]).filter("s < 0 or e < s or e > n").select("book_id", F.lit("range").alias("rule"), F.col("id").alias("detail"))
    who = annotations.filter("speaker is not null").join(cast.select("book_id", "speaker"), ["book_id", "speaker"], "left_anti").select("book_id", F.lit("unknown speaker").alias("rule"), F.col("id").alias("detail"))
    return twice(blocks, "block_id", "block twice").unionByName(twice(annotations, "id", "annotation twice")).unionByName(lost).unionByName(out).unionByName(who)


def history(journal: DataFrame, most: int = 500) -> DataFrame:
    """The last commands of each book: what can be undone."""
    return journal.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("seq")))).filter(F.col("k") <= most).drop("k")


def swapped(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Slots (book_id, speaker, slot) after one choice a book (book_id, speaker, slot): the former holder gets the chooser's old slot."""
    own = wanted.join(slots.withColumnRenamed("slot", "old"), ["book_id", "speaker"], "left").select("book_id", F.col("speaker").alias("chooser"), F.col("slot").alias("new"), "old")
    rows = slots.join(own, "book_id", "left")
    slot = F.when(F.col("speaker") == F.col("chooser"), F.col("new")).when(F.col("slot") == F.col("new"), F.col("old")).otherwise(F.col("slot"))
    fresh = own.join(slots.select("book_id", F.col("speaker").alias("chooser")), ["book_id", "chooser"], "left_anti").select("book_id", F.col("chooser").alias("speaker"), F.col("new").alias("slot"))
    return rows.select("book_id", "speaker", slot.alias("slot")).unionByName(fresh)


def merged_sentences(spans: Column, at: Column) -> Column:
    """Sentences (array of s, e) with the one that holds offset at joined to the next."""
    k = F.size(F.filter(spans, lambda x: x.e <= at))
    head, tail = F.slice(spans, 1, k), F.slice(spans, k + 3, F.greatest(F.size(spans) - k - 2, F.lit(0)))
    both = F.array(F.struct(F.get(spans, k).s.alias("s"), F.get(spans, k + 1).e.alias("e")))
    return F.when(k + 1 < F.size(spans), F.concat(head, both, tail)).otherwise(spans)


def split_sentences(spans: Column, text: Column, at: Column) -> Column:
    """Sentences with the one around offset at cut there; white space at the cut belongs to neither half; no empty halves."""
    part = lambda a, b: F.substring(text, a.cast("int") + 1, F.greatest((b - a).cast("int"), F.lit(0)))
    left = lambda x: x.s + F.length(F.rtrim(part(x.s, at)))
    right = lambda x: x.e - F.length(F.ltrim(part(at, x.e)))
    halves = lambda x: F.array(F.struct(x.s.alias("s"), left(x).cast("long").alias("e")), F.struct(right(x).cast("long").alias("s"), x.e.alias("e")))
    whole = lambda x: F.array(F.struct(x.s.alias("s"), x.e.alias("e")))
    cut = lambda x: (x.s < at) & (at < x.e) & (left(x) > x.s) & (right(x) < x.e)
    return F.flatten(F.transform(spans, lambda x: F.when(cut(x), halves(x)).otherwise(whole(x))))


def new_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids for new figures (book_id, name): the slug, or with -2, -3 ... where it is taken; a name that exists gets none. taken: (book_id, speaker, name)."""
    from vellichor.functions.text import collapsed, slug

    fresh = names.select("book_id", collapsed(F.col("name")).alias("name")).dropDuplicates(["book_id", "name"]).withColumn("key", F.lower("name"))
    fresh = fresh.join(taken.select("book_id", F.lower("name").alias("key")).distinct(), ["book_id", "key"], "left_anti").withColumn("stem", slug(F.col("name")))
    held = taken.select("book_id", F.regexp_replace("speaker", r"-\d+$", "").alias("stem"), F.coalesce(F.regexp_extract("speaker", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("k")).groupBy("book_id", "stem").agg(F.max("k").alias("held"))
    k = F.coalesce("held", F.lit(0)) + F.row_number().over(Window.partitionBy("book_id", "stem").orderBy("name"))
    return fresh.join(held, ["book_id", "stem"], "left").withColumn("k", k).select("book_id", "name", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), "k")).alias("speaker"))


def outcomes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a model's run did per book: (book_id, review, changed, confirmed). Both: (book_id, id, speaker, conf)."""
    a, b = before.alias("a"), after.alias("b")
    rows = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.id") == F.col("b.id")))
    same = F.col("a.speaker").eqNullSafe(F.col("b.speaker"))
    low = F.col("b.speaker").isNull() | (F.col("b.conf") < 0.5)
    return rows.groupBy(F.col("a.book_id").alias("book_id")).agg(F.count_if(low).alias("review"), F.count_if(~low & ~same).alias("changed"), F.count_if(~low & same & (F.col("b.conf") > F.col("a.conf"))).alias("confirmed"))
