"""Commands on a book's annotations and cast, each a set operation on tables by key: any number of books and commands at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.selection import trimmed
from vellichor.functions.text import collapsed, initials
from vellichor.operators.stats import needs_review

PENS = 5
SLOTS = 12
#: Command -> what a user reads in the history.
LABELS = {"setSpeaker": "speaker", "confirmSpeech": "confirm", "addSpeech": "new speech", "splitSpeech": "split speech", "removeAnnotation": "remove", "addMark": "mark", "setNote": "note", "setInk": "ink", "setEmphasisColor": "pen", "setEmphasisLabel": "meaning of a pen", "mergeSentences": "join sentences", "splitSentence": "split sentence", "addCast": "new figure", "updateCast": "figure", "setCastColor": "colour", "mergeCast": "merge figures", "setProgress": "position"}


def label(edit: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[edit], edit)


def without_overlaps(spans: DataFrame, new: DataFrame) -> DataFrame:
    """Spans that overlap no new one of their block. Both: (book_id, block_ord, s, e)."""
    other = new.select(F.col("book_id").alias("b"), F.col("block_ord").alias("o"), F.col("s").alias("ns"), F.col("e").alias("ne"))
    return spans.join(other, (F.col("book_id") == F.col("b")) & (F.col("block_ord") == F.col("o")) & (F.col("s") < F.col("ne")) & (F.col("e") > F.col("ns")), "left_anti")


def add_speech(spans: DataFrame, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans after new speech (book_id, block_ord, s, e, speaker): ranges trimmed, blank ones left out, overlapped spans replaced; new ones are the user's."""
    rows = wanted.join(blocks.select("book_id", "block_ord", "text"), ["book_id", "block_ord"])
    rows = rows.withColumn("r", trimmed(F.col("text"), F.col("s"), F.col("e"))).filter("r.s < r.e").select("book_id", "block_ord", "r.s", "r.e", "speaker", F.lit(1.0).alias("conf"), F.lit("user").alias("origin"))
    return without_overlaps(spans, rows).select("book_id", "block_ord", "s", "e", "speaker", "conf", "origin").unionByName(rows)


def split_speech(spans: DataFrame, cuts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans after cuts (book_id, block_ord, s, at, speaker): both halves trimmed, the right one the user's; a cut that leaves an empty half does nothing."""
    keys = ["book_id", "block_ord", "s"]
    rows = spans.join(cuts.select(*keys, "at", F.col("speaker").alias("right_speaker")), keys, "left").join(blocks.select("book_id", "block_ord", "text"), ["book_id", "block_ord"])
    rows = rows.withColumn("l", trimmed(F.col("text"), F.col("s"), F.col("at"))).withColumn("r", trimmed(F.col("text"), F.col("at"), F.col("e")))
    good = F.col("at").isNotNull() & (F.col("l.e") > F.col("s")) & (F.col("r.s") < F.col("e"))
    whole = F.struct(F.col("s"), F.col("e"), F.col("speaker"), F.col("conf"), F.col("origin"))
    left = F.struct(F.col("s"), F.col("l.e").alias("e"), F.col("speaker"), F.col("conf"), F.col("origin"))
    right = F.struct(F.col("r.s").alias("s"), F.col("e"), F.col("right_speaker").alias("speaker"), F.lit(1.0).alias("conf"), F.lit("user").alias("origin"))
    return rows.select("book_id", "block_ord", F.explode(F.when(good, F.array(left, right)).otherwise(F.array(whole))).alias("x")).select("book_id", "block_ord", "x.*")


def pen(color: Column) -> Column:
    """A valid pen, else null: plain."""
    return F.when(color.between(0, PENS - 1) & (color == F.floor(color)), color.cast("int"))


def add_emphasis(marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Emphasis after new strokes (book_id, block_ord, s, e, color, seq): the same range is coloured anew, not stacked; the last stroke counts."""
    keys = ["book_id", "block_ord", "s", "e"]
    last = wanted.groupBy(*keys).agg(F.max_by(F.struct(pen(F.col("color")).alias("color")), "seq").alias("x")).select(*keys, F.col("x.color").alias("new"), F.lit(True).alias("fresh"))
    rows = marks.select(*keys, F.col("color").cast("int").alias("color")).join(last, keys, "full")
    return rows.select(*keys, F.when(F.col("fresh"), F.col("new")).otherwise(F.col("color")).alias("color"), F.coalesce("fresh", F.lit(False)).alias("by_user"))


def emphasis_labels(labels: Column, color: Column, text: Column) -> Column:
    """The pens' meanings with one set anew: collapsed, 40 characters at most, no empty ones at the end."""
    filled = F.concat(labels, F.array_repeat(F.lit(""), F.greatest(color + 1 - F.size(labels), F.lit(0))))
    new = F.transform(filled, lambda x, i: F.when(i == color, F.substring(collapsed(text), 1, 40)).otherwise(x))
    keep = F.size(new) - F.coalesce(F.array_position(F.transform(F.reverse(new), lambda x: x != ""), F.lit(True)).cast("int"), F.lit(0)) + 1
    return F.when(F.exists(new, lambda x: x != ""), F.slice(new, 1, keep)).otherwise(F.slice(new, 1, 0))


def annotated(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes and retakes with their texts set (book_id, id, value, seq): (…, note, outcome); other kinds refuse."""
    last = notes.groupBy("book_id", "id").agg(F.max_by("value", "seq").alias("value"))
    rows = annotations.join(last, ["book_id", "id"], "left")
    allowed = F.col("kind").isin("note", "retake")
    outcome = F.when(F.col("value").isNull(), "kept").when(allowed, "set").otherwise("refused")
    return rows.select("book_id", "id", "kind", F.when(allowed, F.coalesce("value", "note")).otherwise(F.col("note")).alias("note"), outcome.alias("outcome"))


def update_cast(cast: DataFrame, changes: DataFrame) -> DataFrame:
    """Figures after changes (book_id, speaker, new_name, new_badge): a badge follows the name only if it was the name's; an empty badge is the name's."""
    rows = cast.join(changes, ["book_id", "speaker"], "left")
    clean = collapsed(F.col("new_name"))
    name = F.when(F.length(clean) > 0, clean).otherwise(F.col("name"))
    own = F.substring(F.trim("new_badge"), 1, 3)
    badge = F.when(F.col("new_badge").isNotNull(), F.when(F.length(own) > 0, own).otherwise(initials(name))).when(F.col("badge") == initials(F.col("name")), initials(name)).otherwise(F.col("badge"))
    touched = F.col("new_name").isNotNull() | F.col("new_badge").isNotNull()
    return rows.select("book_id", "speaker", name.alias("name"), badge.alias("badge"), F.when(touched, "user").otherwise(F.col("origin")).alias("origin"))


def merge_cast(cast: DataFrame, merges: DataFrame) -> DataFrame:
    """Figures after merges (book_id, from_id, into_id): aliases are united without the own name, colour and note inherited where there is none. A figure that is a target is not merged away itself (resolve chains first). cast: (book_id, speaker, name, aliases, color, note)."""
    lost = merges.filter("from_id <> into_id").join(cast.select("book_id", F.col("speaker").alias("from_id"), F.concat(F.array("name"), "aliases").alias("more"), F.col("color").alias("c"), F.col("note").alias("n")), ["book_id", "from_id"])
    given = lost.groupBy("book_id", F.col("into_id").alias("speaker")).agg(F.flatten(F.array_sort(F.collect_list("more"))).alias("more"), F.min("c").alias("c"), F.min(F.when(F.col("n") != "", F.col("n"))).alias("n"))
    rows = cast.join(lost.select("book_id", F.col("from_id").alias("speaker")), ["book_id", "speaker"], "left_anti").join(given, ["book_id", "speaker"], "left")
    aliases = F.array_sort(F.array_remove(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))), F.col("name")))
    return rows.select("book_id", "speaker", "name", aliases.alias("aliases"), F.coalesce("color", "c").alias("color"), F.when(F.col("note") == "", F.coalesce("n", F.lit(""))).otherwise(F.col("note")).alias("note"))


def repointed(spans: DataFrame, merges: DataFrame) -> DataFrame:
    """Spans with merged figures replaced."""
    return spans.join(merges.select("book_id", F.col("from_id").alias("speaker"), "into_id"), ["book_id", "speaker"], "left").withColumn("speaker", F.coalesce("into_id", "speaker")).drop("into_id")


def pronunciations(terms: DataFrame, suggested: DataFrame) -> DataFrame:
    """Terms (book_id, term, hint, ipa, origin, verified) after a model's suggestions (book_id, term, new_hint, new_ipa): what a user wrote or verified stays, blank hints do nothing."""
    rows = terms.join(suggested, ["book_id", "term"], "left")
    take = (F.col("origin") != "user") & ~F.col("verified") & (F.length(F.trim(F.coalesce("new_hint", F.lit("")))) > 0)
    ipa = F.when(take & (F.length(F.trim(F.coalesce("new_ipa", F.lit("")))) > 0), F.trim("new_ipa")).otherwise(F.col("ipa"))
    return rows.select("book_id", "term", F.when(take, F.trim("new_hint")).otherwise(F.col("hint")).alias("hint"), ipa.alias("ipa"), F.when(take, "llm").otherwise(F.col("origin")).alias("origin"), "verified")


def normal_colors(lines: DataFrame, slots: DataFrame, old: DataFrame) -> DataFrame:
    """Chapter slots after an edit: (book_id, chapter_ord, speaker, slot).

    Figures without a slot in the whole book keep their old chapter slot unless one of the book's slots, or a figure
    before them in the chapter, has it; the others get the lowest free slots in order, null when none is left.
    lines: (book_id, chapter_ord, speaker, first); slots: (book_id, speaker, slot); old: (book_id, chapter_ord, speaker, slot)."""
    keys = ["book_id", "chapter_ord"]
    present = lines.join(slots.withColumnRenamed("slot", "fixed"), ["book_id", "speaker"], "left").join(old.withColumnRenamed("slot", "held"), [*keys, "speaker"], "left")
    whole = Window.partitionBy(*keys)
    present = present.withColumn("taken", F.collect_set("fixed").over(whole)).filter("fixed is null")
    free = ~F.array_contains("taken", F.col("held"))
    present = present.withColumn("claim", F.when(free, F.col("held")))
    first = F.row_number().over(Window.partitionBy(*keys, "claim").orderBy("first", "speaker")) == 1
    present = present.withColumn("kept", F.when(F.col("claim").isNotNull() & first, F.col("claim")))
    present = present.withColumn("used", F.array_union("taken", F.collect_set("kept").over(whole)))
    turn = F.row_number().over(Window.partitionBy(*keys, F.col("kept").isNull()).orderBy("first", "speaker"))
    open_ = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda x: ~F.array_contains("used", x))
    present = present.withColumn("turn", turn)
    return present.select(*keys, "speaker", F.coalesce(F.col("kept").cast("int"), F.get(open_, F.col("turn") - 1)).alias("slot"))


def since_saved(journal: DataFrame, saved: DataFrame) -> DataFrame:
    """Commands since each book was last saved (book_id, saved_seq), where they have no gap: else the book has none. (book_id, seq, edit)."""
    rows = journal.join(saved, "book_id").filter("seq > saved_seq")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).withColumn("last", F.max("seq").over(Window.partitionBy("book_id")))
    return rows.filter("last - saved_seq = n").select("book_id", "seq", "edit")


def positions(journal: DataFrame) -> DataFrame:
    """Last position of each book; it is no step of the history."""
    return journal.filter("edit = 'setProgress'").groupBy("book_id").agg(F.max_by("value", "seq").alias("position"))


def unsure(spans: DataFrame) -> DataFrame:
    return spans.filter(needs_review())
