"""One's own commands on another version of a book, when both went on from a common one.

A command refers to annotations and figures by ids, some of which earlier commands of the journal created. There the
other version may hold the same mark or figure under another id, or the id may be taken, so each created id gets the id
it has on the other version, and later commands are rewritten. What refers to something the other version lacks is
skipped, and so is all that refers to what it would have created: skipped commands spread along creations round by
round, each of which joins only the commands that the last one found.

journal: (book_id, seq, edit, target, figure, value, created, type, block_ord, s, e). Annotations: (book_id, id, type,
block_ord, s, e, value) of the other version, value being a note's text or a pen; cast: (book_id, speaker, name);
current: (book_id, target, property, value) on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellichor.operators.edits import property_of
from vellichor.session import staged

# Commands that name an annotation, that name a figure, and that create one or the other.
ON_ANNOTATIONS = ["setSpeaker", "confirmSpeech", "splitSpeech", "removeAnnotation", "setNote", "setInk", "setEmphasisColor"]
ON_FIGURES = ["updateCast", "setCastColor", "mergeCast"]
NEW_ANNOTATIONS, NEW_FIGURES = ["addSpeech", "splitSpeech", "addMark"], ["addCast"]
ANNOTATION, FIGURE = "annotation", "figure"
PLACE = ["type", "block_ord", "s", "e", "value"]


def references(journal: DataFrame) -> DataFrame:
    """(book_id, seq, kind, id, must): the ids that each command names; to remove what is gone is no mistake."""
    kind = F.when(F.col("edit").isin(ON_ANNOTATIONS), ANNOTATION).when(F.col("edit").isin(ON_FIGURES), FIGURE)
    named = F.array(F.struct(kind.alias("kind"), F.col("target").alias("id")), F.struct(F.lit(FIGURE).alias("kind"), F.col("figure").alias("id")))
    rows = journal.select("book_id", "seq", (F.col("edit") != "removeAnnotation").alias("must"), F.inline(named))
    return rows.filter("kind is not null and id is not null").distinct()


def creations(journal: DataFrame) -> DataFrame:
    """(book_id, kind, id, maker): the command that created each id."""
    kind = F.when(F.col("edit").isin(NEW_ANNOTATIONS), ANNOTATION).when(F.col("edit").isin(NEW_FIGURES), FIGURE)
    return journal.filter("created is not null").select("book_id", kind.alias("kind"), F.col("created").alias("id"), "seq").filter("kind is not null").groupBy("book_id", "kind", "id").agg(F.min("seq").alias("maker"))


def skipped(journal: DataFrame, there: DataFrame) -> DataFrame:
    """(book_id, seq, reason): commands that name what is neither there (book_id, kind, id) nor created by a command before them that is not skipped; reason is the kind, annotation before figure."""
    rows = references(journal).filter("must").join(there.withColumn("known", F.lit(True)), ["book_id", "kind", "id"], "left").filter("known is null").drop("known", "must")
    rows = staged(rows.join(creations(journal), ["book_id", "kind", "id"], "left"))
    made = rows.filter("maker < seq")
    lacking = rows.filter("maker is null or maker >= seq").select("book_id", "seq", "kind")
    by = lambda makers: made.join(makers.select("book_id", F.col("seq").alias("maker")), ["book_id", "maker"]).select("book_id", "seq", "kind")
    last = out = staged(lacking.select("book_id", "seq").distinct())
    while not last.isEmpty():
        last = staged(by(last).select("book_id", "seq").distinct().join(out, ["book_id", "seq"], "left_anti"))
        out = out.unionByName(last)
    return lacking.unionByName(by(out)).groupBy("book_id", "seq").agg(F.min("kind").alias("reason"))


def _same(made: DataFrame, there: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """made (book_id, seq, id, *keys) with `same`, the id of what stands for it, and `fresh` if that is its own: nothing with equal keys is there, or what was there or made has been removed (book_id, seq, *keys) since."""
    columns = ["book_id", "seq", "step", "id", *keys]
    events = there.withColumn("seq", F.lit(-1).cast("long")).withColumn("step", F.lit("there")).select(*columns).unionByName(made.withColumn("step", F.lit("made")).select(*columns))
    if removed is not None:
        events = events.unionByName(removed.withColumn("step", F.lit("removed")).withColumn("id", F.lit(None).cast("string")).select(*columns))
    along = Window.partitionBy("book_id", *keys).orderBy("seq", "id")
    before = F.lag("step").over(along)
    events = events.withColumn("fresh", (F.col("step") != "removed") & (before.isNull() | (before == "removed")))
    events = events.withColumn("same", F.last(F.when(F.col("fresh"), F.col("id")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return events.filter("step = 'made'").drop("step")


def id_map(journal: DataFrame, annotations: DataFrame, cast: DataFrame, gone: DataFrame) -> DataFrame:
    """(book_id, kind, id, now, fresh): the id on the other version of what each command created; fresh if it is new there. A taken id goes on with the command's number."""
    live = journal.join(gone.select("book_id", "seq"), ["book_id", "seq"], "left_anti").filter("created is not null").withColumnRenamed("created", "id")
    added = live.filter("edit = 'addMark'").select("book_id", "seq", "id", *PLACE)
    removals = journal.filter("edit = 'removeAnnotation'").select("book_id", "seq", F.col("target").alias("id"))
    known = annotations.select("book_id", "id", *PLACE).unionByName(added.select("book_id", "id", *PLACE))
    marks = _same(added, annotations, PLACE, removals.join(known, ["book_id", "id"]).drop("id"))
    names = live.filter(F.col("edit").isin(NEW_FIGURES)).select("book_id", "seq", "id", F.lower("value").alias("name"))
    figures = _same(names, cast.select("book_id", F.col("speaker").alias("id"), F.lower("name").alias("name")), ["name"])
    parts = live.filter(F.col("edit").isin("addSpeech", "splitSpeech")).select("book_id", "seq", "id", F.lit(True).alias("fresh"), F.col("id").alias("same"))
    kinds = [(marks, ANNOTATION), (figures, FIGURE), (parts, ANNOTATION)]
    rows = kinds[0][0].select("book_id", F.lit(ANNOTATION).alias("kind"), "seq", "id", "fresh", "same")
    for found, kind in kinds[1:]:
        rows = rows.unionByName(found.select("book_id", F.lit(kind).alias("kind"), "seq", "id", "fresh", "same"))
    taken = annotations.select("book_id", F.lit(ANNOTATION).alias("kind"), "id").unionByName(cast.select("book_id", F.lit(FIGURE).alias("kind"), F.col("speaker").alias("id"))).distinct()
    own = rows.filter("fresh").join(taken.withColumn("taken", F.lit(True)), ["book_id", "kind", "id"], "left")
    own = own.select("book_id", "kind", F.col("id").alias("same"), F.when(F.col("taken"), F.concat("id", F.lit("-"), F.col("seq").cast("string"))).otherwise(F.col("id")).alias("now"))
    return rows.join(own, ["book_id", "kind", "same"], "left").select("book_id", "kind", "id", F.coalesce("now", "same").alias("now"), "fresh")


def rebased(journal: DataFrame, annotations: DataFrame, cast: DataFrame, current: DataFrame) -> DataFrame:
    """(book_id, seq, edit, target, figure, created, outcome, reason) of every command: ids as they are on the other version; applied, unchanged (already so there), or skipped for want of an annotation or figure.

    One's own value wins over the other version's. A mark that is there or that an earlier command made is not made
    again, nor a figure of the same name; what is removed there, or by an earlier command, stays removed.
    """
    there = staged(annotations.select("book_id", F.lit(ANNOTATION).alias("kind"), "id").unionByName(cast.select("book_id", F.lit(FIGURE).alias("kind"), F.col("speaker").alias("id"))).distinct())
    gone = staged(skipped(journal, there))
    ids = staged(id_map(journal, annotations, cast, gone))
    kind = F.when(F.col("edit").isin(ON_FIGURES), FIGURE).otherwise(ANNOTATION)
    rows = journal.join(gone, ["book_id", "seq"], "left").withColumn("kind", kind)
    mapped = lambda c, k: ids.filter(F.col("kind") == k).select("book_id", F.col("id").alias(c), F.col("now").alias(f"{c}_now"))
    rows = rows.join(ids.select("book_id", "kind", F.col("id").alias("target"), F.col("now").alias("target_now")), ["book_id", "kind", "target"], "left").join(mapped("figure", FIGURE), ["book_id", "figure"], "left")
    made = ids.select("book_id", F.col("kind").alias("made_kind"), F.col("id").alias("created"), F.col("now").alias("created_now"), "fresh")
    made_kind = F.when(F.col("edit").isin(NEW_FIGURES), FIGURE).otherwise(ANNOTATION)
    rows = rows.withColumn("made_kind", made_kind).join(made, ["book_id", "made_kind", "created"], "left")
    rows = rows.withColumns({"target": F.coalesce("target_now", "target"), "figure": F.coalesce("figure_now", "figure"), "property": property_of(F.col("edit"))})
    rows = rows.withColumn("set", F.coalesce("figure", "value"))

    live = F.col("reason").isNull()
    values = live & F.col("property").isNotNull() & F.col("created").isNull() & (F.col("edit") != "removeAnnotation")
    key = Window.partitionBy("book_id", "target", "property", values).orderBy("seq")
    rows = rows.join(current.select("book_id", "target", "property", F.col("value").alias("held")), ["book_id", "target", "property"], "left")
    held = F.when(F.row_number().over(key) == 1, F.col("held")).otherwise(F.lag("set").over(key))
    rows = rows.join(there.filter(F.col("kind") == ANNOTATION).select("book_id", F.col("id").alias("target"), F.lit(True).alias("stands")), ["book_id", "target"], "left")
    removal = F.col("edit") == "removeAnnotation"
    again = F.row_number().over(Window.partitionBy("book_id", "target", removal).orderBy("seq")) > 1
    new_here = F.col("target_now").isNotNull()
    same = F.when(removal, again | ~(F.coalesce("stands", F.lit(False)) | new_here)).when(values, F.col("set").eqNullSafe(held)).when(F.col("created").isNotNull(), ~F.coalesce("fresh", F.lit(True))).otherwise(False)
    outcome = F.when(~live, "skipped").when(same, "unchanged").otherwise("applied")
    return rows.select("book_id", "seq", "edit", "target", "figure", F.when(live, F.col("created_now")).alias("created"), outcome.alias("outcome"), "reason")
