"""Undo and redo over a journal, without replaying it.

A journal row is (book_id, seq, action, edit, target, value): action is edit, undo or redo; undo and redo name no target.
Only actions that had an effect are recorded, so the number of commands that hold is a running balance, edit and redo +1,
undo -1, and an undo belongs to its command as a closing bracket to the opening one: it has the command's level, and the
command is the last one edited at that level. A redo restores the last command of its level; a new edit ends what can
be redone, since it takes that level over.

The same brackets for each (target, property) tell which command's value holds after every action, so the history of a
value is a table of validity intervals, any version is an as-of selection from it, and the differences of neighbouring
values are a table of changes that leads from any version to any other, both ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellichor.operators.edits import property_of
from vellichor.operators.ordered import running
from vellichor.session import staged

BOOK, MODIFIED = "book", "modifiedAt"  # target and property of the time of a book's last change
KEY = ["book_id", "target", "property"]


def timeline(journal: DataFrame) -> DataFrame:
    """journal with depth (commands that hold after the action), undone (that can be redone), level and entry (the seq of the command it is about).

    A journal is taken up to its first undo or redo of nothing, which a session does not record; see without_effect.
    """
    rows = _balanced(journal)
    first = rows.filter("depth < 0 or undone < 0").groupBy("book_id").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "book_id", "left").filter("first is null or seq < first").drop("first")
    rows = rows.withColumn("level", F.col("depth") + (F.col("action") == "undo").cast("int"))
    latest = F.last(F.when(F.col("action") == "edit", F.col("seq")), ignorenulls=True)
    return rows.withColumn("entry", latest.over(Window.partitionBy("book_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def without_effect(journal: DataFrame) -> DataFrame:
    """(book_id, seq): of each journal the first undo or redo of nothing."""
    return _balanced(journal).filter("depth < 0 or undone < 0").groupBy("book_id").agg(F.min("seq").alias("seq"))


def _balanced(journal: DataFrame) -> DataFrame:
    step = F.when(F.col("action") == "undo", 1).when(F.col("action") == "redo", -1).otherwise(0).cast("long")
    rows = journal.withColumn("back", step).withColumn("new", (F.col("action") == "edit").cast("long"))
    rows = running(rows, "book_id", "seq", {"edits": "new", "taken": "back"})
    # Since the last edit; before the first there is nothing to redo.
    since = F.first("taken").over(Window.partitionBy("book_id", "edits").orderBy("seq"))
    rows = rows.withColumn("undone", F.when(F.col("edits") == 0, F.col("taken")).otherwise(F.col("taken") - since))
    return rows.withColumn("depth", F.col("edits") - F.col("taken")).drop("back", "new", "edits", "taken")


def changes(journal: DataFrame) -> DataFrame:
    """(book_id, target, property, seq, action, entry, old, new): what each action of the journal changed.

    A command changes its target, and the time of the book's last change (ts, if the journal has it).
    """
    rows = staged(timeline(journal))
    commands = rows.filter("action = 'edit'").withColumn("property", property_of(F.col("edit")))
    columns = [F.col("book_id"), F.col("seq").alias("entry")]
    named = commands.select(*columns, "target", "property", F.col("value").cast("string").alias("value")).filter("property is not null")
    if "ts" in journal.columns:
        named = named.unionByName(commands.select(*columns, F.lit(BOOK).alias("target"), F.lit(MODIFIED).alias("property"), F.col("ts").cast("string").alias("value")))
    steps = rows.select("book_id", "seq", "action", "entry").join(named, ["book_id", "entry"])
    along = Window.partitionBy(*KEY).orderBy("seq")
    # A key's own brackets: after an action the value is that of the last command begun at the key's depth.
    steps = steps.withColumn("height", F.sum(F.when(F.col("action") == "undo", -1).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.when(F.col("action") != "undo", F.struct("value"))
    at_height = Window.partitionBy(*KEY, "height").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("new", F.when(F.col("height") > 0, F.last(begun, ignorenulls=True).over(at_height).value))
    return steps.select(*KEY, "seq", "action", "entry", F.lag("new").over(along).alias("old"), "new")


def intervals(changed: DataFrame) -> DataFrame:
    """(book_id, target, property, value, since, until): which value held when; until is null for the present one, a value that nobody set is null."""
    return changed.select(*KEY, F.col("new").alias("value"), F.col("seq").alias("since"), F.lead("seq").over(Window.partitionBy(*KEY).orderBy("seq")).alias("until"))


def version(held: DataFrame, at: DataFrame) -> DataFrame:
    """The values (book_id, target, property, value) that held after seq `at` (book_id, at); none for what was not set or is undone."""
    rows = held.join(at, "book_id").filter("since <= at and (until is null or at < until) and value is not null")
    return rows.select(*KEY, "value")


def moved(state: DataFrame, changed: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """A state (book_id, target, property, value) of seq `start` (book_id, at) led to seq `end`, forwards by new values or back by old ones."""
    rows = changed.join(start.select("book_id", F.col("at").alias("a")), "book_id").join(end.select("book_id", F.col("at").alias("z")), "book_id").filter("seq > least(a, z) and seq <= greatest(a, z)")
    last, first = F.max_by(F.struct("new"), "seq"), F.min_by(F.struct("old"), "seq")
    value = F.when(F.first("z") > F.first("a"), last.new).otherwise(first.old)
    now = rows.groupBy(*KEY).agg(value.alias("now"), F.lit(True).alias("met"))
    out = state.join(now, KEY, "full").select(*KEY, F.when(F.col("met"), F.col("now")).otherwise(F.col("value")).alias("value"))
    return out.filter("value is not null")


def stacks(journal: DataFrame, most: int = 500) -> DataFrame:
    """(book_id, stack, level, entry, edit): what can be undone, the last `most` commands that hold, and what can be redone, after the last action."""
    rows = timeline(journal)
    now = rows.groupBy("book_id").agg(F.max_by(F.struct("depth", "undone"), "seq").alias("x")).select("book_id", "x.*").withColumnRenamed("undone", "left").withColumnRenamed("depth", "top")
    last = rows.groupBy("book_id", "level").agg(F.max("entry").alias("entry"))
    found = last.join(now, "book_id").filter("level <= top + left and level > top - %d" % most)
    edit = rows.filter("action = 'edit'").select("book_id", F.col("seq").alias("entry"), "edit")
    return found.withColumn("stack", F.when(F.col("level") <= F.col("top"), "undo").otherwise("redo")).join(edit, ["book_id", "entry"]).select("book_id", "stack", "level", "entry", "edit")
