"""Small rules of the views: pens, dimming, stepping, tempo, devices, order of pickers, counts for filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.operators.commands import pen

#: Names of the pens.
PEN_NAMES = ["Rot", "Blau", "Grün", "Orange", "Violett"]
PLAIN = "schlicht"


def pen_name(color: Column, labels: Column) -> Column:
    """A pen's name with its meaning in this book."""
    slot = pen(color)
    name = F.get(F.array(*[F.lit(x) for x in PEN_NAMES]), slot)
    meaning = F.trim(F.coalesce(F.get(labels, slot), F.lit("")))
    return F.when(slot.isNull(), PLAIN).when(meaning != "", F.concat(name, F.lit(" – "), meaning)).otherwise(name)


def interval(kind: Column, s: Column, e: Column, at: Column) -> Column:
    """struct<s, e> of any annotation: points begin and end where they are."""
    point = kind.isin("pause", "breath")
    return F.struct(F.when(point, at).otherwise(s).alias("s"), F.when(point, at).otherwise(e).alias("e"))


def device(agent: Column, touch_points: Column) -> Column:
    """Class of a device by its user agent."""
    tablet = agent.rlike("iPad") | (agent.rlike("Macintosh") & (F.coalesce(touch_points, F.lit(0)) > 1))
    return F.when(tablet, "iPad").when(agent.rlike("iPhone"), "iPhone").when(agent.rlike("Android"), "Android-Gerät").otherwise("Browser")


def may_have_changed(size: Column, modified: Column, known_size: Column, known_modified: Column) -> Column:
    return known_size.isNull() | (size != known_size) | (modified != known_modified)


def dimmed(span_id: Column, speaker: Column, focus: Column, review: Column, isolated: Column, muted: Column) -> Column:
    """Whether a span is dimmed: all but the one in focus; none in review; all but the isolated figure's; those of muted figures."""
    quiet = speaker.isNotNull() & F.array_contains(muted, speaker)
    return F.when(focus.isNotNull(), focus != span_id).when(review, False).when(isolated.isNotNull(), ~speaker.eqNullSafe(isolated)).otherwise(F.coalesce(quiet, F.lit(False)))


def stepped(at: Column, direction: Column, n: Column) -> Column:
    """The next place on a circle of n; null where there is none."""
    return F.when(n > 0, F.pmod(at + direction + n, n))


def tempo(words_per_minute: Column) -> Column:
    """A measured tempo as a setting: in steps of five, from 80 to 260."""
    return F.least(F.lit(260), F.greatest(F.lit(80), F.floor(words_per_minute / 5 + 0.5) * 5)).cast("long")


def pen_counts(marks: DataFrame) -> DataFrame:
    """(book_id, chapter_ord, color, n) of emphasis; -1 is plain."""
    return marks.filter("type = 'emphasis'").groupBy("book_id", "chapter_ord", F.coalesce(pen(F.col("color")), F.lit(-1)).alias("color")).agg(F.count("*").alias("n"))


def mark_counts(marks: DataFrame) -> DataFrame:
    """(book_id, all, and one column for each kind)."""
    kinds = ("retake", "bookmark", "note", "emphasis")
    return marks.filter(F.col("type").isin(*kinds)).groupBy("book_id").agg(F.count("*").alias("all"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds])


def picker(cast: DataFrame, chapter_lines: DataFrame, query: str = "") -> DataFrame:
    """Figures in the order of a picker for each chapter: those who speak there first, then by lines in the book; with a query only those whose name or alias holds it.

    cast: (book_id, speaker, name, aliases, lines); chapter_lines: (book_id, chapter_ord, speaker, n)."""
    q = query.strip().lower()
    found = cast.filter(F.contains(F.lower("name"), F.lit(q)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q)))) if q else cast
    rows = chapter_lines.select("book_id", "chapter_ord").distinct().join(found, "book_id").join(chapter_lines, ["book_id", "chapter_ord", "speaker"], "left")
    order = Window.partitionBy("book_id", "chapter_ord").orderBy(F.desc(F.coalesce("n", F.lit(-1))), F.desc("lines"), "speaker")
    return rows.select("book_id", "chapter_ord", F.row_number().over(order).cast("long").alias("place"), "speaker")
