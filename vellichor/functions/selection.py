"""Ranges in a text: trimming, growing to words, context of a hit, places to breathe. Offsets count code points, half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SIGN = r"[\p{L}\p{N}'’\-]"
#: Signs taken along in front of and behind a selection.
QUOTE_OPEN, QUOTE_CLOSE = "»„“‚›‹«\"'(", "«“”‘‹›»\"')"


def part(text: Column, s: Column, e: Column) -> Column:
    return F.substring(text, s.cast("int") + 1, F.greatest((e - s).cast("int"), F.lit(0)))


def _range(s: Column, e: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))


def trimmed(text: Column, s: Column, e: Column) -> Column:
    """The range without white space at its edges, inside the text; empty at its end if there is nothing else."""
    low, high = F.greatest(s, F.lit(0)), F.least(e, F.length(text))
    inside = part(text, low, high)
    begin = low + F.length(inside) - F.length(F.regexp_replace(inside, r"^\s+", ""))
    return _range(begin, F.greatest(begin, high - (F.length(inside) - F.length(F.regexp_replace(inside, r"\s+$", "")))))


def range_error(text: Column, s: Column, e: Column) -> Column:
    """Why a range cannot be marked; null if it can."""
    cut = trimmed(text, s, e)
    return F.when(s.isNull() | e.isNull() | (s < 0) | (e > F.length(text)) | (s >= e), "range").when(cut.s >= cut.e, "blank")


def snapped(text: Column, s: Column, e: Column, quotes: bool = False) -> Column:
    """A selection grown to whole words, without white space at its edges; with quotes, the signs next to it are taken along."""
    low = F.greatest(F.least(s, e), F.lit(0))
    high = F.least(F.greatest(s, e), F.length(text).cast("long"))
    word = lambda x: x.rlike(WORD_SIGN)
    tail = F.length(F.regexp_extract(part(text, F.lit(0), low), f"{WORD_SIGN}*$", 0))
    low = low - F.when(word(part(text, low, low + 1)), tail).otherwise(0)
    head = F.length(F.regexp_extract(F.substr(text, high.cast("int") + 1), f"^{WORD_SIGN}*", 0))
    high = high + F.when(word(part(text, high - 1, high)), head).otherwise(0)
    cut = trimmed(text, low, high)
    if not quotes:
        return cut
    signs = lambda x: "[" + "".join("\\" + c for c in x) + "]*"
    before = F.length(F.regexp_extract(part(text, F.lit(0), cut.s), signs(QUOTE_OPEN) + "$", 0))
    after = F.length(F.regexp_extract(F.substr(text, cut.e.cast("int") + 1), "^" + signs(QUOTE_CLOSE), 0))
    return _range(cut.s - before, cut.e + after)


def context(text: Column, s: Column, e: Column, radius: int = 48) -> Column:
    """struct<before, match, after>: so many characters around a hit, cut at blanks, with an ellipsis where something is left out."""
    n = F.length(text)
    low, high = F.greatest(s - radius, F.lit(0)), F.least(e + radius, n)
    blank = F.locate(" ", part(text, low, s))  # the first one before the hit, from 1
    low = F.when((low > 0) & (blank > 0), low + blank).otherwise(low)
    beyond = part(text, e, high + 1)
    last = F.length(beyond) - F.locate(" ", F.reverse(beyond))
    high = F.when((high < n) & (F.locate(" ", beyond) > 0) & (last > 0), e + last).otherwise(high)
    dots = lambda left_out: F.when(left_out, "…").otherwise("")
    return F.struct(F.concat(dots(low > 0), part(text, low, s)).alias("before"), part(text, s, e).alias("match"), F.concat(part(text, e, high), dots(high < n)).alias("after"))


#: Where one can breathe: comma, semicolon, colon, a dash that stands alone.
BREATH = r"[,;:]|(?<=\s)[–—](?=\s)"


def breath_chunks(text: Column, begin: Column) -> Column:
    """array<struct<s, e, text, breath>>: the text cut at signs to breathe at; null if there are none."""
    from vellichor.operators.segment import MARK, pieces

    parts = F.filter(pieces(F.regexp_replace(text, f"({BREATH})", MARK + "$1" + MARK)), lambda p: p.text != "")
    found = F.transform(parts, lambda p: F.struct((begin + p.s).alias("s"), (begin + p.e).alias("e"), p.text.alias("text"), p.text.rlike(r"^[,;:–—]$").alias("breath")))
    return F.when(text.rlike(BREATH), found)


def char_class(sign: Column) -> Column:
    """Kinds of a character, as letters: n alphanumeric, a alphabetic, l lower, u upper, s space."""
    has = lambda pattern, name: F.when(sign.rlike(f"^{pattern}$"), name).otherwise("")
    return F.concat(has(r"[\p{L}\p{N}]", "n"), has(r"\p{L}", "a"), has(r"\p{Ll}", "l"), has(r"\p{Lu}", "u"), has(r"\s", "s"))
