"""Scalar text functions as Column expressions. Offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{A0}\x{FEFF}]"


def lit(x: str) -> Column:
    return F.lit(x)


def word_count(text: Column) -> Column:
    """Runs of letters, letter numbers and other numbers; decimal digits do not count."""
    return F.regexp_count(text, lit(r"[\p{L}\p{Nl}\p{No}]+")).cast("long")


def letter_words(text: Column) -> Column:
    """Runs of letters only: for sentences and progress."""
    return F.regexp_count(text, lit(r"\p{L}+")).cast("long")


def whole_word(word: str) -> str:
    """A pattern that finds word between Unicode word boundaries."""
    return r"(?<![\p{L}\p{N}_])\Q" + word + r"\E(?![\p{L}\p{N}_])"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), SPACE + "+"), lambda w: w != "")


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def clipped(text: Column, most: int) -> Column:
    """Collapsed text of at most so many characters, with an ellipsis where it is cut."""
    flat = collapsed(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), lit("…"))).otherwise(flat)


def stripped(text: Column, chars: str) -> Column:
    return F.btrim(text, lit(chars))


def without_final_period(text: Column) -> Column:
    """One final period goes, also in front of closing signs."""
    return F.regexp_replace(text, r"\.([«»“”‘’‹›\"')\]}]*\s*)$", "$1")


def slug(text: Column) -> Column:
    """Id from a name: lower case, Latin letters without marks, the rest as hyphens, never empty."""
    plain = F.translate(F.regexp_replace(F.lower(text), "ß", "ss"), "äáàâãåçéèêëíìîïñóòôõöúùûüýÿšžčł", "aaaaaaceeeeiiiinooooouuuuyyszcł")
    hyphens = F.btrim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), lit("-"))
    return F.when(hyphens == "", lit("x")).otherwise(hyphens)


def initials(name: Column) -> Column:
    """Badge: two letters of a single name, else those of the first and last part; ? without letters."""
    parts = F.filter(F.split(F.translate(name, "-", " "), r"\s+"), lambda p: p.rlike(r"^\p{L}"))
    first, last = F.get(parts, 0), F.element_at(parts, -1)
    return F.when(F.size(parts) == 0, lit("?")).when(F.size(parts) == 1, capitalized(F.substring(first, 1, 2))).otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))))


def confidence(value: Column) -> Column:
    """Percent or fraction, as a fraction from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value > 1, value / 100).otherwise(value)))


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))).otherwise(F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60))))


def count_of(text: Column, sign: str) -> Column:
    """How often one character occurs."""
    return (F.length(text) - F.length(F.translate(text, sign, ""))).cast("long")


#: Loopback, private and link-local ranges, unique local addresses, reserved suffixes.
LOCAL_HOST = r"(?i)^(localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+|\[::1\]|\[f[cd][0-9a-f]*:.*\]|\[fe80:.*\]|[^.:\[\]]+|.*\.(local|localhost|lan|internal|home|home\.arpa))$"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(rest)


def is_local_url(url: Column) -> Column:
    host = host_of(url)
    return F.coalesce((host != "") & host.rlike(LOCAL_HOST), F.lit(False))
