"""Who speaks: explicit clauses by patterns in the JVM, the rest by an ordered pass over each book.

The first pass looks, for each span, at the rest of its sentence, then at what stands before it, then back in its block.
The second goes through a book's spans in reading order and decides by continuation, pronoun, paragraph, nearness and
alternation. Rows are dealt by book, because a figure met in one chapter is known in the next, and sorted; a task reads
them as a stream and holds the figures of one book and the spans of one block, however long the book is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import slug, stripped, word_count
from vellichor.operators.segment import sentence_spans
from vellichor.session import partitions, staged

#: Verbs of speech, German then English.
VERBS = """
sagte sagt sagten spricht sprach sprachen rief ruft riefen fragte fragt fragten antwortete antwortet erwiderte erwidert
entgegnete entgegnet meinte meint flüsterte flüstert wisperte raunte tuschelte murmelte murmelt brummte brummelte
knurrte grollte murrte maulte seufzte stöhnte ächzte keuchte schnaubte prustete lachte kicherte grinste schrie brüllte
kreischte zischte fauchte hauchte stammelte stotterte plapperte erklärte erklärt erläuterte versicherte beteuerte
behauptete bemerkte ergänzte fügte setzte wiederholte begann beginnt fuhr unterbrach befahl gebot mahnte warnte drohte
spottete höhnte witzelte scherzte jammerte klagte wimmerte schluchzte gestand stimmte nickte widersprach protestierte
beharrte drängte bat flehte forderte verlangte wandte versetzte begrüßte verabschiedete dachte denkt überlegte staunte
wunderte log erzählte berichtete verkündete betonte bestätigte erinnerte tröstete brüllt lispelte schmunzelte
kommentierte frohlockte japste stieß
said says replied replies answered answers asked asks cried cries shouted whispered murmured muttered growled snapped
exclaimed added continued began remarked observed noted sighed laughed chuckled gasped breathed hissed groaned moaned
stammered insisted agreed protested admitted confessed declared announced explained urged warned ordered commanded
offered thought mused ventured echoed repeated called yelled screamed wondered demanded interrupted put went
""".split()
#: Verbs after which a pronoun answers the one who spoke before.
RESPONSE_VERBS = "erwiderte erwidert entgegnete entgegnet antwortete antwortet versetzte widersprach protestierte replied answered retorted objected protested".split()
#: Pronoun -> m, f, n, 1 (narrator) or ? (open).
PRONOUNS = {"er": "m", "he": "m", "ihn": "m", "ihm": "m", "sie": "f", "she": "f", "ihr": "f", "es": "n", "it": "n", "ich": "1", "i": "1", "man": "?", "wir": "?", "we": "?", "they": "?", "du": "?", "you": "?"}
#: Pronouns that may be a subject, articles, titles (also by gender), adverbs, the narrator's name.
SUBJECT_PRONOUNS = "er sie es ich man du wir he she i they we you".split()
ARTICLES = "der die das den dem ein eine einen einem einer sein seine seinen seinem seiner ihr ihre ihren ihrem ihrer the a an his her my".split()
TITLES = """
Herr Frau Fräulein Frl Miß Miss Mrs Mr Ms Dr Prof Professor Sir Lady Lord König Königin Prinz Prinzessin Graf Gräfin
Häuptling Hauptmann Kapitän Captain Leutnant Lieutenant Major Colonel Oberst Sergeant Onkel Tante Vater Mutter Bruder
Schwester Doktor Pater General Admiral
""".split()
TITLES_F = "frau fr mrs miss ms lady königin prinzessin gräfin mutter schwester tochter tante oma großmutter mädchen dame wirtin magd dienerin alte".split()
TITLES_M = """
herr hr mr mister sir lord könig prinz graf vater bruder sohn onkel opa großvater häuptling hauptmann kapitän leutnant
doktor pfarrer junge mann bursche alte fremde wirt bauer knecht diener
""".split()
ADVERBS = "dann nun noch schon leise laut ruhig plötzlich nur auch jetzt wieder endlich kurz langsam hastig then now softly quietly suddenly".split()
#: Capitalised first words that name nobody.
STOP_NAMES = """
und aber denn doch oder als wenn dann da so ja nein ach oh o nun jetzt heute gestern wieder einmal eines plötzlich
endlich schließlich später dabei damit deshalb darauf dennoch trotzdem natürlich vielleicht nur noch schon erst immer
selbst etwas nichts niemand jemand alle beide viele einige hier dort dies diese dieser dieses jener jene jenes nachdem
während bevor seit ohne gegen über unter nach bei vor aus um an auf am im in von zu mit für wie weil ob was wer wo
warum wieso weshalb wohin woher der die das den dem des ein eine einen einem einer sein seine ihr ihre mein meine dein
unser euer man es kein keine nicht sehr zwar sogar wenigstens immerhin kurz lange leise laut
and but then so now well there this that these those he she it they we you i the a an his her their our my your what
when where why how because although
""".split()
NARRATOR = "Ich-Erzähler"
AFTER, BEFORE, BACK = 90, 140, 220

START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_either = lambda words: "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
_ART = "(?:" + "|".join(f"[{a[0].upper()}{a[0]}]{a[1:]}" for a in sorted(ARTICLES, key=lambda w: (-len(w), w))) + ")"
#: What a name and a noun phrase look like.
_CAP = r"[A-ZÄÖÜ][\p{L}\p{N}_'’\-]+"
NAME = rf"(?:{_either(TITLES)}\.?\s+)?{_CAP}(?:\s+(?:von|van|de|della|ibn)\s+{_CAP})?(?:\s+{_CAP})?"
_NP = rf"{_ART}\s+(?:[a-zäöüß]{{2,}}\s+){{0,2}}{_CAP}"
_LEAD = rf"^\s*(?:\s+{_either(ADVERBS)})?\s*"
_VERB = START + _either(VERBS) + END


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, whatever use does with it."""
    return F.get(F.transform(F.array(x), use), 0)


def one_of(x: Column, words: list[str]) -> Column:
    """Whether x is one of the words, which are one literal: a list of many takes the driver longer to build than the tasks to search."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), x)


def subject(text: Column, head: bool) -> Column:
    """struct<surface, kind> of the subject that opens (head) or closes a text; null without one. kind: pron, np, name."""
    as_ = lambda x, kind: F.struct(x.alias("surface"), F.lit(kind).alias("kind"))
    pronoun = F.lower(F.regexp_extract(text, rf"(?iu){_LEAD}({'|'.join(SUBJECT_PRONOUNS)}){END}" if head else rf"(?iu){START}({'|'.join(SUBJECT_PRONOUNS)})\s*$", 1))
    phrase = F.regexp_extract(text, rf"{_LEAD}({_NP})" if head else rf"({_NP})\s*$", 1)
    phrase = stripped(F.regexp_replace(F.regexp_replace(F.trim(phrase), rf"^{_ART}\s+", ""), r"\s+", " "), " ,.;:!?–—-")
    name = F.trim(F.regexp_extract(text, rf"{_LEAD}({NAME})" if head else rf"({NAME})\s*$", 1))
    first = lambda x: stripped(F.lower(F.substring_index(F.regexp_replace(x, r"\s+", " "), " ", 1)), ".,;:")
    by_pronoun = let(pronoun, lambda x: F.when(x != "", as_(x, "pron")))
    by_phrase = let(phrase, lambda x: F.when((x != "") & (F.contains(x, F.lit(" ")) | ~one_of(F.lower(x), STOP_NAMES)), as_(x, "np")))
    by_name = let(name, lambda x: F.when(one_of(F.lower(x), list(PRONOUNS)), as_(F.lower(x), "pron")).when((F.length(x) >= 3) & ~one_of(first(x), STOP_NAMES), as_(stripped(x, " ,.;:"), "name")))
    return F.coalesce(by_pronoun, by_phrase, by_name) if head else F.coalesce(by_phrase, by_name, by_pronoun)


def inquit(text: Column, last: bool = False) -> Column:
    """struct<surface, kind, verb>: the clause of speech in text, by its first verb (or its last); null without one."""
    lazy = "" if last else "?"

    def clause(t: Column) -> Column:
        seen = t if last else F.substring(t, 1, AFTER)
        before, verb = (F.regexp_extract(seen, rf"(?iu)^([\s\S]*{lazy})({_VERB})", k) for k in (1, 2))

        def around(m: Column) -> Column:
            after = F.substring(t, F.length(m.before) + F.length(m.verb) + 1, F.length(t))
            found = F.coalesce(subject(after, True), subject(m.before, False))
            hit = let(found, lambda x: F.when(x.isNotNull(), F.struct(x.surface.alias("surface"), x.kind.alias("kind"), F.lower(m.verb).alias("verb"))))
            return F.when(m.verb != "", hit)

        return let(F.struct(before.alias("before"), verb.alias("verb")), around)

    return let(F.regexp_replace(F.trim(text), r"^[\s,;:—–-]+", ""), clause)


def explicit(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """First pass. Per span: speaker, surface, kind, conf, via, pron, resp, back_id, back_name, back_kind, utterance."""
    keys = ["book_id", "chapter_ord", "block_ord"]
    rows = spans.join(blocks.select(*keys, "text", sentence_spans(F.col("text")).alias("sentences")), keys)
    holds = F.get(F.filter("sentences", lambda x: (x.s <= F.col("s")) & (F.col("s") < x.e)), 0)
    rows = rows.withColumn("sent", F.coalesce(holds, F.struct(F.lit(0).cast("long").alias("s"), F.length("text").cast("long").alias("e"))))
    cut = lambda a, b: F.expr(f"substring(text, cast({a} as int) + 1, greatest(cast({b} as int) - cast({a} as int), 0))")
    # What stands before is only looked at where nothing after it says who speaks, what is farther back only where neither does.
    rows = rows.withColumn("after", inquit(cut("e", "sent.e")))
    rows = rows.withColumn("before", F.when(F.col("after").isNull(), inquit(cut(f"greatest(sent.s, s - {BEFORE})", "s"))))
    rows = rows.withColumn("back", F.when(F.coalesce("after", "before").isNull(), inquit(cut(f"greatest(0, s - {BACK})", "s"), last=True)))
    rows = rows.withColumn("hit", F.coalesce("after", "before")).withColumn("found", F.when(F.col("after").isNotNull(), "inquit_after").when(F.col("before").isNotNull(), "inquit_before"))
    named = F.col("hit").isNotNull() & (F.col("hit.kind") != "pron") & ~F.col("inner")
    pronoun = (F.col("hit.kind") == "pron") & ~F.col("inner")
    sure = F.when(F.col("hit.kind") == "name", 0.95).otherwise(0.75) - F.when(F.col("found") == "inquit_before", 0.05).otherwise(0.0)
    back = F.col("hit").isNull() & F.col("back").isNotNull() & (F.col("back.kind") != "pron")
    return rows.select(
        *keys, "span_ix", "s", "e", "cont", "inner",
        F.when(named, slug(F.col("hit.surface"))).alias("speaker"), F.when(named, F.col("hit.surface")).alias("surface"), F.when(named, F.col("hit.kind")).alias("kind"),
        F.when(named, F.round(sure, 2)).otherwise(0.0).alias("conf"),
        F.when(F.col("inner"), "inner").when(named, F.col("found")).when(pronoun, F.concat("found", F.lit("_pron"))).alias("via"),
        F.when(pronoun, F.col("hit.surface")).alias("pron"), F.coalesce(pronoun & one_of(F.col("hit.verb"), RESPONSE_VERBS), F.lit(False)).alias("resp"),
        F.when(back, slug(F.col("back.surface"))).alias("back_id"), F.when(back, F.col("back.surface")).alias("back_name"), F.when(back, F.col("back.kind")).alias("back_kind"),
        cut("s", "e").alias("utterance"),
    )


def genders(blocks: DataFrame, first: DataFrame) -> DataFrame:
    """(book_id, speaker, gender) of figures met in the first pass: by title, else by the pronouns that follow the name."""
    cast = first.filter("speaker is not null").groupBy("book_id", "speaker").agg(F.min_by(F.struct("surface", "kind"), F.struct("chapter_ord", "block_ord", "span_ix")).alias("x")).select("book_id", "speaker", F.col("x.surface").alias("name"), F.col("x.kind").alias("kind"))
    # Each block with the beginning of the next one; a name has to be in the block itself.
    order = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord")
    ahead = F.concat("text", F.lit("\u0001"), F.coalesce(F.substring(F.lead("text").over(order), 1, 90), F.lit("")))
    near = blocks.select("book_id", ahead.alias("ahead"), F.lower("text").alias("lower"))
    named = cast.filter("kind = 'name'").select("book_id", "speaker", "name")
    pattern = F.concat(F.lit(r"(?iu)" + START + r"\Q"), "name", F.lit(r"\E" + END + r"(?=[\s\S]*\u0001)[^.!?»«„“]{0,70}?" + START + r"(er|ihn|ihm|seine?[nmrs]?|he|his|him|sie|ihre?[nmrs]?|she|her)" + END))
    held = near.join(named, "book_id").filter(F.contains("lower", F.lower("name")))
    held = held.select("book_id", "speaker", F.transform(F.regexp_extract_all("ahead", pattern, F.lit(1)), F.lower).alias("pronouns"))
    m = F.size(F.filter("pronouns", lambda p: p.rlike("^(er|ihn|ihm|sein|he$|his|him)")))
    counted = held.groupBy("book_id", "speaker").agg(F.sum(m).alias("m"), F.sum(F.size("pronouns") - m).alias("f"))
    rows = cast.join(counted, ["book_id", "speaker"], "left").withColumn("m", F.coalesce(F.col("m"), F.lit(0))).withColumn("f", F.coalesce(F.col("f"), F.lit(0)))
    parts = F.split(F.lower("name"), r"[^\p{L}\p{N}_]+")
    has = lambda words: F.arrays_overlap(parts, F.split(F.lit(" ".join(words)), " "))
    guessed = F.when((F.col("m") + F.col("f") >= 3) & (F.col("m") > F.col("f") * 1.4), "m").when((F.col("m") + F.col("f") >= 3) & (F.col("f") > F.col("m") * 1.4), "f").otherwise("?")
    return rows.select("book_id", "speaker", "name", "kind", F.when(has(TITLES_F), "f").when(has(TITLES_M), "m").when(F.col("kind") == "name", guessed).otherwise("?").alias("gender"))


ATTRIBUTED = "book_id long, chapter_ord long, block_ord long, span_ix long, s long, e long, inner boolean, speaker string, name string, kind string, conf double, via string"


class Book:
    """What the ordered pass knows while it goes through a book."""

    def __init__(self) -> None:
        self.names: dict[str, tuple[str, str, str]] = {}
        self.alias: dict[str, str] = {}

    def figure(self, key: str, name: str, kind: str, gender: str) -> None:
        self.names[key] = (name, kind, gender)
        self.alias[name.lower().strip(" .,;:")] = key

    def meet(self, key: str, name: str, kind: str) -> str:
        known = self.alias.setdefault(name.lower().strip(" .,;:"), key)
        self.names.setdefault(known, (name, kind, "?"))
        return known

    def not_addressed(self, candidates: list[str], utterance: str) -> list[str]:
        def called(key: str) -> bool:
            last = (self.names.get(key, ("", "", ""))[0].split() or [""])[-1]
            return len(last) >= 3 and re.search(rf"(?<!\w){re.escape(last)}(?!\w)", utterance) is not None

        return [k for k in candidates if not called(k)] or candidates

    def by_pronoun(self, candidates: list[str], pronoun: str) -> str | None:
        wanted = PRONOUNS.get(pronoun, "?")
        if wanted == "1":
            return self.meet("ich-erzahler", NARRATOR, "name")
        turned = candidates[1:] + candidates[:1]
        fitting = [k for k in turned if wanted in "mf" and self.names.get(k, ("", "", "?"))[2] == wanted]
        return next(iter(fitting or turned), None)


READ = ["book_id", "chapter_ord", "block_ord", "span_ix", "s", "e", "inner", "speaker", "surface", "kind", "conf", "via", "cont", "pron", "resp", "back_id", "back_name", "back_kind", "utterance", "type", "names", "gender"]
COLUMNS = [c.split()[0] for c in ATTRIBUTED.split(", ")]
TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
FIGURE, SILENT = -2, -1  # span_ix of rows that are no spans


class Reader:
    """The second pass over rows in reading order: a book's figures first, then its spans and its blocks without speech (with the names in them)."""

    def __init__(self) -> None:
        self.at: tuple | None = None
        self.book, self.recent, self.near = Book(), [], None
        self.spans: list[dict] = []

    def read(self, x: dict) -> list[dict]:
        """The spans of the block before this row, decided, where the row begins another block."""
        at, out = (x["book_id"], x["chapter_ord"], x["block_ord"]), []
        if at != self.at:
            out = self.decide()
            if self.at is None or at[0] != self.at[0]:
                self.book = Book()
            if self.at is None or at[:2] != self.at[:2]:
                self.recent, self.near = [], None
            self.at = at
        if x["span_ix"] == FIGURE:
            self.book.figure(x["speaker"], x["surface"], x["kind"], x["gender"])
        elif x["span_ix"] == SILENT:
            self.near = x["names"] if x["type"] == "p" else self.near
        else:
            self.spans.append(x)
        return out

    def decide(self) -> list[dict]:
        out, self.spans = self.spans, []
        outer = [x for x in out if not x["inner"]]
        for x in outer:
            x.update(decided(x, outer, self.recent, self.near, self.book))
            if x["via"] not in ("continuation", "unknown"):
                self.recent.append(x["speaker"])
            if x["via"] != "continuation":
                self.near = None
        self.near = None if outer else self.near
        for x in out:
            x["name"], x["kind"] = self.book.names.get(x["speaker"], (None, None, None))[:2]
        return out


def ordered_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[dict]) -> pa.RecordBatch:
        kinds = [TYPES[c.split()[1]] for c in ATTRIBUTED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(COLUMNS, kinds)], names=COLUMNS)

    reader = Reader()
    for batch in batches:
        out: list[dict] = []
        for row in zip(*(batch.column(c).to_pylist() for c in READ)):
            out += reader.read(dict(zip(READ, row)))
        yield made(out)
    yield made(reader.decide())


def decided(x: dict, outer: list[dict], recent: list[str], near: list[str] | None, book: Book) -> dict:
    """speaker, conf and via of one span."""
    if x["speaker"]:
        return {}
    made = lambda who, conf, via: {"speaker": who, "conf": conf, "via": via}
    if x["cont"] and recent:
        return made(recent[-1], 0.7, "continuation")
    candidates = book.not_addressed(list(dict.fromkeys(reversed(recent))), x["utterance"])
    if x["pron"] and x["resp"] and (who := book.by_pronoun(candidates, x["pron"])):
        return made(who, 0.6, "pronoun")
    mates = {y["speaker"] for y in outer if y["speaker"] and y["conf"] >= 0.55}
    if len(mates) == 1:
        return made(mates.pop(), 0.7, "same_paragraph")
    if x["pron"] and (who := book.by_pronoun(candidates, x["pron"])):
        return made(who, 0.55, "pronoun")
    if x["back_id"]:
        return made(book.meet(x["back_id"], x["back_name"], x["back_kind"]), 0.5, "inquit_paragraph")
    if near is not None:
        known = list(dict.fromkeys(k for n in near if (k := book.alias.get(n.lower()))))
        known = book.not_addressed(known, x["utterance"])
        if len(known) == 1:
            return made(known[0], 0.45, "proximity")
    if candidates:
        return made(candidates[1], 0.4, "alternation") if len(candidates) > 1 else made(candidates[0], 0.35, "alternation")
    return made(None, 0.0, "unknown")


def attribute(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span with its speaker, the figure's name and kind, confidence and provenance."""
    first = staged(explicit(blocks, spans))  # read twice below
    keys = ["book_id", "chapter_ord", "block_ord"]
    figures = genders(blocks, first).select("book_id", F.lit(-1).cast("long").alias("chapter_ord"), F.lit(-1).cast("long").alias("block_ord"), F.lit(FIGURE).cast("long").alias("span_ix"), "speaker", F.col("name").alias("surface"), "kind", "gender")
    outer = spans.filter("not inner").select(*keys).distinct()
    silent = blocks.join(outer, keys, "left_anti").select(*keys, F.lit(SILENT).cast("long").alias("span_ix"), "type", F.regexp_extract_all("text", F.lit(f"({NAME})"), F.lit(1)).alias("names"))
    rows = first.unionByName(silent, allowMissingColumns=True).unionByName(figures, allowMissingColumns=True).select(*READ)
    order = ["book_id", "chapter_ord", "block_ord", "span_ix"]
    return rows.repartition(partitions(blocks.sparkSession), "book_id").sortWithinPartitions(*order, "speaker").mapInArrow(ordered_pass, ATTRIBUTED)


def cast_table(attributed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per figure: lines, words, chapters, first chapter."""
    keys = ["book_id", "chapter_ord", "block_ord"]
    rows = attributed.filter("speaker is not null").join(blocks.select(*keys, "text"), keys)
    said = F.expr("substring(text, cast(s as int) + 1, cast(e - s as int))")
    return rows.groupBy("book_id", "speaker").agg(F.min_by("name", F.struct("chapter_ord", "block_ord", "span_ix")).alias("name"), F.count("*").alias("lines"), F.sum(word_count(said)).alias("words"), F.countDistinct("chapter_ord").alias("chapters"), F.min("chapter_ord").alias("first_chapter"))


def merges(rows: list[tuple[str, int, frozenset, bool]]) -> dict[str, str]:
    """Of figures with one name but for titles (speaker, lines, titles, pinned): who joins whom.

    In the order of lines, each figure that is not pinned joins the first one that is still there, has as many lines or
    more, and whose titles do not contradict; it takes over the lines."""
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    lines, titles, into = {r[0]: r[1] for r in order}, {r[0]: r[2] for r in order}, {}
    for small, _, own, pinned in order:
        fitting = (r[0] for r in order if r[0] != small and r[0] not in into and lines[r[0]] >= lines[small] and (not own or not titles[r[0]] or own == titles[r[0]]))
        big = None if pinned else next(fitting, None)
        if big is not None:
            into[small] = big
            lines[big] += lines[small]

    def last(key: str) -> str:
        while key in into:
            key = into[key]
        return key

    return {r[0]: last(r[0]) for r in order}


def merged_names(cast: DataFrame) -> DataFrame:
    """(book_id, speaker, merged): the figure that each one is after merging. Names without words of two letters besides titles merge with nothing.

    A group holds the figures of one book that differ in titles only; figures of one such name and the same titles are
    few, as their ids come from their names."""
    parts = F.filter(F.split(F.lower("name"), r"\s+"), lambda p: F.length(p) >= 2)
    parts = F.transform(parts, lambda p: F.btrim(p, F.lit(".")))
    titles = F.split(F.lit(" ".join(TITLES).lower()), " ")
    pinned = F.col("pinned") if "pinned" in cast.columns else F.lit(False)
    rows = cast.select("book_id", "speaker", F.col("lines").cast("long").alias("lines"), pinned.alias("pinned"), F.array_join(F.array_sort(F.array_distinct(F.array_except(parts, titles))), " ").alias("core"), F.array_join(F.array_sort(F.array_distinct(F.array_intersect(parts, titles))), " ").alias("titles"))
    several = rows.filter("core <> ''").groupBy("book_id", "core").agg(F.count("*").alias("n")).filter("n > 1").select("book_id", "core")

    def joined(group: pa.Table) -> pa.Table:
        found = merges([(r["speaker"], r["lines"], frozenset(r["titles"].split()), r["pinned"]) for r in group.to_pylist()])
        book = group.column("book_id")[0].as_py()
        return pa.table({"book_id": pa.array([book] * len(found), pa.int64()), "speaker": pa.array(list(found), pa.string()), "merged": pa.array(list(found.values()), pa.string())})

    new = rows.join(several, ["book_id", "core"], "left_semi").select("book_id", "core", "speaker", "lines", "pinned", "titles").groupBy("book_id", "core").applyInArrow(joined, "book_id long, speaker string, merged string")
    return cast.select("book_id", "speaker").join(new, ["book_id", "speaker"], "left").select("book_id", "speaker", F.coalesce("merged", "speaker").alias("merged"))


def merged_cast(attributed: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributed spans with merged figures, their cast)."""
    before = cast_table(attributed, blocks)
    into = merged_names(before)
    kept = before.select("book_id", F.col("speaker").alias("merged"), F.col("name").alias("kept_name"))
    rows = attributed.join(into, ["book_id", "speaker"], "left").join(kept, ["book_id", "merged"], "left")
    rows = rows.withColumn("speaker", F.coalesce("merged", "speaker")).withColumn("name", F.coalesce("kept_name", "name")).select(*attributed.columns)
    return rows, cast_table(rows, blocks)
