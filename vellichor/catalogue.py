"""The queries of the library and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellichor.functions import text as T
from vellichor.operators import attribution, colors, edits, ink, jobs, segment, speech, stats, views
from vellichor.plans.analysis import analyse
from vellichor.session import spread, table
from vellichor.sources import books, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The script corpus in SQL.
SCRIPT = r"""
script AS (
  SELECT conv_id AS book_id, turn // 8 AS chapter_ord, turn AS block_ord, turn % 3 AS kind, who,
    CASE turn % 3 WHEN 0 THEN '»' || said || '«, sagte ' || who || '.' WHEN 1 THEN who || ' sagte: »' || said || '«' ELSE '»' || said || '«' END AS text, length(said) AS n
  FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Anna' WHEN 'assistant' THEN 'Jonas' ELSE 'Paul' END AS who,
          regexp_replace(text, '[»«„“”‚‘›‹"\r\n.!?…:]', ' ', 'g') AS said FROM conversations)
)"""
LINES = r"""
lines AS (
  SELECT doc_id AS book_id, 0::BIGINT AS chapter_ord, i - 1 AS block_ord, trim(x, ' ') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(x, ' ') <> ''
)"""
SENTENCE_COUNT = r"len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s, ' ') <> ''))"
WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return books.text_blocks(_documents(spark, sf))


def _script(spark: SparkSession, sf: str) -> DataFrame:
    return books.script(spread(table(spark, sf, "conversations")))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Script turns that name their speaker, as attributed spans."""
    rows = _script(spark, sf).filter("kind < 2")
    return rows.select("book_id", "chapter_ord", "block_ord", F.lit(0).cast("long").alias("span_ix"), F.lower("who").alias("speaker"), F.col("who").alias("name"), F.when(F.col("kind") == 0, 0.95).otherwise(0.9).alias("conf"), F.when(F.col("kind") == 0, "inquit_after").otherwise("inquit_before").alias("via"), "text")


# text ---------------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, {WORDS}::BIGINT AS words FROM documents")
def doc_word_count(spark, sf):
    return _documents(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+'))::BIGINT AS words FROM documents")
def doc_word_count_letters(spark, sf):
    return _documents(spark, sf).select("doc_id", T.letter_words(F.col("text")).alias("words"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59), ' ') || '…' ELSE t END AS clip FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents)")
def clip_text(spark, sf):
    return _documents(spark, sf).select("doc_id", T.clipped(F.col("text"), 60).alias("clip"))


@query(r"""
SELECT p_partkey, CASE len(p) WHEN 0 THEN '?' WHEN 1 THEN upper(substr(p[1], 1, 1)) || lower(substr(p[1], 2, 1)) ELSE upper(substr(p[1], 1, 1) || substr(p[-1], 1, 1)) END AS badge
FROM (SELECT p_partkey, list_filter(string_split(replace(p_name, '-', ' '), ' '), lambda x: regexp_matches(x, '^\p{L}')) AS p FROM part)
""")
def badge_initials(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.initials(F.col("p_name")).alias("badge"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM customer")
def slugify(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_docs(spark, sf):
    return _documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN '10.' || page_id % 250 || '.0.1' WHEN 1 THEN '172.' || page_id % 40 || '.1.1' WHEN 2 THEN 'box' || page_id || '.lan' WHEN 3 THEN '[fd00::' || page_id % 10 || ']' ELSE lower(split_part(split_part(url, '://', 2), '/', 1)) END AS host,
  CASE page_id % 6 WHEN 1 THEN page_id % 40 BETWEEN 16 AND 31 ELSE page_id % 6 < 4 END AS local FROM pages
""")
def is_local_url(spark, sf):
    """Private, link-local and reserved hosts among those of the pages."""
    k = F.col("page_id")
    own = F.when(k % 6 == 0, F.concat(F.lit("http://10."), k % 250, F.lit(".0.1:8080/x"))).when(k % 6 == 1, F.concat(F.lit("http://172."), k % 40, F.lit(".1.1/"))).when(k % 6 == 2, F.concat(F.lit("HTTP://me@Box"), k, F.lit(".LAN?q"))).when(k % 6 == 3, F.concat(F.lit("http://[fd00::"), k % 10, F.lit("]:1/"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.host_of(own).alias("host"), T.is_local_url(own).alias("local"))


@query("SELECT event_id, floor(greatest(value, 0))::BIGINT AS seconds, least(1.0, greatest(0.0, CASE WHEN value > 1 THEN value / 100 ELSE value END))::DOUBLE AS confidence FROM events")
def normal_confidence(spark, sf):
    return table(spark, sf, "events").select("event_id", F.floor(F.greatest("value", F.lit(0))).cast("long").alias("seconds"), T.confidence(F.col("value")).cast("double").alias("confidence"))


@query("""
WITH p AS (SELECT event_type, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)
SELECT event_type, count(*) AS n, count(DISTINCT k) AS kinds, sum(k)::BIGINT AS total, max(k) AS largest FROM p GROUP BY event_type
""")
def json_props(spark, sf):
    """Sums over a field of the parsed properties."""
    rows = table(spark, sf, "events").select("event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds"), F.sum("k").alias("total"), F.max("k").alias("largest"))


# blocks and sentences -----------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT book_id, block_ord, text FROM lines")
def doc_blocks(spark, sf):
    return _lines(spark, sf).select("book_id", "block_ord", "text")


@query(f"WITH {LINES} SELECT book_id, block_ord, {SENTENCE_COUNT}::BIGINT AS sentences FROM lines")
def naive_sentences(spark, sf):
    return _lines(spark, sf).select("book_id", "block_ord", segment.plain_sentences(F.col("text")).alias("sentences"))


@query(f"""
WITH {LINES}, counted AS (SELECT *, {SENTENCE_COUNT}::BIGINT AS n FROM lines)
SELECT book_id, block_ord, n, (1 + coalesce(sum(n) OVER (PARTITION BY book_id, chapter_ord ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_no FROM counted
""")
def running_sentence_no(spark, sf):
    return segment.running_numbers(_lines(spark, sf)).drop("chapter_ord")


@query(f"WITH {LINES} SELECT book_id, block_ord, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) AS no FROM lines")
def global_block_no(spark, sf):
    order = Window.partitionBy("book_id").orderBy("chapter_ord", "block_ord")
    return _lines(spark, sf).select("book_id", "block_ord", F.row_number().over(order).cast("long").alias("no"))


@query()
def sentences_full(spark, sf):
    return segment.sentences(_lines(spark, sf)).drop("text")


@query(f"""
WITH {LINES}, words AS (SELECT *, {WORDS} AS w FROM lines), chosen AS (SELECT book_id FROM words GROUP BY book_id HAVING sum(w) >= 300)
SELECT book_id, block_ord FROM lines WHERE book_id IN (SELECT book_id FROM chosen)
""")
def filter_chapters(spark, sf):
    return books.chosen_chapters(_lines(spark, sf), "1", 300).select("book_id", "block_ord")


@query(f"""
WITH {LINES}, marked AS (SELECT *, length(text) < 80 AND starts_with(text, 'The') AS head FROM lines),
opened AS (SELECT *, head AND NOT coalesce(lag(head) OVER (PARTITION BY book_id ORDER BY block_ord), false) AS opens FROM marked)
SELECT book_id, block_ord, (sum(opens::INT) OVER (PARTITION BY book_id ORDER BY block_ord))::BIGINT AS chapter_ord, CASE WHEN head AND opens THEN 'h1' WHEN head THEN 'h2' ELSE 'p' END AS type FROM opened
""")
def chapter_split(spark, sf):
    return books.chapters(_lines(spark, sf), heading="^The").select("book_id", "block_ord", "chapter_ord", "type")


@query()
def page_blocks(spark, sf):
    return pages.page_blocks(spread(table(spark, sf, "pages"))).select("id", "ix", "type", "text", F.size("marks").cast("long").alias("n_marks"))


@query()
def page_titles(spark, sf):
    return pages.page_titles(pages.page_blocks(spread(table(spark, sf, "pages"))))


# speech and speakers --------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id AS book_id, sum(length(text) - length(replace(text, '"', '')))::BIGINT AS double, sum(length(text) - length(replace(text, '»', '')))::BIGINT AS "right" FROM documents GROUP BY doc_id
""")
def doc_quote_scores(spark, sf):
    return speech.quote_scores(_documents(spark, sf).select(F.col("doc_id").alias("book_id"), "text", F.lit("p").alias("type"))).select("book_id", "double", "right")


@query("SELECT DISTINCT conv_id AS book_id, 'guillemets_de' AS style, '»' AS open, '«' AS close FROM conversations")
def script_quote_style(spark, sf):
    return speech.quote_style(_script(spark, sf))


@query(f"""
WITH {SCRIPT} SELECT book_id, block_ord, strpos(text, '»')::BIGINT - 1 AS s, strpos(text, '«')::BIGINT AS e FROM script
""")
def speech_spans(spark, sf):
    return speech.speech_spans(_script(spark, sf)).select("book_id", "block_ord", "s", "e")


@query(f"""
WITH {SCRIPT} SELECT book_id, block_ord, strpos(text, '»')::BIGINT - 1 AS s, strpos(text, '«')::BIGINT AS e FROM script
""")
def speech_spans_all(spark, sf):
    """The spans of whole utterances."""
    return speech.speech_spans(_script(spark, sf)).select("book_id", "block_ord", "s", "e")


@query(f"""
WITH {SCRIPT} SELECT book_id, block_ord, CASE WHEN kind < 2 THEN lower(who) END AS speaker, CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS conf,
  CASE kind WHEN 0 THEN 'inquit_after' WHEN 1 THEN 'inquit_before' END AS via FROM script
""")
def inquit_explicit(spark, sf):
    rows = _script(spark, sf)
    return attribution.explicit(rows, speech.speech_spans(rows)).select("book_id", "block_ord", "speaker", F.col("conf").cast("double").alias("conf"), "via")


@query()
def speaker_attribution_all(spark, sf):
    rows = _script(spark, sf)
    return attribution.attribute(rows, speech.speech_spans(rows))


@query(f"""
WITH RECURSIVE {SCRIPT}, two AS (SELECT * FROM script WHERE book_id NOT IN (SELECT book_id FROM script WHERE who = 'Paul')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_ord ORDER BY block_ord) AS k FROM two),
walk AS (
  SELECT book_id, chapter_ord, k, block_ord, CASE WHEN kind < 2 THEN lower(who) END AS speaker, kind, CASE WHEN kind < 2 THEN lower(who) END AS last, (kind < 2 AND who = 'Anna') AS anna, (kind < 2 AND who = 'Jonas') AS jonas, 0.0::DOUBLE AS conf FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.book_id, o.chapter_ord, o.k, o.block_ord, s, o.kind, coalesce(s, w.last), w.anna OR s = 'anna', w.jonas OR s = 'jonas', CASE WHEN s IS NULL THEN 0.0 WHEN w.anna AND w.jonas THEN 0.4 ELSE 0.35 END::DOUBLE
  FROM walk w JOIN ordered o ON o.book_id = w.book_id AND o.chapter_ord = w.chapter_ord AND o.k = w.k + 1,
  LATERAL (SELECT CASE WHEN o.kind < 2 THEN lower(o.who) WHEN w.anna AND w.jonas THEN CASE w.last WHEN 'anna' THEN 'jonas' ELSE 'anna' END ELSE w.last END AS s)
)
SELECT book_id, block_ord, speaker, CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE conf END::DOUBLE AS conf,
  CASE WHEN kind = 0 THEN 'inquit_after' WHEN kind = 1 THEN 'inquit_before' WHEN speaker IS NULL THEN 'unknown' ELSE 'alternation' END AS via FROM walk
""")
def speaker_attribution(spark, sf):
    rows = _script(spark, sf)
    three = rows.filter("who = 'Paul'").select("book_id").distinct()
    rows = rows.join(three, "book_id", "left_anti")
    return attribution.attribute(rows, speech.speech_spans(rows)).select("book_id", "block_ord", "speaker", "conf", "via")


@query()
def book_stats(spark, sf):
    return analyse(_script(spark, sf)).stats()


NAMED = f"WITH {SCRIPT}, named AS (SELECT *, lower(who) AS speaker FROM script WHERE kind < 2)"


@query(f"{NAMED} SELECT book_id, speaker, who AS name, count(*) AS lines, count(DISTINCT chapter_ord) AS chapters, min(chapter_ord) AS first_chapter FROM named GROUP BY book_id, speaker, who")
def cast_table(spark, sf):
    rows = _named(spark, sf).drop("text").withColumn("s", F.lit(0).cast("long")).withColumn("e", F.lit(1).cast("long"))
    return attribution.cast_table(rows, _script(spark, sf)).drop("words")


@query(f"""
{NAMED}, via AS (SELECT book_id, CASE kind WHEN 0 THEN 'inquit_after' ELSE 'inquit_before' END AS via, count(*) AS n FROM named GROUP BY ALL)
SELECT book_id, via, 'sure' AS via_group, n, round(n * 100.0 / sum(n) OVER (PARTITION BY book_id), 4)::DOUBLE AS share FROM via
""")
def via_histogram(spark, sf):
    return stats.by_via(_named(spark, sf).withColumn("inner", F.lit(False))).withColumn("share", F.col("share").cast("double"))


@query(f"""
{NAMED} SELECT book_id, chapter_ord, speaker, count(*) AS n, row_number() OVER (PARTITION BY book_id, chapter_ord ORDER BY count(*) DESC, speaker) AS place FROM named GROUP BY book_id, chapter_ord, speaker
""")
def chapter_cast(spark, sf):
    return stats.chapter_cast(_named(spark, sf).withColumn("inner", F.lit(False)))


@query(f"WITH {SCRIPT} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, block_ord) AS place, block_ord FROM script WHERE kind = 2")
def review_queue(spark, sf):
    rows = _script(spark, sf)
    first = attribution.explicit(rows, speech.speech_spans(rows))
    return stats.review_queue(first).select("book_id", "place", "block_ord")


def _cast(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).groupBy("book_id", "speaker").agg(F.first("name").alias("name"), F.count("*").alias("lines"))


SLOTS = "slots AS (SELECT book_id, speaker, k - 1 AS slot FROM (SELECT book_id, speaker, row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, speaker) AS k, count(*) AS n FROM named GROUP BY book_id, speaker) WHERE n >= 4 AND k <= 12)"


@query("""
WITH c AS (SELECT c_nationkey AS book_id, c_custkey AS speaker, c_name AS name, count(*) AS lines FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT book_id, speaker, k - 1 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY lines DESC, name) AS k FROM c WHERE lines >= 4) WHERE k <= 12
""")
def global_colors(spark, sf):
    """A nation's customers as a book's figures, their orders as lines."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("speaker")).agg(F.count("*").alias("lines"))
    return colors.global_slots(table(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("speaker"), F.col("c_name").alias("name")).join(orders, "speaker"))


LOCAL = """firsts AS (SELECT book_id, chapter_ord, speaker, min(block_ord) AS first FROM named GROUP BY ALL),
taken AS (SELECT f.book_id, f.chapter_ord, list(s.slot) AS t FROM firsts f JOIN slots s USING (book_id, speaker) GROUP BY ALL),
locals AS (
  SELECT f.book_id, f.chapter_ord, f.speaker, list_filter(range(12), lambda x: NOT list_contains(coalesce(t, []), x))[row_number() OVER (PARTITION BY f.book_id, f.chapter_ord ORDER BY first)] AS slot
  FROM firsts f ANTI JOIN slots s USING (book_id, speaker) LEFT JOIN taken USING (book_id, chapter_ord)
)"""


@query(f"{NAMED}, {SLOTS}, {LOCAL} SELECT * FROM locals")
def chapter_colors(spark, sf):
    return colors.chapter_slots(_named(spark, sf), colors.global_slots(_cast(spark, sf)))


@query(f"{NAMED}, {SLOTS}, {LOCAL} SELECT n.book_id, n.block_ord, n.speaker, coalesce(s.slot, l.slot) AS slot FROM named n LEFT JOIN slots s USING (book_id, speaker) LEFT JOIN locals l ON l.book_id = n.book_id AND l.chapter_ord = n.chapter_ord AND l.speaker = n.speaker")
def slot_of(spark, sf):
    named, slots = _named(spark, sf), colors.global_slots(_cast(spark, sf))
    return colors.slot_of(named, slots, colors.chapter_slots(named, slots)).select("book_id", "block_ord", "speaker", "slot")


@query()
def merged_names(spark, sf):
    return attribution.merged_names(_cast(spark, sf))


@query()
def pronunciation_terms(spark, sf):
    """Terms of all texts of a language."""
    rows = segment.sentences(_lines(spark, sf)).join(_documents(spark, sf).select(F.col("doc_id").alias("book_id"), "lang"), "book_id")
    order = F.struct("book_id", "gsid").alias("gsid")
    return stats.pronunciation_terms(rows.select("lang", order, "text"), per="lang")


# views --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'the'))::BIGINT AS hits FROM documents")
def search_hits(spark, sf):
    return _documents(spark, sf).select("doc_id", views.hit_count(F.col("text"), "the").alias("hits"))


@query(f"""
WITH {LINES}, found AS (SELECT book_id, block_ord, text, unnest(range(1, len(string_split(text, 'idiot')))) AS k FROM lines)
SELECT book_id, block_ord, (length(array_to_string(string_split(text, 'idiot')[1:k], 'idiot')))::BIGINT AS s, (length(array_to_string(string_split(text, 'idiot')[1:k], 'idiot')) + 5)::BIGINT AS e FROM found
""")
def search_offsets(spark, sf):
    return views.hits(_lines(spark, sf), "idiot").select("book_id", "block_ord", "s", "e")


MARKS = "marks AS (SELECT event_id % 300 AS book_id, event_id % 5 AS block_ord, 'a' || event_id AS id, event_type AS type, event_id % 7 AS s, event_id % 7 + 1 + event_id % 11 AS e, event_type AS note FROM events)"


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select((k % 300).alias("book_id"), (k % 5).alias("block_ord"), F.concat(F.lit("a"), k).alias("id"), F.col("event_type").alias("type"), (k % 7).alias("s"), (k % 7 + 1 + k % 11).alias("e"), F.col("event_type").alias("note"))


@query(f"WITH {LINES}, {MARKS} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_ord, s, id) AS place, block_ord, id, type FROM marks JOIN lines USING (book_id, block_ord)")
def marks_list(spark, sf):
    return views.mark_list(_marks(spark, sf), _lines(spark, sf)).select("book_id", "place", "block_ord", "id", "type")


LISTED = f"""WITH {LINES}, {MARKS}, listed AS (
  SELECT m.book_id, row_number() OVER (PARTITION BY m.book_id ORDER BY m.block_ord, m.s, m.id) AS place, m.block_ord AS chapter, m.type,
    'B' || m.book_id AS title, m.s + 1 AS sentence, trim(regexp_replace(substr(l.text, (m.s + 1)::INT, (m.e - m.s)::INT), '\\s+', ' ', 'g'), ' ') AS marked,
    m.note, CASE WHEN m.s % 3 = 0 THEN 'Rot' END AS pen
  FROM marks m JOIN lines l USING (book_id, block_ord)
)"""


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Marks with a chapter for each block, so that the chapter's number varies."""
    rows = _marks(spark, sf).withColumn("sentence", F.col("s") + 1).withColumn("pen", F.when(F.col("s") % 3 == 0, "Rot"))
    listed = views.mark_list(rows, _lines(spark, sf)).join(rows.select("book_id", "id", "sentence", "pen"), ["book_id", "id"])
    return listed.withColumn("chapter_ord", F.col("block_ord")).withColumn("title", F.concat(F.lit("B"), "book_id"))


CELL = """CASE WHEN regexp_matches({0}, '[";\r\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(LISTED + f"""
SELECT book_id, chr(65279) || 'Art;Kapitel;Kapiteltitel;Satz;Text;Notiz;Farbe' || chr(13) || chr(10) ||
  string_agg(type || ';' || (chapter + 1) || ';' || title || ';' || sentence || ';' || {CELL.format("marked")} || ';' || note || ';' || coalesce(pen, ''), chr(13) || chr(10) ORDER BY place) || chr(13) || chr(10) AS csv
FROM listed GROUP BY book_id
""")
def marks_csv(spark, sf):
    return views.marks_csv(_listed(spark, sf))


@query(LISTED + """
SELECT book_id, string_agg(type || coalesce(' (' || pen || ')', '') || ' · Kap. ' || (chapter + 1) || ', Satz ' || sentence || ': ' || marked || ' – ' || note, chr(10) ORDER BY place) AS text
FROM listed GROUP BY book_id
""")
def marks_text(spark, sf):
    return views.marks_text(_listed(spark, sf))


@query(f"""
WITH {LINES}, {MARKS}, held AS (SELECT m.*, length(l.text) AS n FROM marks m JOIN lines l USING (book_id, block_ord)),
edges AS (
  SELECT book_id, block_ord, 0 AS x FROM lines UNION SELECT book_id, block_ord, length(text) FROM lines
  UNION SELECT book_id, block_ord, s FROM held WHERE s BETWEEN 0 AND n UNION SELECT book_id, block_ord, e FROM held WHERE e BETWEEN 0 AND n
), cut AS (SELECT book_id, block_ord, x AS s, lead(x) OVER w AS e, row_number() OVER w - 1 AS ix FROM edges WINDOW w AS (PARTITION BY book_id, block_ord ORDER BY x))
SELECT c.book_id, c.block_ord, c.ix, c.s::BIGINT AS s, c.e::BIGINT AS e, coalesce(string_agg(m.id, ',' ORDER BY m.s, m.e, m.id), '') AS ids
FROM cut c LEFT JOIN held m ON m.book_id = c.book_id AND m.block_ord = c.block_ord AND m.s <= c.s AND c.e <= m.e WHERE c.e IS NOT NULL GROUP BY c.book_id, c.block_ord, c.ix, c.s, c.e
""")
def render_pieces(spark, sf):
    return views.render_pieces(_lines(spark, sf), _marks(spark, sf))


@query(f"""
WITH {LINES}, w AS (SELECT *, len(regexp_extract_all(text, '\\p{{L}}+')) AS l, {WORDS} AS t FROM lines),
p AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY book_id ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(t) OVER (PARTITION BY book_id) AS total FROM w)
SELECT book_id, block_ord, before, round(CASE WHEN total > 0 THEN before * 100.0 / total ELSE 0 END, 4)::DOUBLE AS percent, floor(greatest(total - before, 0) / 150 + 0.5)::BIGINT AS minutes_left FROM p
""")
def word_prefix_progress(spark, sf):
    return views.progress(_lines(spark, sf)).drop("chapter_ord").withColumn("percent", F.col("percent").cast("double"))


@query(f"""
WITH {LINES}, a AS (SELECT book_id, block_ord, regexp_replace(trim(text, ' '), '\\s+', ' ', 'g') AS key FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY block_ord) AS k FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY block_ord) AS k FROM a WHERE block_ord % 3 <> 1)
SELECT n.book_id, n.block_ord, b.block_ord AS other_ord FROM n JOIN b USING (book_id, key, k)
""")
def align_blocks(spark, sf):
    rows = _lines(spark, sf)
    return views.aligned(rows, rows.filter("block_ord % 3 <> 1"))


@query(f"""
WITH {SCRIPT} SELECT book_id, count(*) AS reference, count(*) AS found, count_if(kind < 2 AND block_ord % 5 > 0)::BIGINT AS correct, count_if(kind < 2 AND block_ord % 5 = 0)::BIGINT AS wrong, count_if(kind = 2)::BIGINT AS unattributed, count_if(kind = 2)::BIGINT AS queued, count_if(kind < 2 AND block_ord % 5 = 0)::BIGINT AS silent_wrong FROM script GROUP BY book_id
""")
def compare_speakers(spark, sf):
    rows = _script(spark, sf)
    spans = speech.speech_spans(rows)
    truth = spans.join(rows.select("book_id", "block_ord", F.when(F.col("block_ord") % 5 == 0, "somebody").otherwise(F.lower("who")).alias("speaker")), ["book_id", "block_ord"])
    return views.compared(truth, attribution.explicit(rows, spans))


@query("""
SELECT toxic, quality, count(*) AS n, count_if(n_chars > 1500)::BIGINT AS long_texts FROM labels JOIN documents USING (doc_id) GROUP BY toxic, quality
""")
def label_confusion(spark, sf):
    rows = table(spark, sf, "labels").join(_documents(spark, sf), "doc_id")
    return rows.groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1500).alias("long_texts"))


# journal ------------------------------------------------------------------------------------------------------------

COMMANDS = "CASE event_id % 4 WHEN 0 THEN 'setSpeaker' WHEN 1 THEN 'setNote' WHEN 2 THEN 'setEmphasisColor' ELSE 'addMark' END"


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    edit = F.element_at(F.array(*[F.lit(x) for x in ("setSpeaker", "setNote", "setEmphasisColor", "addMark")]), (k % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("book_id"), k.alias("seq"), edit.alias("edit"), F.concat(F.lit("a"), k % 17).alias("target"), F.col("event_type").alias("value"))


@query(f"""
WITH j AS (SELECT user_id AS book_id, event_id AS seq, {COMMANDS} AS edit, 'a' || event_id % 17 AS target, event_type AS value FROM events),
p AS (SELECT *, CASE edit WHEN 'setSpeaker' THEN 'speaker' WHEN 'setNote' THEN 'note' WHEN 'setEmphasisColor' THEN 'color' ELSE 'exists' END AS property FROM j)
SELECT book_id, target, property, max(seq) AS seq, arg_max(edit, seq) AS edit, arg_max(value, seq) AS value, count(*) AS n_edits FROM p GROUP BY book_id, target, property
""")
def journal_version(spark, sf):
    return edits.version(_journal(spark, sf))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_decision(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("""
SELECT event_id AS book_id, CASE WHEN event_id % 3 <> 0 THEN 'file' WHEN event_id % 5 = event_id % 7 THEN 'resume' ELSE 'conflict' END AS decision FROM events
""")
def decide_open(spark, sf):
    k = F.col("event_id")
    return edits.opening(table(spark, sf, "events").select(k.alias("book_id"), (k % 3 == 0).alias("dirty"), (k % 5).alias("own_sha"), (k % 7).alias("file_sha")))


@query("""
WITH r AS (SELECT event_id, 'f' || event_id % 4 AS speaker, (event_id % 10) / 10.0::DOUBLE AS conf, CASE WHEN event_id % 9 = 0 THEN 'user' ELSE 'alternation' END AS via, 'f' || event_id % 3 AS suggested, (event_id % 20) / 20.0::DOUBLE AS confidence FROM events),
d AS (SELECT *, CASE WHEN via = 'user' THEN 'kept' WHEN speaker = suggested THEN 'confirmed' WHEN conf < 0.9 AND confidence >= conf + 0.15 THEN 'changed' WHEN confidence >= 0.7 THEN 'queued' ELSE 'noted' END AS decision FROM r)
SELECT event_id, decision, CASE decision WHEN 'changed' THEN suggested ELSE speaker END AS new_speaker FROM d
""")
def suggestion_merge(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("f"), k % 4).alias("speaker"), ((k % 10) / 10.0).alias("conf"), F.when(k % 9 == 0, "user").otherwise("alternation").alias("via"), F.concat(F.lit("f"), k % 3).alias("suggested"), ((k % 20) / 20.0).alias("confidence"))
    return edits.suggested(rows).select("event_id", "decision", "new_speaker")


@query("""
WITH a AS (SELECT doc_id % 90 AS book_id, 'a' || doc_id % 400 AS id, CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE 'b' || doc_id % 2 END AS block_id, doc_id % 13 AS s, doc_id % 11 AS e, CASE WHEN doc_id % 5 > 0 THEN 'f' || doc_id % 5 END AS speaker FROM documents),
b AS (SELECT DISTINCT doc_id % 90 AS book_id, 'b' || doc_id % 2 AS block_id FROM documents), n AS (SELECT book_id, block_id FROM b UNION ALL SELECT book_id, block_id FROM b WHERE book_id % 9 = 0)
SELECT book_id, 'unknown block' AS rule, id AS detail FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.book_id = a.book_id AND b.block_id = a.block_id)
UNION ALL SELECT a.book_id, 'range', id FROM a JOIN n ON n.book_id = a.book_id AND n.block_id = a.block_id WHERE e < s OR e > 8
UNION ALL SELECT book_id, 'annotation twice', id FROM a GROUP BY book_id, id HAVING count(*) > 1
UNION ALL SELECT book_id, 'block twice', block_id FROM n GROUP BY book_id, block_id HAVING count(*) > 1
UNION ALL SELECT book_id, 'unknown speaker', id FROM a WHERE speaker IN ('f3', 'f4')
""")
def validate_refs(spark, sf):
    k = F.col("doc_id")
    docs = _documents(spark, sf).withColumn("book_id", k % 90)
    own = F.concat(F.lit("b"), k % 2)
    marks = docs.select("book_id", F.concat(F.lit("a"), k % 400).alias("id"), F.when(k % 7 == 0, "gone").otherwise(own).alias("block_id"), (k % 13).alias("s"), (k % 11).alias("e"), F.when(k % 5 > 0, F.concat(F.lit("f"), k % 5)).alias("speaker"))
    blocks = docs.select("book_id", own.alias("block_id"), F.lit(8).cast("long").alias("n")).distinct()
    cast = docs.select("book_id", F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("speaker")).distinct()
    return edits.violations(marks, blocks.unionByName(blocks.filter("book_id % 9 = 0")), cast)


# jobs ---------------------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, sum(ceil(length(text) / 3))::BIGINT AS tokens, round(sum(ceil(length(text) / 3)) * 2.5 / 1e6, 6)::DOUBLE AS cost FROM documents GROUP BY lang")
def cost_estimate(spark, sf):
    return jobs.costs(_documents(spark, sf), "lang", 2.5).withColumn("cost", F.col("cost").cast("double"))


@query("""
WITH RECURSIVE m AS (SELECT DISTINCT p_partkey AS from_id, p_partkey // 2 AS to_id FROM part WHERE p_partkey % 16 <> 0), w AS (
  SELECT from_id, to_id AS last FROM m UNION ALL SELECT w.from_id, m.to_id FROM w JOIN m ON m.from_id = w.last
) SELECT from_id, min(last) AS last FROM w GROUP BY from_id
""")
def merge_chain(spark, sf):
    rows = table(spark, sf, "part").filter("p_partkey % 16 <> 0").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).alias("to_id")).distinct()
    return jobs.resolved(rows, 64)


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_pace(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query(f"""
{NAMED} SELECT book_id, speaker, block_ord, coalesce(lead(block_ord) OVER w, -1) AS next_block, coalesce(lag(block_ord) OVER w, -1) AS previous_block FROM named WINDOW w AS (PARTITION BY book_id, speaker ORDER BY chapter_ord, block_ord)
""")
def speech_steps(spark, sf):
    return views.speech_steps(_named(spark, sf).withColumn("s", F.lit(0).cast("long"))).select("book_id", "speaker", "block_ord", F.coalesce("next_block", F.lit(-1)).alias("next_block"), F.coalesce("previous_block", F.lit(-1)).alias("previous_block"))


def _review_context(rows: DataFrame) -> DataFrame:
    queue = rows.filter("kind = 2").select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("block_ord")).cast("long").alias("place"), "block_ord")
    return views.review_context(queue, rows)


@query(f"""
WITH {SCRIPT}, q AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) AS place, block_ord FROM script WHERE kind = 2)
SELECT q.book_id, q.place, s.block_ord, s.text FROM q JOIN script s ON s.book_id = q.book_id AND s.block_ord BETWEEN q.block_ord - 2 AND q.block_ord + 1
""")
def review_context(spark, sf):
    return _review_context(_script(spark, sf))


@query(f"""
WITH {SCRIPT}, q AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) AS place, block_ord FROM script WHERE kind = 2)
SELECT q.book_id, q.place, s.block_ord, s.text FROM q JOIN script s ON s.book_id = q.book_id AND s.block_ord BETWEEN q.block_ord - 2 AND q.block_ord + 1
""")
def review_context_all(spark, sf):
    """The context with whole utterances."""
    return _review_context(_script(spark, sf))


@query("SELECT book_id, seq FROM (SELECT user_id AS book_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def journal_history(spark, sf):
    return edits.history(_journal(spark, sf), 20).select("book_id", "seq")


@query("""
WITH p AS (SELECT vec_id, [[(i * 10)::DOUBLE, (5 + (vec_id % 4) * i * i * 0.4)::DOUBLE] FOR i IN range(0, 8)] AS q FROM embeddings),
lo AS (SELECT vec_id, q, list_min([x[2] FOR x IN q]) AS y0, list_max([x[2] FOR x IN q]) AS y1 FROM p), sc AS (SELECT *, CASE WHEN y1 > y0 THEN 1000 / (y1 - y0) ELSE 1 END::DOUBLE AS f FROM lo)
SELECT vec_id AS id, 'M' || array_to_string([round(x[1] * f)::INT || ' ' || round((x[2] - y0) * f)::INT FOR x IN q], 'L') AS path, vec_id % 4 < 2 AS strike FROM sc
""")
def ink_paths(spark, sf):
    """Strokes of four curvatures, quantised and drawn; only the two flat kinds strike out."""
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i * 10.0).cast("double").alias("x"), (F.lit(5.0) + (F.col("vec_id") % 4) * i * i * 0.4).cast("double").alias("y")))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), points.alias("points"))
    return rows.select("id", ink.svg_path(ink.quantised(F.col("points"))).alias("path"), ink.is_strike(F.col("points")).alias("strike"))


@query()
def ink_simplify(spark, sf):
    """The components of each vector as a stroke, simplified."""
    points = F.transform("embedding", lambda v, i: F.struct(i.cast("double").alias("x"), (v * 100).cast("double").alias("y")))
    rows = ink.simplified(table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), points.alias("points")), 5.0)
    return rows.select("id", F.size("points").cast("long").alias("n"))
