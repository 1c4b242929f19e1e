"""Queries of the operators on pages, pieces of text, ordered folds and versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellichor.catalogue import LINES, _documents, _lines, query
from vellichor.operators import ordered, rebase, render, undo
from vellichor.session import staged, table
from vellichor.sources import epub, pdf_items
from vellichor.streaming import timer

# pages --------------------------------------------------------------------------------------------------------------

# Documents set on pages: eight words a line, thirty lines a page, paragraphs of five kinds, two running heads, a foot.
TYPESET = """
set_lines AS (
  SELECT doc_id, p, k, n_of, list_aggregate(ws[8 * k + 1:8 * k + 8], 'string_agg', ' ') AS str, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS n
  FROM (SELECT doc_id, p, ws, (len(ws) + 7) // 8 AS n_of, unnest(range(0, (len(ws) + 7) // 8)) AS k FROM (
    SELECT doc_id, i - 1 AS p, list_filter(string_split(x, ' '), lambda w: trim(w) <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)))
), placed AS (
  SELECT doc_id, n // 30 AS page, n, str || CASE WHEN n % 11 = 5 AND k < n_of - 1 THEN '-' ELSE '' END AS str, 50 + CASE WHEN p % 5 = 1 THEN 60 WHEN p % 5 = 2 AND k = 0 THEN 12 ELSE 0 END::DOUBLE AS x,
    700 - 15.0 * (n % 30) - CASE WHEN p % 5 = 3 THEN 10 ELSE 0 END AS y, CASE WHEN p % 5 = 0 AND n_of = 1 THEN 14 ELSE 10 END::DOUBLE AS size FROM set_lines
), heads AS (SELECT doc_id, page, unnest(['Band ' || doc_id || ', Blatt ' || page, '- ' || (page + 1) || ' -', 'Ende ' || doc_id]) AS str, unnest([760.0, 740.0, 200.0]) AS y, unnest([-2, -1, 1000000000]) AS n FROM (SELECT DISTINCT doc_id, page FROM placed)),
items AS (
  SELECT doc_id, page, n, trim(regexp_replace(str, '\\s+', ' ', 'g')) AS text, x AS x0, x + 5.0 * length(str) AS x1, y::DOUBLE AS y, size FROM placed
  UNION ALL SELECT doc_id, page, n, str, 50.0, 50 + 5.0 * length(str), y::DOUBLE, 8.0 FROM heads
)"""


def _typeset(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every document's pages; the first line of a page brings its heads and foot."""
    # Paragraphs as (p, words), then lines as (p, k, n_of, str); the place in the array is the line's number.
    paras = F.transform(F.split("text", "\n"), lambda x, p: F.struct(p.alias("p"), F.filter(F.split(x, " "), lambda w: F.trim(w) != "").alias("ws")))
    of_para = lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x.ws) / 8).cast("int") - 1), lambda k: F.struct(x.p.alias("p"), k.alias("k"), F.ceil(F.size(x.ws) / 8).cast("int").alias("n_of"), F.array_join(F.slice(x.ws, k * 8 + 1, 8), " ").alias("str")))
    set_lines = F.flatten(F.transform(F.filter(paras, lambda x: F.size(x.ws) > 0), of_para))
    rows = _documents(spark, sf).select("doc_id", F.posexplode(set_lines).alias("n", "x")).select("doc_id", "n", "x.*", F.floor(F.col("n") / 30).alias("page"))
    x = 50.0 + F.when(F.col("p") % 5 == 1, 60).when((F.col("p") % 5 == 2) & (F.col("k") == 0), 12).otherwise(0)
    y = 700 - 15.0 * (F.col("n") % 30) - F.when(F.col("p") % 5 == 3, 10).otherwise(0)
    item = lambda text, x, y, size: F.struct(text.alias("str"), x.cast("double").alias("x"), y.cast("double").alias("y"), (5.0 * F.length(text)).alias("width"), size.cast("double").alias("size"))
    line = item(F.concat("str", F.when((F.col("n") % 11 == 5) & (F.col("k") < F.col("n_of") - 1), "-").otherwise("")), x, y, F.when((F.col("p") % 5 == 0) & (F.col("n_of") == 1), 14.0).otherwise(10.0))
    doc, page = F.col("doc_id").cast("string"), F.col("page").cast("string")
    heads = [(F.concat(F.lit("Band "), doc, F.lit(", Blatt "), page), 760), (F.concat(F.lit("- "), (F.col("page") + 1).cast("string"), F.lit(" -")), 740), (F.concat(F.lit("Ende "), doc), 200)]
    items = F.when(F.col("n") % 30 == 0, F.array(line, *(item(text, F.lit(50.0), F.lit(at), F.lit(8.0)) for text, at in heads))).otherwise(F.array(line))
    return rows.select("doc_id", "page", F.inline(items))


@query(f"""
WITH {TYPESET}, keyed AS (
  SELECT *, lower(regexp_replace(text, '\\d+', '#', 'g')) AS key, regexp_full_match(text, '(?i)\\s*[-–—\\[(]?\\s*(?:seite\\s+|page\\s+)?(?:\\d{{1,4}}|[ivxlcdm]{{1,7}})\\s*[-–—\\])]?\\s*') AS number FROM items
), ends AS (SELECT doc_id, page, arg_min(key, n) AS top, arg_max(key, n) AS bottom FROM keyed GROUP BY doc_id, page),
pages AS (SELECT doc_id, greatest(3, count(*) // 4) AS many FROM ends GROUP BY doc_id),
tops AS (SELECT e.doc_id, top AS key FROM ends e JOIN pages USING (doc_id) GROUP BY e.doc_id, top, many HAVING count(*) >= many),
bottoms AS (SELECT e.doc_id, bottom AS key FROM ends e JOIN pages USING (doc_id) GROUP BY e.doc_id, bottom, many HAVING count(*) >= many),
runs AS (
  SELECT k.*, bool_and(number OR t.key IS NOT NULL) OVER (PARTITION BY k.doc_id, page ORDER BY n) AS from_top, bool_and(number OR b.key IS NOT NULL) OVER (PARTITION BY k.doc_id, page ORDER BY n DESC) AS from_bottom
  FROM keyed k LEFT JOIN tops t ON t.doc_id = k.doc_id AND t.key = k.key LEFT JOIN bottoms b ON b.doc_id = k.doc_id AND b.key = k.key
), body AS (SELECT doc_id, page, n, text, x0, x1, y, size FROM runs WHERE NOT from_top AND NOT from_bottom),
sizes AS (
  SELECT doc_id, v AS body FROM (SELECT doc_id, round(size * 2) / 2 AS v, row_number() OVER (PARTITION BY doc_id ORDER BY round(size * 2) / 2) AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM body WHERE length(text) > 20) WHERE i = c // 2 + 1
), sized AS (SELECT b.*, coalesce(s.body, 10) AS body, abs(size - coalesce(s.body, 10)) < coalesce(s.body, 10) * 0.15 AS usual FROM body b LEFT JOIN sizes s USING (doc_id)),
margins AS (SELECT doc_id, start AS margin FROM (SELECT doc_id, round(x0) AS start, count(*) AS c FROM sized WHERE usual GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, start) = 1),
widths AS (
  SELECT doc_id, v AS width FROM (SELECT doc_id, x1 - margin AS v, row_number() OVER (PARTITION BY doc_id ORDER BY x1 - margin) AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM sized JOIN margins USING (doc_id) WHERE usual AND length(text) > 20) WHERE i = c // 2 + 1
), steps AS (SELECT doc_id, body, lag(y) OVER (PARTITION BY doc_id, page ORDER BY n) - y AS v FROM sized),
gaps AS (
  SELECT doc_id, v AS gap FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM steps WHERE v > 0 AND v < body * 3) WHERE i = c // 2 + 1
), measured AS (
  SELECT s.*, coalesce(m.margin, 0) AS margin, coalesce(w.width, 400) AS width, coalesce(g.gap, s.body * 1.2) AS gap FROM sized s LEFT JOIN margins m USING (doc_id) LEFT JOIN widths w USING (doc_id) LEFT JOIN gaps g USING (doc_id)
), kinds AS (
  SELECT *, size >= body * 1.2 AS heading, size >= body * 1.2 OR (x0 - margin > body * 2 AND abs((x0 - margin) - (margin + width - x1)) < body * 3) AS alone, x1 - margin < width * 0.72 AND regexp_matches(text, '[.!?…:»«"''”“]\\s*$') AS short FROM measured
), lagged AS (
  SELECT *, lag(heading) OVER w AS heading0, lag(alone) OVER w AS alone0, lag(short) OVER w AS short0, lag(page) OVER w = page AND lag(y) OVER w - y > gap * 1.6 AS far FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY page, n)
), opened AS (
  SELECT *, sum(CASE WHEN alone0 IS NULL OR (NOT (alone AND alone0 AND heading = heading0 AND NOT far) AND (alone OR alone0 OR far OR (x0 - margin > body * 0.8 AND NOT alone) OR short0)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, n) AS para FROM lagged
)
SELECT doc_id, para::BIGINT AS para, replace(regexp_replace(string_agg(text, chr(10) ORDER BY page, n), '(\\p{{L}})[-­‐‑]\\n(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ') AS text, CASE WHEN arg_min(heading, (page, n)) THEN 'h2' ELSE 'p' END AS type, min(page)::BIGINT AS page FROM opened GROUP BY doc_id, para
""")
def pdf_paragraphs(spark, sf):
    """Documents set on pages with running heads, headings, centred lines, indents and gaps, and read back."""
    return pdf_items.paragraphs(pdf_items.without_running_heads(pdf_items.lines(_typeset(spark, sf))))


# EPUB files ---------------------------------------------------------------------------------------------------------


def _bound(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): every document as an EPUB, five lines a chapter; of three chapters the first has a heading, the second a title in the contents, and of four books one has no title."""
    from html import escape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, lang, lines in zip(*(batch.column(c).to_pylist() for c in ("book_id", "lang", "lines"))):
                parts = [lines[i : i + 5] for i in range(0, len(lines), 5)]
                bodies = [(f"Inhalt {k + 1}" if k % 3 == 1 else None, f"<h1>Teil {k + 1}</h1>" * (k % 3 == 0) + "".join(f"<p>{escape(x)}</p>" for x in part)) for k, part in enumerate(parts)]
                content = epub.packed(f"Band {doc}" if doc % 4 else None, lang, bodies)
                yield pa.RecordBatch.from_arrays([pa.array([f"books/doc-{doc}.epub"]), pa.array([content], pa.binary())], names=["path", "content"])

    lines = _lines(spark, sf).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda x: x.text).alias("lines"))
    return lines.join(_documents(spark, sf).select(F.col("doc_id").alias("book_id"), "lang"), "book_id").mapInArrow(run, "path string, content binary")


@query(f"""
WITH {LINES}, kept AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) - 1 AS r, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM lines),
parts AS (SELECT book_id, r // 5 AS k, count(*) AS n_blocks, sum(n) AS n_chars FROM kept GROUP BY book_id, r // 5)
SELECT 'books/doc-' || p.book_id || '.epub' AS path, CASE WHEN p.book_id % 4 > 0 THEN 'Band ' || p.book_id ELSE 'doc-' || p.book_id END AS book, d.lang AS language, (k + 2)::BIGINT AS place, 'ch' || lpad((k + 2)::VARCHAR, 3, '0') AS id,
  CASE k % 3 WHEN 0 THEN 'Teil ' || (k + 1) WHEN 1 THEN 'Inhalt ' || (k + 1) ELSE 'Kapitel ' || (k + 2) END AS title, (n_blocks + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_blocks, (p.n_chars + CASE WHEN k % 3 = 0 THEN length('Teil ' || (k + 1)) ELSE 0 END)::BIGINT AS n_chars
FROM parts p JOIN documents d ON d.doc_id = p.book_id
""")
def epub_chapters(spark, sf):
    """Every document bound as an EPUB and read again: metadata, spine, contents and blocks."""
    found = staged(epub.opened(_bound(spark, sf)))
    books = epub.metadata(found).select("path", F.col("title").alias("book"), "language")
    return epub.chapters(epub.blocks(found)).join(books, "path").select("path", "book", "language", "place", "id", "title", "n_blocks", "n_chars")


# pieces of text -----------------------------------------------------------------------------------------------------

KIND_NAMES = "['speech', 'quote', 'emphasis', 'retake', 'note', 'bookmark', 'pause', 'breath']"
ANNOTATED = f"""
blocks AS (SELECT book_id, block_ord, text, length(text) AS n, CASE WHEN length(text) >= 5 THEN [(0, length(text) * 2 // 5), (length(text) * 2 // 5 + 1, length(text))] ELSE [] END AS ss FROM lines WHERE block_ord < 6),
notes AS (
  SELECT event_id % 300 AS book_id, event_id % 6 AS block_ord, 'a' || event_id AS id, event_id AS ord, {KIND_NAMES}[(event_id * 7 // 6) % 8 + 1] AS type, (event_id * 13) % 90 - 3 AS s, (event_id * 13) % 90 - 3 + event_id % 70 AS e,
    (event_id * 11) % 100 AS spot, CASE WHEN event_id % 4 < 3 THEN event_type END AS speaker, (event_id % 10) / 10.0 AS confidence, CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'rule' END AS origin, event_id % 8 AS color, event_type AS note, CASE WHEN event_id % 2 = 0 THEN 'long' END AS length FROM events
), styles AS (SELECT event_id % 300 AS book_id, event_id % 6 AS block_ord, CASE WHEN event_id % 2 = 0 THEN 'em' ELSE 'strong' END AS kind, (event_id * 5) % 80 AS s, (event_id * 5) % 80 + event_id % 25 AS e FROM events WHERE event_id % 9 = 0)"""


def _annotated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, annotations, formats, cast) of the first lines of documents, with every event as an annotation."""
    n = F.length("text").cast("long")
    sentence = lambda a, z: F.struct(a.cast("long").alias("s"), z.cast("long").alias("e"))
    cut = F.floor(n * 2 / 5)
    blocks = _lines(spark, sf).filter("block_ord < 6").withColumn("sentences", F.when(n >= 5, F.array(sentence(F.lit(0), cut), sentence(cut + 1, n))))
    k = F.col("event_id")
    kinds = F.array(*[F.lit(x) for x in ("speech", "quote", "emphasis", "retake", "note", "bookmark", "pause", "breath")])
    events = table(spark, sf, "events")
    s = (k * 13) % 90 - 3
    notes = events.select(
        (k % 300).alias("book_id"), (k % 6).alias("block_ord"), F.concat(F.lit("a"), k).alias("id"), k.alias("ord"), F.get(kinds, (F.floor(k * 7 / 6) % 8).cast("int")).alias("type"), s.alias("s"), (s + k % 70).alias("e"), ((k * 11) % 100).alias("at"),
        F.when(k % 4 < 3, F.col("event_type")).alias("speaker"), ((k % 10) / 10).alias("confidence"), F.when(k % 5 == 0, "user").otherwise("rule").alias("origin"), (k % 8).alias("color"), F.col("event_type").alias("note"), F.when(k % 2 == 0, "long").alias("length"),
    )
    formats = events.filter(k % 9 == 0).select((k % 300).alias("book_id"), (k % 6).alias("block_ord"), F.when(k % 2 == 0, "em").otherwise("strong").alias("kind"), ((k * 5) % 80).alias("s"), ((k * 5) % 80 + k % 25).alias("e"))
    cast = events.filter("event_type <> 'view'").select((k % 300).alias("book_id"), F.col("event_type").alias("speaker")).distinct().withColumn("badge", F.upper(F.substring("speaker", 1, 2)))
    return blocks, notes, formats, cast


@query(f"""
WITH {LINES}, {ANNOTATED}, ranged AS (SELECT a.*, least(greatest(s, 0), n) AS a, least(greatest(e, 0), n) AS z FROM notes a JOIN blocks USING (book_id, block_ord) WHERE type NOT IN ('pause', 'breath')),
points AS (SELECT a.* FROM notes a JOIN blocks USING (book_id, block_ord) WHERE type IN ('pause', 'breath') AND spot <= n),
formats AS (SELECT f.*, least(greatest(s, 0), n) AS a, least(greatest(e, 0), n) AS z FROM styles f JOIN blocks USING (book_id, block_ord)),
cuts AS (
  SELECT book_id, block_ord, a AS pos FROM ranged UNION SELECT book_id, block_ord, z FROM ranged UNION SELECT book_id, block_ord, a FROM formats UNION SELECT book_id, block_ord, z FROM formats UNION SELECT book_id, block_ord, spot FROM points
  UNION SELECT book_id, block_ord, 0 FROM blocks UNION SELECT book_id, block_ord, n FROM blocks UNION SELECT book_id, block_ord, n * 2 // 5 FROM blocks WHERE n >= 5 UNION SELECT book_id, block_ord, n * 2 // 5 + 1 FROM blocks WHERE n >= 5
), segs AS (
  SELECT book_id, block_ord, 0 AS seg, CASE WHEN n >= 5 THEN 0 END AS sentence, 0 AS a, CASE WHEN n >= 5 THEN n * 2 // 5 ELSE n END AS z FROM blocks
  UNION ALL SELECT book_id, block_ord, 1, NULL, n * 2 // 5, n * 2 // 5 + 1 FROM blocks WHERE n >= 5 UNION ALL SELECT book_id, block_ord, 2, 1, n * 2 // 5 + 1, n FROM blocks WHERE n >= 5
), counted AS (SELECT s.*, CASE WHEN sentence IS NULL THEN 0 ELSE len(regexp_extract_all(substr(text, a + 1, z - a), '\\p{{L}}+')) END AS words FROM segs s JOIN blocks USING (book_id, block_ord)),
pieces AS (SELECT *, lead(pos) OVER (PARTITION BY book_id, block_ord ORDER BY pos) AS next FROM cuts),
placed AS (SELECT p.*, s.seg, s.sentence, s.z AS seg_end, s.words, substr(text, pos + 1, next - pos) AS text FROM pieces p JOIN counted s ON s.book_id = p.book_id AND s.block_ord = p.block_ord AND s.a <= pos AND pos < s.z JOIN blocks b ON b.book_id = p.book_id AND b.block_ord = p.block_ord WHERE next IS NOT NULL),
covers AS (
  SELECT p.book_id, p.block_ord, p.pos, max(ord) FILTER (WHERE type = 'speech') AS speech, max(ord) FILTER (WHERE type = 'emphasis') AS emphasis, bool_or(type = 'quote') AS quote, bool_or(type = 'retake') AS retake, bool_or(type = 'note') AS note, bool_or(type = 'bookmark') AS bookmark
  FROM placed p JOIN ranged r ON r.book_id = p.book_id AND r.block_ord = p.block_ord AND r.a <= p.pos AND p.next <= r.z GROUP BY ALL
), styled AS (SELECT p.book_id, p.block_ord, p.pos, bool_or(kind = 'em') AS italic, bool_or(kind = 'strong') AS bold FROM placed p JOIN formats r ON r.book_id = p.book_id AND r.block_ord = p.block_ord AND r.a <= p.pos AND p.next <= r.z GROUP BY ALL),
texts AS (
  SELECT p.book_id, p.block_ord, p.seg, p.sentence, p.words, 'text' AS kind, p.pos AS s, p.next AS e, CASE WHEN p.sentence IS NOT NULL AND p.next = p.seg_end THEN regexp_replace(p.text, '\\.([«»“”‘’‹›"'')\\]}}]*\\s*)$', '\\1') ELSE p.text END AS text,
    a.id, a.speaker, CASE WHEN a.id IS NOT NULL THEN a.origin <> 'user' AND (a.speaker IS NULL OR a.confidence < 0.5) END AS weak, CASE WHEN a.id IS NOT NULL THEN a.origin = 'user' END AS "user",
    CASE WHEN a.id IS NOT NULL AND least(greatest(a.s, 0), b.n) = p.pos THEN CASE WHEN a.speaker <> 'view' AND EXISTS (SELECT 1 FROM events v WHERE v.event_id % 300 = p.book_id AND v.event_type = a.speaker) THEN upper(substr(a.speaker, 1, 2)) ELSE '?' END END AS badge,
    coalesce(c.quote, FALSE) AS quote, c.emphasis IS NOT NULL AS emphasis, CASE WHEN m.color < 6 THEN m.color END AS pen, coalesce(c.retake, FALSE) AS retake, coalesce(c.note, FALSE) AS note, coalesce(c.bookmark, FALSE) AS bookmark, coalesce(f.italic, FALSE) AS italic, coalesce(f.bold, FALSE) AS bold, NULL AS mark, NULL::BOOLEAN AS long, 1 AS rank, NULL AS ord
  FROM placed p JOIN blocks b ON b.book_id = p.book_id AND b.block_ord = p.block_ord LEFT JOIN covers c ON c.book_id = p.book_id AND c.block_ord = p.block_ord AND c.pos = p.pos LEFT JOIN styled f ON f.book_id = p.book_id AND f.block_ord = p.block_ord AND f.pos = p.pos
  LEFT JOIN notes a ON a.ord = c.speech LEFT JOIN notes m ON m.ord = c.emphasis
), dots AS (
  SELECT p.book_id, p.block_ord, arg_min(s.seg, s.seg) AS seg, arg_min((s.sentence,), s.seg)[1] AS sentence, arg_min(s.words, s.seg) AS words, 'point' AS kind, p.spot AS s, p.spot AS e, NULL AS text, p.id, NULL AS speaker, NULL::BOOLEAN AS weak, NULL::BOOLEAN AS "user", NULL AS badge,
    NULL::BOOLEAN AS quote, NULL::BOOLEAN AS emphasis, NULL AS pen, NULL::BOOLEAN AS retake, NULL::BOOLEAN AS note, NULL::BOOLEAN AS bookmark, NULL::BOOLEAN AS italic, NULL::BOOLEAN AS bold, p.type AS mark, p.type = 'pause' AND coalesce(p.length, '') = 'long' AS long, 0 AS rank, p.ord
  FROM points p JOIN counted s ON s.book_id = p.book_id AND s.block_ord = p.block_ord AND s.a <= p.spot AND p.spot <= s.z GROUP BY p.book_id, p.block_ord, p.spot, p.id, p.type, p.length, p.ord
), begins AS (
  SELECT p.book_id, p.block_ord, p.seg, p.sentence, p.words, 'start' AS kind, p.pos AS s, p.pos AS e, CASE WHEN r.type <> 'bookmark' THEN r.note END AS text, r.id, NULL AS speaker, NULL::BOOLEAN AS weak, NULL::BOOLEAN AS "user", NULL AS badge,
    NULL::BOOLEAN AS quote, NULL::BOOLEAN AS emphasis, NULL AS pen, NULL::BOOLEAN AS retake, NULL::BOOLEAN AS note, NULL::BOOLEAN AS bookmark, NULL::BOOLEAN AS italic, NULL::BOOLEAN AS bold, r.type AS mark, NULL::BOOLEAN AS long, 2 AS rank, r.ord
  FROM ranged r JOIN placed p ON r.book_id = p.book_id AND r.block_ord = p.block_ord AND r.a = p.pos WHERE r.a < r.z AND r.type IN ('retake', 'note', 'bookmark')
), rows AS (SELECT * FROM texts UNION ALL SELECT * FROM dots UNION ALL SELECT * FROM begins)
SELECT book_id, block_ord, seg::BIGINT AS seg, sentence::BIGINT AS sentence, words::BIGINT AS words, kind, s::BIGINT AS s, e::BIGINT AS e, text, id, speaker, weak, "user", badge, quote, emphasis, pen, retake, note, bookmark, italic, bold, mark, long,
  row_number() OVER (PARTITION BY book_id, block_ord ORDER BY seg, s, rank, ord) - 1 AS ix FROM rows
""")
def render_blocks(spark, sf):
    """The first blocks of every document as they are shown, with sentences, points, formats, speech, pens and marks."""
    return render.rendered(*_annotated(spark, sf))


@query(f"""
WITH {LINES}, {ANNOTATED}, hits AS (SELECT book_id, block_ord, unnest([n // 2, n // 3, 0]) AS "offset" FROM blocks)
SELECT DISTINCT h.book_id, h.block_ord, h.offset::BIGINT AS "offset", a.id FROM hits h JOIN notes a ON a.book_id = h.book_id AND a.block_ord = h.block_ord AND a.s <= h.offset AND h.offset < greatest(a.e, a.s + 1) WHERE a.type NOT IN ('pause', 'breath')
""")
def annotations_at(spark, sf):
    """Which annotations cover three places of each block."""
    blocks, notes, _, _ = _annotated(spark, sf)
    n = F.length("text").cast("long")
    hits = blocks.select("book_id", "block_ord", F.explode(F.array(F.floor(n / 2), F.floor(n / 3), F.lit(0).cast("long"))).alias("offset"))
    return render.covering(notes, hits)


# ordered folds ------------------------------------------------------------------------------------------------------

PACKED = f"""WITH RECURSIVE {LINES}, o AS (SELECT book_id, block_ord, length(text) AS n, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) AS k FROM lines),
w AS (
  SELECT book_id, block_ord, k, 0 AS chunk, n AS used FROM o WHERE k = 1
  UNION ALL
  SELECT o.book_id, o.block_ord, o.k, CASE WHEN w.used + o.n > 2000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + o.n > 2000 THEN o.n ELSE w.used + o.n END FROM w JOIN o ON o.book_id = w.book_id AND o.k = w.k + 1
)"""


@query(f"{PACKED} SELECT book_id, block_ord, chunk::BIGINT AS chunk FROM w")
def chunk_pack(spark, sf):
    return ordered.chunks(_lines(spark, sf), 2000).select("book_id", "block_ord", "chunk")


@query(f"""
{PACKED}, firsts AS (SELECT book_id, chunk, min(k) AS first FROM w GROUP BY book_id, chunk)
SELECT book_id, chunk::BIGINT AS chunk, block_ord, FALSE AS context FROM w
UNION ALL SELECT f.book_id, f.chunk::BIGINT, w.block_ord, TRUE FROM firsts f JOIN w ON w.book_id = f.book_id AND w.k < f.first AND w.k >= f.first - 3
""")
def chunk_context(spark, sf):
    return ordered.with_context(ordered.chunks(_lines(spark, sf), 2000)).drop("chapter_ord")


@query("""
WITH t AS (SELECT event_type, event_id, abs(value) + 1 AS pm, (event_id * 7) % 1000 AS pt, abs(value) * 3 + 2 AS om, event_id % 370 AS ot FROM events),
l AS (SELECT event_type, list({'p': pt / (pm / 1000), 'o': ot / (om / 1000), 'w': (pt + ot)::DOUBLE} ORDER BY event_id) AS l FROM t WHERE pt <> 0 AND ot <> 0 GROUP BY event_type),
r AS (SELECT event_type, list_reduce(l, lambda a, x: {'p': (a.p * least(a.w, 200000) + x.p * x.w) / (least(a.w, 200000) + x.w), 'o': (a.o * least(a.w, 200000) + x.o * x.w) / (least(a.w, 200000) + x.w), 'w': least(a.w, 200000) + x.w}) AS r FROM l)
SELECT event_type, round(r.p, 4) AS prompt_tps, round(r.o, 4) AS output_tps, r.w AS samples FROM r
""")
def speed_profile(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_type", k.alias("seq"), (F.abs("value") + 1).alias("prompt_ms"), ((k * 7) % 1000).alias("prompt_tokens"), (F.abs("value") * 3 + 2).alias("output_ms"), (k % 370).alias("output_tokens"))
    found = ordered.speed(rows, "event_type")
    return found.withColumns({c: F.round(c, 4) for c in ("prompt_tps", "output_tps")})


# versions -----------------------------------------------------------------------------------------------------------

#: Events of a user are commands on seventeen targets, undos and redos, in turns of nine.
ACTIONS = "['edit', 'edit', 'edit', 'undo', 'redo', 'undo', 'undo', 'redo', 'undo']"
EDITS = "['setSpeaker', 'setNote', 'setEmphasisColor', 'addMark']"
REPLAYED = f"""WITH RECURSIVE j AS (
  SELECT user_id AS book_id, event_id AS seq, {ACTIONS}[(row_number() OVER w - 1) % 9 + 1] AS action, row_number() OVER w AS k, {EDITS}[event_id * 3 % 4 + 1] AS edit, 'a' || event_id % 17 AS target, event_type AS value, ts::VARCHAR AS ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), s AS (
  SELECT book_id, k, seq, action, [seq] AS undos, []::BIGINT[] AS redos FROM j WHERE k = 1
  UNION ALL
  SELECT j.book_id, j.k, j.seq, j.action, CASE j.action WHEN 'edit' THEN list_append(undos, j.seq) WHEN 'undo' THEN undos[:-2] ELSE list_append(undos, redos[-1]) END,
    CASE j.action WHEN 'edit' THEN [] WHEN 'undo' THEN list_append(redos, undos[-1]) ELSE redos[:-2] END
  FROM s JOIN j ON j.book_id = s.book_id AND j.k = s.k + 1
), named AS (
  SELECT book_id, seq AS entry, target, CASE edit WHEN 'setSpeaker' THEN 'speaker' WHEN 'setNote' THEN 'note' WHEN 'setEmphasisColor' THEN 'color' ELSE 'exists' END AS property, value FROM j WHERE action = 'edit'
  UNION ALL SELECT book_id, seq, 'book', 'modifiedAt', ts FROM j WHERE action = 'edit'
), held AS (
  SELECT s.book_id, s.k, n.target, n.property, max(n.entry) AS entry FROM (SELECT book_id, k, unnest(undos) AS entry FROM s) s JOIN named n ON n.book_id = s.book_id AND n.entry = s.entry GROUP BY ALL
), valued AS (SELECT h.*, n.value FROM held h JOIN named n ON n.book_id = h.book_id AND n.entry = h.entry AND n.target = h.target AND n.property = h.property)"""


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) % 9
    action = pick(("edit", "edit", "edit", "undo", "redo", "undo", "undo", "redo", "undo"), place)
    return table(spark, sf, "events").select(F.col("user_id").alias("book_id"), k.alias("seq"), action.alias("action"), pick(("setSpeaker", "setNote", "setEmphasisColor", "addMark"), k * 3 % 4).alias("edit"), F.concat(F.lit("a"), k % 17).alias("target"), F.col("event_type").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(REPLAYED.replace("ts::VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')") + """
, about AS (SELECT s.*, CASE s.action WHEN 'edit' THEN s.seq WHEN 'undo' THEN b.undos[-1] ELSE b.redos[-1] END AS entry FROM s LEFT JOIN s b ON b.book_id = s.book_id AND b.k = s.k - 1)
SELECT a.book_id, a.seq, a.action, a.entry, n.target, n.property, o.value AS "old", w.value AS "new"
FROM about a JOIN named n ON n.book_id = a.book_id AND n.entry = a.entry
LEFT JOIN valued o ON o.book_id = a.book_id AND o.k = a.k - 1 AND o.target = n.target AND o.property = n.property LEFT JOIN valued w ON w.book_id = a.book_id AND w.k = a.k AND w.target = n.target AND w.property = n.property
""")
def undo_changes(spark, sf):
    """What every action of the journals changed: commands, undos and redos."""
    return undo.changes(_commands(spark, sf))


@query(REPLAYED.replace("ts::VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')") + """
, a AS (SELECT user_id AS book_id, max(event_id) // 2 AS "at" FROM events GROUP BY user_id), m AS (SELECT s.book_id, max(s.k) AS k FROM s JOIN a ON a.book_id = s.book_id AND s.seq <= a."at" GROUP BY s.book_id)
SELECT v.book_id, v.target, v.property, v.value FROM valued v JOIN m ON m.book_id = v.book_id AND m.k = v.k
""")
def version_as_of(spark, sf):
    """The version of every book in the middle of its journal: the last one, led back by the changes since."""
    changed = staged(undo.changes(_commands(spark, sf)))
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("book_id")).agg(F.max("event_id").alias("at"))
    now = undo.version(undo.intervals(changed), last)
    return undo.moved(now, changed, last, last.withColumn("at", F.floor(F.col("at") / 2)))


@query(REPLAYED.replace("ts::VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')") + """
, last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY k DESC) = 1),
stacks AS (
  SELECT book_id, 'undo' AS stack, unnest(range(1, len(undos) + 1)) AS level, unnest(undos) AS entry FROM last
  UNION ALL SELECT book_id, 'redo', len(undos) + len(redos) + 1 - unnest(range(1, len(redos) + 1)), unnest(redos) FROM last
)
SELECT t.book_id, t.stack, t.level, t.entry, j.edit FROM stacks t JOIN j ON j.book_id = t.book_id AND j.seq = t.entry
""")
def undo_stacks(spark, sf):
    """What can be undone and redone at the end of every journal."""
    return undo.stacks(_commands(spark, sf))


#: Commands of each user in turns of eight kinds; what they name is an annotation or figure of the book, or the last that a command created. The other version lacks some of these and has some of what is new.
OFFLINE = """
base AS (
  SELECT user_id AS book_id, event_id AS seq, event_id % 8 AS kind, event_type AS said, event_id % 40 AS place,
    max(CASE WHEN event_id % 8 IN (0, 1) THEN event_id END) OVER w AS part, max(CASE WHEN event_id % 8 = 2 THEN event_id END) OVER w AS person FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), journal AS (
  SELECT book_id, seq, ['addMark', 'splitSpeech', 'addCast', 'setSpeaker', 'setNote', 'removeAnnotation', 'updateCast', 'setEmphasisColor'][kind + 1] AS edit,
    CASE WHEN kind IN (0, 2) THEN NULL WHEN kind = 6 THEN CASE WHEN person IS NOT NULL AND place % 3 > 0 THEN 'c' || person ELSE 'f' || place % 12 END WHEN part IS NOT NULL AND place % 5 > 1 THEN CASE WHEN part % 8 = 0 THEN 'n' ELSE 'p' END || part ELSE 'b' || place END AS target,
    CASE WHEN kind IN (1, 3) THEN CASE WHEN person IS NOT NULL AND place % 2 = 0 THEN 'c' || person ELSE 'f' || place % 12 END END AS figure,
    CASE kind WHEN 2 THEN 'Name ' || place % 9 WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE said END AS value, CASE kind WHEN 0 THEN 'n' || seq WHEN 1 THEN 'p' || seq WHEN 2 THEN 'c' || seq END AS created,
    CASE WHEN kind = 0 THEN 'note' END AS type, CASE WHEN kind = 0 THEN place % 4 END AS block_ord, CASE WHEN kind = 0 THEN place % 3 END AS s, CASE WHEN kind = 0 THEN 9 END AS e FROM base
), users AS (SELECT DISTINCT user_id AS book_id FROM events),
annotations AS (
  SELECT book_id, 'b' || i AS id, 'speech' AS type, i AS block_ord, 0 AS s, 5 AS e, NULL::VARCHAR AS value FROM users, range(0, 40) t(i) WHERE (i + book_id) % 4 <> 1
  UNION ALL SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id ELSE 'm' || event_id END, 'note', event_id % 4, event_id % 3, 9, event_type FROM events WHERE event_id % 21 = 0
), figures AS (
  SELECT book_id, 'f' || i AS speaker, 'Figure ' || i AS name FROM users, range(0, 12) t(i) WHERE (i + book_id) % 5 <> 2
  UNION ALL SELECT book_id, 'g' || i, 'NAME ' || i FROM users, range(0, 9) t(i) WHERE (i + book_id) % 6 = 0
), current_values AS (SELECT book_id, 'b' || i AS target, 'note' AS property, 'click' AS value FROM users, range(0, 40) t(i) WHERE i % 3 = 0)"""


def _offline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(journal, annotations, cast, current)."""
    events, k = table(spark, sf, "events"), F.col("event_id")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *kinds: F.max(F.when((k % 8).isin(*kinds), k)).over(before)
    base = events.select(F.col("user_id").alias("book_id"), k.alias("seq"), (k % 8).cast("int").alias("kind"), F.col("event_type").alias("said"), (k % 40).alias("place"), last(0, 1).alias("part"), last(2).alias("person"))
    named = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    kind, place, part, person = (F.col(c) for c in ("kind", "place", "part", "person"))
    figure = lambda mine: F.when(person.isNotNull() & mine, named("c", person)).otherwise(named("f", place % 12))
    on_text = F.when(part.isNotNull() & (place % 5 > 1), F.concat(F.when(part % 8 == 0, "n").otherwise("p"), part.cast("string"))).otherwise(named("b", place))
    edit = F.get(F.array(*[F.lit(x) for x in ("addMark", "splitSpeech", "addCast", "setSpeaker", "setNote", "removeAnnotation", "updateCast", "setEmphasisColor")]), kind)
    journal = base.select(
        "book_id", "seq", edit.alias("edit"), F.when(kind == 6, figure(place % 3 > 0)).when(~kind.isin(0, 2), on_text).alias("target"), F.when(kind.isin(1, 3), figure(place % 2 == 0)).alias("figure"),
        F.when(kind == 2, named("Name ", place % 9)).when(~kind.isin(1, 3, 5), F.col("said")).alias("value"), F.when(kind == 0, named("n", F.col("seq"))).when(kind == 1, named("p", F.col("seq"))).when(kind == 2, named("c", F.col("seq"))).alias("created"),
        F.when(kind == 0, "note").alias("type"), F.when(kind == 0, place % 4).alias("block_ord"), F.when(kind == 0, place % 3).alias("s"), F.when(kind == 0, F.lit(9).cast("long")).alias("e"),
    )
    users, i, book = events.select(F.col("user_id").alias("book_id")).distinct(), F.col("i"), F.col("book_id")
    numbers = lambda n: users.select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    long = lambda n: F.lit(n).cast("long")
    annotations = numbers(40).filter((i + book) % 4 != 1).select("book_id", named("b", i).alias("id"), F.lit("speech").alias("type"), i.alias("block_ord"), long(0).alias("s"), long(5).alias("e"), F.lit(None).cast("string").alias("value"))
    annotations = annotations.unionByName(events.filter(k % 21 == 0).select(F.col("user_id").alias("book_id"), F.when(k % 3 == 0, named("n", k)).otherwise(named("m", k)).alias("id"), F.lit("note").alias("type"), (k % 4).alias("block_ord"), (k % 3).alias("s"), long(9).alias("e"), F.col("event_type").alias("value")))
    cast = numbers(12).filter((i + book) % 5 != 2).select("book_id", named("f", i).alias("speaker"), named("Figure ", i).alias("name")).unionByName(numbers(9).filter((i + book) % 6 == 0).select("book_id", named("g", i).alias("speaker"), named("NAME ", i).alias("name")))
    current = numbers(40).filter(i % 3 == 0).select("book_id", named("b", i).alias("target"), F.lit("note").alias("property"), F.lit("click").alias("value"))
    return journal, annotations, cast, current


@query(f"""
WITH RECURSIVE {OFFLINE}, named AS (
  SELECT book_id, seq, edit, CASE WHEN edit = 'updateCast' THEN 'figure' ELSE 'annotation' END AS kind, target AS id FROM journal WHERE target IS NOT NULL UNION SELECT book_id, seq, edit, 'figure', figure FROM journal WHERE figure IS NOT NULL
), known AS (SELECT book_id, 'annotation' AS kind, id FROM annotations UNION SELECT book_id, 'figure', speaker FROM figures),
makers AS (SELECT book_id, CASE WHEN edit = 'addCast' THEN 'figure' ELSE 'annotation' END AS kind, created AS id, seq AS maker FROM journal WHERE created IS NOT NULL),
wants AS (SELECT n.book_id, n.seq, n.kind, m.maker FROM named n ANTI JOIN known k ON k.book_id = n.book_id AND k.kind = n.kind AND k.id = n.id LEFT JOIN makers m ON m.book_id = n.book_id AND m.kind = n.kind AND m.id = n.id WHERE n.edit <> 'removeAnnotation'),
dead(book_id, seq, reason, depth) AS (
  SELECT book_id, seq, kind, 0 FROM wants WHERE maker IS NULL UNION SELECT w.book_id, w.seq, w.kind, d.depth + 1 FROM dead d JOIN wants w ON w.book_id = d.book_id AND w.maker = d.seq
), gone AS (SELECT book_id, seq, min(reason) AS reason FROM dead GROUP BY book_id, seq),
live AS (SELECT j.* FROM journal j ANTI JOIN gone g ON g.book_id = j.book_id AND g.seq = j.seq),
places AS (SELECT book_id, id, type, block_ord, s, e, value FROM annotations UNION ALL SELECT book_id, created, type, block_ord, s, e, value FROM live WHERE edit = 'addMark'),
events_of AS (
  SELECT book_id, -1 AS seq, 'there' AS step, id, 'annotation' AS kind, [type, block_ord::VARCHAR, s::VARCHAR, e::VARCHAR, value] AS key FROM annotations UNION ALL SELECT book_id, seq, 'made', created, 'annotation', [type, block_ord::VARCHAR, s::VARCHAR, e::VARCHAR, value] FROM live WHERE edit = 'addMark'
  UNION ALL SELECT j.book_id, j.seq, 'removed', NULL, 'annotation', [p.type, p.block_ord::VARCHAR, p.s::VARCHAR, p.e::VARCHAR, p.value] FROM journal j JOIN places p ON p.book_id = j.book_id AND p.id = j.target WHERE j.edit = 'removeAnnotation'
  UNION ALL SELECT book_id, -1, 'there', speaker, 'figure', [lower(name)] FROM figures UNION ALL SELECT book_id, seq, 'made', created, 'figure', [lower(value)] FROM live WHERE edit = 'addCast'
), stepped AS (SELECT *, lag(step) OVER (PARTITION BY book_id, kind, key ORDER BY seq, id) AS before FROM events_of),
freshened AS (SELECT *, step <> 'removed' AND coalesce(before, 'removed') = 'removed' AS fresh FROM stepped),
stood AS (SELECT *, last_value(CASE WHEN fresh THEN id END IGNORE NULLS) OVER (PARTITION BY book_id, kind, key ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same FROM freshened),
made AS (SELECT book_id, kind, seq, id, fresh, same FROM stood WHERE step = 'made' UNION ALL SELECT book_id, 'annotation', seq, created, TRUE, created FROM live WHERE edit = 'splitSpeech'),
own AS (SELECT m.book_id, m.kind, m.id AS same, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.book_id = m.book_id AND k.kind = m.kind AND k.id = m.id) THEN m.id || '-' || m.seq ELSE m.id END AS now FROM made m WHERE fresh),
ids AS (SELECT m.book_id, m.kind, m.id, coalesce(o.now, m.same) AS now, m.fresh FROM made m LEFT JOIN own o ON o.book_id = m.book_id AND o.kind = m.kind AND o.same = m.same),
mapped AS (
  SELECT j.book_id, j.seq, j.edit, coalesce(t.now, j.target) AS target, coalesce(f.now, j.figure) AS figure, c.now AS created, c.fresh, g.reason, t.now IS NOT NULL AS new_here, j.created IS NOT NULL AS makes, coalesce(f.now, j.figure, j.value) AS said,
    CASE j.edit WHEN 'setSpeaker' THEN 'speaker' WHEN 'setNote' THEN 'note' WHEN 'setEmphasisColor' THEN 'color' WHEN 'updateCast' THEN 'name' WHEN 'addMark' THEN 'exists' WHEN 'removeAnnotation' THEN 'exists' END AS property
  FROM journal j LEFT JOIN gone g ON g.book_id = j.book_id AND g.seq = j.seq LEFT JOIN ids t ON t.book_id = j.book_id AND t.id = j.target AND t.kind = CASE WHEN j.edit = 'updateCast' THEN 'figure' ELSE 'annotation' END
  LEFT JOIN ids f ON f.book_id = j.book_id AND f.id = j.figure AND f.kind = 'figure' LEFT JOIN ids c ON c.book_id = j.book_id AND c.id = j.created AND c.kind = CASE WHEN j.edit = 'addCast' THEN 'figure' ELSE 'annotation' END
), valued AS (
  SELECT m.*, reason IS NULL AND m.property IS NOT NULL AND created IS NULL AND edit <> 'removeAnnotation' AS sets, CASE WHEN row_number() OVER w = 1 THEN v.value ELSE lag(said) OVER w END AS held, row_number() OVER (PARTITION BY m.book_id, m.target, edit = 'removeAnnotation' ORDER BY seq) > 1 AS again
  FROM mapped m LEFT JOIN current_values v ON v.book_id = m.book_id AND v.target = m.target AND v.property = m.property WINDOW w AS (PARTITION BY m.book_id, m.target, m.property, reason IS NULL AND m.property IS NOT NULL AND created IS NULL AND edit <> 'removeAnnotation' ORDER BY seq)
)
SELECT v.book_id, v.seq, v.edit, v.target, v.figure, CASE WHEN reason IS NULL THEN v.created END AS created,
  CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN CASE WHEN edit = 'removeAnnotation' THEN again OR NOT (new_here OR k.id IS NOT NULL) WHEN sets THEN said IS NOT DISTINCT FROM held WHEN makes THEN NOT fresh ELSE FALSE END THEN 'unchanged' ELSE 'applied' END AS outcome, v.reason
FROM valued v LEFT JOIN known k ON k.book_id = v.book_id AND k.kind = 'annotation' AND k.id = v.target
""")
def journal_rebase(spark, sf):
    """Every command of the journals on another version of its book."""
    return rebase.rebased(*_offline(spark, sf))


# the timer ----------------------------------------------------------------------------------------------------------

PRESSES = ["start", "track", "toggle", "track", "toggle", "track", "pause", "start", "track", "start", "track", "track", "reset"]


@query(f"""
WITH RECURSIVE j AS (
  SELECT user_id AS reader, ts, event_id AS seq, epoch_us(ts) AS moment, {PRESSES}[event_id % 13 + 1] AS action, event_id * 7 % 500 AS position, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), s AS (
  SELECT DISTINCT user_id AS reader, 0::BIGINT AS k, FALSE AS running, 0::BIGINT AS micros, 0::BIGINT AS moment, NULL::BIGINT AS began, 0::BIGINT AS words FROM events
  UNION ALL
  SELECT s.reader, j.k, CASE WHEN action = 'start' THEN TRUE WHEN action = 'toggle' THEN NOT running WHEN action IN ('pause', 'reset') THEN FALSE ELSE running END,
    CASE WHEN action = 'reset' THEN 0 WHEN running THEN micros + j.moment - s.moment ELSE micros END, j.moment, CASE WHEN action = 'reset' THEN NULL WHEN NOT running AND action IN ('start', 'toggle') THEN coalesce(began, position) ELSE began END,
    CASE WHEN action = 'reset' THEN 0 WHEN action = 'track' AND running THEN greatest(position - began, 0) ELSE words END
  FROM s JOIN j ON j.reader = s.reader AND j.k = s.k + 1
), led AS (SELECT *, lead(moment) OVER (PARTITION BY reader ORDER BY k) AS following FROM s WHERE k > 0),
rows AS (
  SELECT l.reader, j.ts, j.seq, j.action, l.running, l.micros, l.words FROM led l JOIN j ON j.reader = l.reader AND j.k = l.k
  UNION ALL SELECT reader, make_timestamp(moment + 20000000 - micros), NULL, 'known', TRUE, 20000000, words FROM led
  WHERE running AND micros < 20000000 AND moment + 20000000 - micros <= coalesce(following, moment + 20000000 - micros) AND moment + 20000000 - micros <= (SELECT max(epoch_us(ts)) FROM events)
)
SELECT reader, ts, seq, action, running, micros // 1000 AS elapsed_ms, words, CASE WHEN micros >= 20000000 AND words > 0 THEN floor(words / ((micros // 1000) / 60000.0) + 0.5)::BIGINT END AS wpm FROM rows
""")
def reading_pace(spark, sf):
    """Every press of the timer with the time and words counted so far, and the moments when a pace became known."""
    k = F.col("event_id")
    action = F.get(F.array(*[F.lit(x) for x in PRESSES]), (k % 13).cast("int"))
    presses = table(spark, sf, "events").select(F.col("user_id").alias("reader"), F.col("ts").cast("timestamp").alias("ts"), k.alias("seq"), action.alias("action"), (k * 7 % 500).alias("position"))
    return timer.paces(presses).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
