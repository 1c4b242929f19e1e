"""Queries of the operators on whole books, commands, jobs and views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellichor.catalogue import LINES, NAMED, SCRIPT, _cast, _documents, _lines, _named, _script, query
from vellichor.functions import selection
from vellichor.operators import assembly, commands, display, prompts
from vellichor.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# ranges -------------------------------------------------------------------------------------------------------------

RANGES = f"WITH {LINES}, r AS (SELECT book_id, block_ord, text, (book_id + block_ord) % 9 AS s, (book_id + block_ord) % 9 + 1 + block_ord % 23 AS e FROM lines)"


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("book_id") + F.col("block_ord")
    return _lines(spark, sf).select("book_id", "block_ord", "text", (k % 9).alias("s"), (k % 9 + 1 + F.col("block_ord") % 23).alias("e"))


@query(RANGES + r"""
, c AS (SELECT *, least(e, length(text)) AS h FROM r), p AS (SELECT *, substr(text, s + 1, greatest(h - s, 0)) AS x FROM c),
t AS (SELECT *, s + length(x) - length(regexp_replace(x, '^\s+', '')) AS ts FROM p)
SELECT book_id, block_ord, ts::BIGINT AS s, greatest(ts, h - (length(x) - length(regexp_replace(x, '\s+$', ''))))::BIGINT AS e,
  CASE WHEN e > length(text) THEN 'range' WHEN trim(regexp_replace(x, '\s', '', 'g')) = '' THEN 'blank' END AS error FROM t
""")
def trim_range(spark, sf):
    rows = _ranges(spark, sf).withColumn("r", selection.trimmed(F.col("text"), F.col("s"), F.col("e")))
    return rows.select("book_id", "block_ord", "r.s", "r.e", selection.range_error(F.col("text"), F.col("s"), F.col("e")).alias("error"))


@query(RANGES + r"""
, c AS (SELECT book_id, block_ord, text, least(s, length(text)) AS s, least(e, length(text)) AS e FROM r),
g AS (SELECT *, CASE WHEN regexp_matches(substr(text, s + 1, 1), '[\p{L}\p{N}''’-]') THEN s - length(regexp_extract(substr(text, 1, s), '[\p{L}\p{N}''’-]*$')) ELSE s END AS a,
  CASE WHEN e > 0 AND regexp_matches(substr(text, e, 1), '[\p{L}\p{N}''’-]') THEN e + length(regexp_extract(substr(text, e + 1), '^[\p{L}\p{N}''’-]*')) ELSE e END AS z FROM c),
p AS (SELECT *, substr(text, a + 1, greatest(z - a, 0)) AS x FROM g)
SELECT book_id, block_ord, trim(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS picked FROM p
""")
def snap_selection(spark, sf):
    n = F.length("text").cast("long")
    rows = _ranges(spark, sf).withColumn("r", selection.snapped(F.col("text"), F.least("s", n), F.least("e", n)))
    return rows.select("book_id", "block_ord", F.trim(selection.part(F.col("text"), F.col("r.s"), F.col("r.e"))).alias("picked"))


@query(f"WITH {LINES} SELECT book_id, block_ord, len(regexp_extract_all(text, '[,;:]'))::BIGINT AS stops, length(text)::BIGINT AS covered FROM lines WHERE regexp_matches(text, '[,;:]')")
def breath_places(spark, sf):
    """Commas, semicolons and colons to breathe at; the chunks cover their text without gaps. Dashes are tested on a fixture: SQL has no look-behind."""
    rows = _lines(spark, sf).withColumn("c", selection.breath_chunks(F.col("text"), F.lit(0).cast("long"))).filter(F.col("text").rlike("[,;:]"))
    stops = F.filter("c", lambda x: x.breath & x.text.isin(",", ";", ":"))
    covered = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: F.when(x.s == acc, x.e).otherwise(F.lit(-1)))
    return rows.select("book_id", "block_ord", F.size(stops).cast("long").alias("stops"), covered.alias("covered"))


@query(f"""
WITH {LINES}, h AS (SELECT book_id, block_ord, text, strpos(text, ' the ') AS p, length(text) AS n FROM lines WHERE strpos(text, ' the ') > 0),
a AS (SELECT *, p AS s, p + 3 AS e FROM h), b AS (SELECT *, greatest(s - 48, 0) AS l, least(e + 48, n) AS r FROM a),
c AS (SELECT *, CASE WHEN l > 0 AND strpos(substr(text, l + 1, s - l), ' ') > 0 THEN l + strpos(substr(text, l + 1, s - l), ' ') ELSE l END AS l2, substr(text, e + 1, r + 1 - e) AS f FROM b),
d AS (SELECT *, CASE WHEN r < n AND strpos(f, ' ') > 0 AND length(f) - strpos(reverse(f), ' ') > 0 THEN e + length(f) - strpos(reverse(f), ' ') ELSE r END AS r2 FROM c)
SELECT book_id, block_ord, CASE WHEN l2 > 0 THEN '…' ELSE '' END || substr(text, l2 + 1, s - l2) AS before, substr(text, e + 1, r2 - e) || CASE WHEN r2 < n THEN '…' ELSE '' END AS after FROM d
""")
def hit_context(spark, sf):
    rows = _lines(spark, sf).withColumn("s", F.locate(" the ", F.col("text"))).filter("s > 0")
    return rows.select("book_id", "block_ord", selection.context(F.col("text"), F.col("s"), F.col("s") + 3).alias("x")).select("book_id", "block_ord", "x.before", "x.after")


@query(r"""
WITH signs AS (SELECT page_id, unnest(list_distinct(string_split(html, ''))) AS c FROM pages),
kinds AS (
  SELECT page_id, CASE WHEN regexp_matches(c, '^[\p{L}\p{N}]$') THEN 'n' ELSE '' END || CASE WHEN regexp_matches(c, '^\p{L}$') THEN 'a' ELSE '' END || CASE WHEN regexp_matches(c, '^\p{Ll}$') THEN 'l' ELSE '' END || CASE WHEN regexp_matches(c, '^\p{Lu}$') THEN 'u' ELSE '' END || CASE WHEN regexp_matches(c, '^\s$') THEN 's' ELSE '' END AS kinds
  FROM signs WHERE c <> ''
)
SELECT page_id, kinds, count(*) AS n FROM kinds GROUP BY page_id, kinds
""")
def char_classes(spark, sf):
    """How many different characters of each kind every page holds."""
    signs = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.split("html", ""))).alias("c")).filter("c <> ''")
    return signs.groupBy("page_id", selection.char_class(F.col("c")).alias("kinds")).agg(F.count("*").alias("n"))


# books --------------------------------------------------------------------------------------------------------------

BOOK = f"""{NAMED}, ids AS (SELECT book_id, chapter_ord, block_ord, kind, who, text, n, 'b' || lpad((row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, block_ord))::VARCHAR, 5, '0') AS block_id,
  'a' || lpad((row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, block_ord))::VARCHAR, 6, '0') AS annotation_id FROM script)"""


@query(f"{BOOK} SELECT book_id, block_ord, block_id, annotation_id FROM ids")
def created_book_ids(spark, sf):
    rows = _script(spark, sf)
    blocks, spans = assembly.book_ids(rows.select("book_id", "chapter_ord", "block_ord"), rows.select("book_id", "chapter_ord", "block_ord", F.lit(0).alias("s")))
    return blocks.join(spans, ["book_id", "block_ord"]).select("book_id", "block_ord", "block_id", "annotation_id")


@query(f"""
WITH {LINES} SELECT book_id, 0::BIGINT AS chapter_ord, sha256('[' || string_agg('{{"id":"b' || lpad(k::VARCHAR, 5, '0') || '","type":"p","text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY block_ord) || ']') AS sha
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY block_ord) AS k FROM lines) GROUP BY book_id
""")
def chapter_json(spark, sf):
    rows = _lines(spark, sf)
    blocks, _ = assembly.book_ids(rows, rows.select("book_id", "chapter_ord", "block_ord", F.lit(0).alias("s")))
    return assembly.chapter_json(blocks).select("book_id", "chapter_ord", F.sha2("json", 256).alias("sha"))


@query(f"{NAMED} SELECT book_id, speaker, row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, who, speaker) AS place FROM named GROUP BY book_id, speaker, who")
def final_cast(spark, sf):
    return assembly.final_cast(_cast(spark, sf).withColumn("pinned", F.lit(False))).select("book_id", "speaker", "place")


PRESETS = "p AS (SELECT c_nationkey AS book_id, c_custkey AS ord, 'f' || c_custkey AS speaker, 'Figur ' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN ['Figur ' || (c_custkey + 25), 'FIGUR ' || (c_custkey + 1)] ELSE ['Alias ' || c_custkey % 7] END AS aliases FROM customer)"


@query(f"""
WITH {PRESETS}, names AS (SELECT book_id, lower(name) AS key, arg_max(speaker, ord) AS speaker FROM p GROUP BY ALL),
al AS (SELECT book_id, key, arg_max(speaker, ord) AS owner FROM (SELECT book_id, ord, speaker, trim(lower(unnest(aliases))) AS key FROM p) GROUP BY ALL),
b AS (SELECT book_id, key, n.speaker, a.owner FROM names n FULL JOIN al a USING (book_id, key)),
gone AS (SELECT book_id, speaker AS lost, max(owner) AS to_ FROM b WHERE speaker <> owner GROUP BY ALL)
SELECT f.book_id, f.key, coalesce(g.to_, f.speaker) AS speaker FROM (SELECT book_id, key, coalesce(owner, speaker) AS speaker FROM b) f LEFT JOIN gone g ON g.book_id = f.book_id AND g.lost = f.speaker
""")
def preset_index(spark, sf):
    k = F.col("c_custkey")
    figure = lambda n: F.concat(F.lit("Figur "), n)
    aliases = F.when(k % 5 == 0, F.array(figure(k + 25), F.concat(F.lit("FIGUR "), k + 1))).otherwise(F.array(F.concat(F.lit("Alias "), k % 7)))
    return assembly.preset_index(table(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), k.alias("ord"), F.concat(F.lit("f"), k).alias("speaker"), figure(k).alias("name"), aliases.alias("aliases")))


@query("""
SELECT c_nationkey AS book_id, 'f' || c_custkey AS speaker, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey WHEN c_custkey % 4 = 0 THEN 'f' || c_custkey ELSE '?f' || c_custkey END AS mapped FROM customer
""")
def mapped_speakers(spark, sf):
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer").withColumn("book_id", F.col("c_nationkey"))
    speaker = F.concat(F.lit("f"), k).alias("speaker")
    index = customers.filter("c_custkey % 3 < 2").select("book_id", F.concat(F.when(k % 3 == 0, "name ").otherwise("alias "), k).alias("key"), F.concat(F.when(k % 3 == 0, "t").otherwise("u"), k).alias("target"))
    speakers = customers.select("book_id", speaker, F.array(F.concat(F.lit("Name "), k), F.concat(F.lit("Alias "), k)).alias("names"))
    return assembly.mapped_speakers(speakers, index, customers.filter("c_custkey % 4 = 0").select("book_id", speaker))


@query(f"""
WITH {LINES}, b AS (SELECT book_id, 'b' || lpad(block_ord::VARCHAR, CASE WHEN block_ord % 11 = 0 THEN 3 ELSE 5 END, '0') AS block_id, CASE WHEN block_ord % 7 = 0 THEN 'h3' ELSE 'p' END AS type, length(text) AS n, block_ord FROM lines),
a AS (SELECT event_id % 300 AS book_id, 'a' || event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'mark' ELSE 'speech' END AS kind, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 21) / 20.0 + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END END AS conf FROM events)
SELECT book_id, 'block type' AS rule, block_id AS detail FROM b WHERE type = 'h3'
UNION ALL SELECT book_id, 'block id', block_id FROM b WHERE NOT regexp_matches(block_id, '^b\\d{{5,}}$')
UNION ALL SELECT book_id, 'sentence bounds', block_id FROM b WHERE block_ord % 5 + 4 > n OR block_ord % 5 + 4 < block_ord % 8
UNION ALL SELECT book_id, 'annotation type', id FROM a WHERE kind = 'mark'
UNION ALL SELECT book_id, 'confidence', id FROM a WHERE conf IS NULL OR conf < 0 OR conf > 1
""")
def schema_violations(spark, sf):
    o = F.col("block_ord")
    pad = F.when(o % 11 == 0, 3).otherwise(5)
    spans = F.array(F.struct((o % 8).alias("s"), (o % 5 + 4).alias("e")))
    blocks = _lines(spark, sf).select("book_id", F.concat(F.lit("b"), F.expr("lpad(cast(block_ord as string), if(block_ord % 11 = 0, 3, 5), '0')")).alias("block_id"), F.when(o % 7 == 0, "h3").otherwise("p").alias("type"), spans.alias("sentences"), F.length("text").cast("long").alias("n"))
    k = F.col("event_id")
    conf = F.when(k % 17 != 0, (k % 21) / 20.0 + F.when(k % 19 == 0, 1).otherwise(0))
    return assembly.schema_violations(blocks, _events(spark, sf).select((k % 300).alias("book_id"), F.concat(F.lit("a"), k).alias("id"), F.when(k % 13 == 0, "mark").otherwise("speech").alias("kind"), conf.alias("conf")))


@query("""
SELECT event_id AS book_id, CASE WHEN event_id % 5 = 0 THEN 'no book' WHEN event_id % 7 = 0 THEN 'bad version' WHEN event_id % 6 = 0 THEN 'bad version' WHEN event_id % 6 > 3 THEN 'newer' WHEN event_id % 6 = 3 THEN 'current' WHEN event_id % 6 = 2 THEN 'migrate' ELSE 'no migration' END AS outcome,
  CASE WHEN event_id % 7 = 0 THEN 1.5 ELSE event_id % 6 END::DOUBLE AS from_version FROM events
""")
def version_gate(spark, sf):
    k = F.col("event_id")
    rows = _events(spark, sf).select(k.alias("book_id"), F.when(k % 5 != 0, "book").alias("format"), F.when(k % 7 == 0, 1.5).otherwise(k % 6).cast("double").alias("version"))
    return assembly.version_gate(rows, 3, (2,))


@query(f"""
{NAMED}, via AS (SELECT book_id, CASE kind WHEN 0 THEN 'inquit_after' ELSE 'inquit_before' END AS via, count(*) AS n FROM named GROUP BY ALL)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY via) AS place, via, n, round(100.0 * n / sum(n) OVER (PARTITION BY book_id), 1)::DOUBLE AS percent FROM via
""")
def info_via(spark, sf):
    via = _named(spark, sf).groupBy("book_id", "via").agg(F.count("*").alias("n"))
    return assembly.info_report(via, _cast(spark, sf))[0].withColumn("percent", F.col("percent").cast("double"))


@query("""
WITH c AS (SELECT c_nationkey AS book_id, c_name AS name, c_custkey % 37 AS lines FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY lines DESC, name) AS place, count(*) OVER (PARTITION BY book_id) AS total FROM c)
SELECT book_id, place, name, lines, greatest(total - 15, 0) AS more FROM r WHERE place <= 15
""")
def info_cast(spark, sf):
    cast = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 37).alias("lines"))
    return assembly.info_report(cast.limit(0).select("book_id", F.lit("").alias("via"), F.lit(1).alias("n")), cast)[1]


@query("""
WITH c AS (SELECT o_custkey AS book_id, count(*) AS found, count_if(o_orderstatus = 'F') AS correct, count_if(o_orderstatus = 'O') AS wrong, count_if(o_orderstatus = 'P') AS unattributed, count_if(o_totalprice < 50000) AS queued, count_if(o_totalprice > 200000) AS silent_wrong FROM orders GROUP BY o_custkey),
u AS (UNPIVOT c ON correct, wrong, unattributed, queued, silent_wrong INTO NAME measure VALUE n)
SELECT book_id, measure, n::BIGINT AS n, round(100.0 * n / found, 1)::DOUBLE AS percent FROM u
""")
def accuracy_table(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.count("*").alias("found"), F.count_if(status == "F").alias("correct"), F.count_if(status == "O").alias("wrong"), F.count_if(status == "P").alias("unattributed"), F.count_if(price < 50000).alias("queued"), F.count_if(price > 200000).alias("silent_wrong"))
    return assembly.accuracy_table(rows).withColumn("percent", F.col("percent").cast("double"))


@query("""
WITH l AS (SELECT user_id AS book_id, max(event_id) AS seq, arg_max(event_type, event_id) AS t, arg_max(ts, event_id) AS saved FROM events GROUP BY user_id), k AS (SELECT * FROM l WHERE t <> 'click')
SELECT book_id, saved, floor(100.0 * (seq % 40) / 40 + 0.5)::BIGINT AS percent FROM k
""")
def recent_books(spark, sf):
    k = F.col("event_id")
    return assembly.recent(_events(spark, sf).select(F.col("user_id").alias("book_id"), k.alias("seq"), F.when(F.col("event_type") == "click", "delete").otherwise("put").alias("op"), F.col("ts").alias("saved"), (k % 40).alias("position"), F.lit(40).alias("blocks")))


@query("""
SELECT event_id AS path, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 4 THEN 'written' WHEN event_id % 3 = 0 THEN 'vanished' WHEN event_id % 4 = event_id % 5 THEN 'written' ELSE 'conflict' END AS outcome FROM events
""")
def conditional_writes(spark, sf):
    k = F.col("event_id")
    wanted = _events(spark, sf).select(k.alias("path"), F.when(k % 5 != 4, k % 5).alias("expected_sha"), (k % 7 == 0).alias("forced"))
    return assembly.conditional_writes(wanted, _events(spark, sf).filter(k % 3 != 0).select(k.alias("path"), (k % 4).alias("sha")))


# commands -----------------------------------------------------------------------------------------------------------

SPANS = "spans AS (SELECT doc_id AS book_id, 0 AS block_ord, 10 * unnest(range(0, 5)) AS s, 10 * unnest(range(0, 5)) + 8 AS e, 'f' || doc_id % 3 AS speaker, 0.5 AS conf, 'rule' AS origin FROM documents WHERE length(text) > 60)"


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf).filter(F.length("text") > 60)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k")
    spans = docs.select(F.col("doc_id").alias("book_id"), F.lit(0).cast("long").alias("block_ord"), F.concat(F.lit("f"), F.col("doc_id") % 3).alias("speaker"), k)
    spans = spans.select("book_id", "block_ord", (10 * F.col("k")).alias("s"), (10 * F.col("k") + 8).alias("e"), "speaker", F.lit(0.5).alias("conf"), F.lit("rule").alias("origin"))
    return spans, docs.select(F.col("doc_id").alias("book_id"), F.lit(0).cast("long").alias("block_ord"), F.regexp_replace("text", r"\s", "x").alias("text"))


@query(f"""
WITH {SPANS}, n AS (SELECT DISTINCT book_id, block_ord, book_id % 30 AS s, book_id % 30 + 12 AS e FROM spans WHERE book_id % 2 = 0)
SELECT book_id, block_ord::BIGINT AS block_ord, s::BIGINT AS s, e::BIGINT AS e, speaker, conf::DOUBLE AS conf, origin FROM spans WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = spans.book_id AND n.s < spans.e AND n.e > spans.s)
UNION ALL SELECT book_id, block_ord, s, e, 'new', 1.0, 'user' FROM n
""")
def add_speech(spark, sf):
    spans, blocks = _spans(spark, sf)
    at = F.col("book_id") % 30
    return commands.add_speech(spans, blocks.filter("book_id % 2 = 0").select("book_id", "block_ord", at.alias("s"), (at + 12).alias("e"), F.lit("new").alias("speaker")), blocks)


@query(f"""
WITH {SPANS}, c AS (SELECT *, s + book_id % 11 AS cut FROM spans)
SELECT book_id, block_ord::BIGINT AS block_ord, s::BIGINT AS s, CASE WHEN cut > s AND cut < e THEN cut ELSE e END::BIGINT AS e, speaker, conf::DOUBLE AS conf, origin FROM c
UNION ALL SELECT book_id, block_ord, cut, e, 'new', 1.0, 'user' FROM c WHERE cut > s AND cut < e
""")
def split_speech(spark, sf):
    spans, blocks = _spans(spark, sf)
    cuts = spans.select("book_id", "block_ord", "s", (F.col("s") + F.col("book_id") % 11).alias("at"), F.lit("new").alias("speaker"))
    return commands.split_speech(spans, cuts, blocks)


@query("""
WITH w AS (SELECT user_id AS book_id, event_id % 3 AS block_ord, event_id % 5 AS s, event_id % 5 + 4 AS e, CASE WHEN event_id % 8 < 5 THEN event_id % 8 END AS color, event_id AS seq FROM events),
m AS (SELECT DISTINCT book_id, block_ord, s, e, 1 AS color FROM w WHERE s < 3 UNION SELECT DISTINCT book_id, 9, 0, 1, 2 FROM w)
, l AS (SELECT book_id, block_ord, s, e, max_by([color], seq)[1] AS new FROM w GROUP BY ALL)
SELECT book_id, block_ord, s, e, CASE WHEN l.e IS NULL THEN m.color ELSE l.new END::INT AS color, l.book_id IS NOT NULL AS by_user FROM m FULL JOIN l USING (book_id, block_ord, s, e)
""".replace("l.e IS NULL", "l.new IS NULL AND NOT EXISTS (SELECT 1 FROM l x WHERE x.book_id = m.book_id AND x.block_ord = m.block_ord AND x.s = m.s AND x.e = m.e)"))
def add_emphasis(spark, sf):
    k = F.col("event_id")
    w = _events(spark, sf).select(F.col("user_id").alias("book_id"), (k % 3).alias("block_ord"), (k % 5).alias("s"), (k % 5 + 4).alias("e"), (k % 8).alias("color"), k.alias("seq"))
    one = lambda x: F.lit(x).cast("long")
    marks = w.filter("s < 3").select("book_id", "block_ord", "s", "e", F.lit(1).alias("color")).distinct().unionByName(w.select("book_id", one(9).alias("block_ord"), one(0).alias("s"), one(1).alias("e"), F.lit(2).alias("color")).distinct())
    return commands.add_emphasis(marks, w)


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'langsam, leise' WHEN 1 THEN ',laut' WHEN 2 THEN 'a' ELSE ',,' || repeat('x', 40) END AS labels FROM events
""")
def emphasis_labels(spark, sf):
    k = F.col("event_id") % 4
    old = F.when(k == 2, F.array(F.lit("a"), F.lit(""), F.lit("b"))).when(k == 1, F.array(F.lit("weg"), F.lit("laut"))).otherwise(F.array().cast("array<string>"))
    color = F.when(k == 0, 0).when(k == 1, 0).when(k == 2, 2).otherwise(2)
    text = F.when(k == 0, "  langsam,  leise ").when(k == 3, F.repeat(F.lit("x"), 60)).otherwise(" ")
    return _events(spark, sf).select("event_id", F.array_join(commands.emphasis_labels(old, color, text), ",").alias("labels"))


@query("""
SELECT event_id % 300 AS book_id, 'a' || event_id AS id, k AS kind, CASE WHEN k IN ('note', 'retake') AND event_id % 2 = 0 THEN 'neu' ELSE 'alt' END AS note, CASE WHEN event_id % 2 = 1 THEN 'kept' WHEN k IN ('note', 'retake') THEN 'set' ELSE 'refused' END AS outcome
FROM (SELECT *, ['note', 'retake', 'bookmark'][1 + event_id % 3] AS k FROM events)
""")
def set_notes(spark, sf):
    k = F.col("event_id")
    rows = _events(spark, sf).select((k % 300).alias("book_id"), F.concat(F.lit("a"), k).alias("id"), F.get(F.array(F.lit("note"), F.lit("retake"), F.lit("bookmark")), (k % 3).cast("int")).alias("kind"), F.lit("alt").alias("note"), k.alias("k"))
    notes = rows.filter("k % 2 = 0").select("book_id", "id", F.explode(F.array(F.struct(F.lit("vorher").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit("neu").alias("value"), F.lit(2).alias("seq")))).alias("x")).select("book_id", "id", "x.*")
    return commands.annotated(rows.drop("k"), notes)


@query("""
SELECT c_nationkey AS book_id, c_custkey AS speaker, CASE WHEN c_custkey % 3 = 0 THEN 'Neuer Name' ELSE 'Anna Berg' END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'XYZ' WHEN c_custkey % 3 = 0 THEN 'NN' ELSE 'AB' END WHEN c_custkey % 5 = 0 THEN '??' WHEN c_custkey % 3 = 0 THEN 'NN' ELSE 'AB' END AS badge,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'user' ELSE 'rule' END AS origin FROM customer
""")
def update_cast(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), k.alias("speaker"))
    cast = rows.select("book_id", "speaker", F.lit("Anna Berg").alias("name"), F.when(F.col("speaker") % 5 == 0, "??").otherwise("AB").alias("badge"), F.lit("rule").alias("origin"))
    s = F.col("speaker")
    return commands.update_cast(cast, rows.filter((s % 3 == 0) | (s % 7 == 0)).select("book_id", "speaker", F.when(s % 3 == 0, "  Neuer   Name ").alias("new_name"), F.when(s % 7 == 0, F.when(s % 2 == 0, "XYZW").otherwise(" ")).alias("new_badge")))


@query("""
WITH c AS (SELECT c_nationkey AS book_id, c_custkey AS id, 'N' || c_custkey AS name, ['A' || c_custkey % 9, 'N' || (c_custkey + 25)] AS aliases, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 12 END AS color, CASE WHEN c_custkey % 3 = 0 THEN 'tief' ELSE '' END AS note FROM customer),
m AS (SELECT a.book_id, a.id AS from_id, b.id AS into_id FROM c a JOIN c b ON a.book_id = b.book_id AND b.id = a.id - a.id % 10 WHERE a.id % 10 IN (1, 2)),
g AS (SELECT m.book_id, m.into_id AS id, flatten(list(list_concat([c.name], c.aliases))) AS more, min(c.color) AS color, min(CASE WHEN c.note <> '' THEN c.note END) AS note FROM m JOIN c ON c.book_id = m.book_id AND c.id = m.from_id GROUP BY m.book_id, m.into_id)
SELECT c.book_id, c.id AS speaker, array_to_string(list_sort(list_distinct(list_filter(list_concat(c.aliases, coalesce(g.more, [])), lambda x: x <> c.name))), ',') AS aliases, coalesce(c.color, g.color)::INT AS color, CASE WHEN c.note = '' THEN coalesce(g.note, '') ELSE c.note END AS note
FROM c LEFT JOIN g USING (book_id, id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book_id = c.book_id AND m.from_id = c.id)
""")
def merge_cast(spark, sf):
    k = F.col("c_custkey")
    cast = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), k.alias("speaker"), F.concat(F.lit("N"), k).alias("name"), F.array(F.concat(F.lit("A"), k % 9), F.concat(F.lit("N"), k + 25)).alias("aliases"), F.when(k % 2 == 0, (k % 12).cast("int")).alias("color"), F.when(k % 3 == 0, "tief").otherwise("").alias("note"))
    merges = cast.filter("speaker % 10 in (1, 2)").select("book_id", F.col("speaker").alias("from_id"), (F.col("speaker") - F.col("speaker") % 10).alias("into_id"))
    merges = merges.join(cast.select("book_id", F.col("speaker").alias("into_id")), ["book_id", "into_id"], "left_semi")
    return commands.merge_cast(cast, merges).select("book_id", "speaker", F.array_join("aliases", ",").alias("aliases"), "color", "note")


@query("""
SELECT p_partkey AS term, CASE WHEN take THEN 'neu' ELSE 'alt' END AS hint, CASE WHEN take AND p_partkey % 3 = 0 THEN 'ipa' ELSE '' END AS ipa, CASE WHEN take THEN 'llm' WHEN p_partkey % 4 = 0 THEN 'user' ELSE 'rule' END AS origin
FROM (SELECT p_partkey, p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 1 AS take FROM part)
""")
def pronunciation_suggestions(spark, sf):
    k = F.col("p_partkey")
    parts = table(spark, sf, "part")
    one = F.lit(1).alias("book_id")
    terms = parts.select(one, k.alias("term"), F.lit("alt").alias("hint"), F.lit("").alias("ipa"), F.when(k % 4 == 0, "user").otherwise("rule").alias("origin"), (k % 5 == 0).alias("verified"))
    suggested = parts.select(one, k.alias("term"), F.when(k % 2 == 1, " neu ").otherwise("  ").alias("new_hint"), F.when(k % 3 == 0, "ipa").alias("new_ipa"))
    return commands.pronunciations(terms, suggested).select("term", "hint", "ipa", "origin")


@query("""
WITH p AS (SELECT user_id AS book_id, event_id % 3 AS chapter_ord, 'f' || event_id % 8 AS speaker, min(event_id) AS first FROM events GROUP BY ALL),
r AS (SELECT *, substr(speaker, 2)::INT AS f FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_ord ORDER BY first, speaker) AS k FROM r WHERE f > 1),
w AS (SELECT book_id, chapter_ord, list_filter(range(12), lambda x: NOT list_contains(list(CASE WHEN f <= 1 THEN f * 3 END), x)) AS open FROM r GROUP BY ALL)
SELECT t.book_id, t.chapter_ord, t.speaker, w.open[t.k]::INT AS slot FROM t JOIN w USING (book_id, chapter_ord)
""")
def chapter_colors_after_edit(spark, sf):
    """Without old slots every figure is pending; kept and colliding old slots are tested on a fixture."""
    k = F.col("event_id")
    lines = _events(spark, sf).groupBy(F.col("user_id").alias("book_id"), (k % 3).alias("chapter_ord"), F.concat(F.lit("f"), k % 8).alias("speaker")).agg(F.min("event_id").alias("first"))
    slots = lines.select("book_id", "speaker").distinct().filter("speaker in ('f0', 'f1')").withColumn("slot", F.when(F.col("speaker") == "f1", 3).otherwise(0))
    return commands.normal_colors(lines, slots, lines.select("book_id", "chapter_ord", "speaker", F.lit(0).alias("slot")).limit(0))


@query("""
WITH j AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id FROM events), k AS (SELECT * FROM j WHERE NOT (book_id % 4 = 0 AND seq = 3)),
r AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n, max(seq) OVER (PARTITION BY book_id) AS last FROM k WHERE seq > 1)
SELECT book_id, seq FROM r WHERE last - 1 = n
""")
def commands_since_saved(spark, sf):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    journal = _events(spark, sf).select(F.col("user_id").alias("book_id"), seq.alias("seq"), F.lit("setNote").alias("edit")).filter("not (book_id % 4 = 0 and seq = 3)")
    return commands.since_saved(journal, journal.select("book_id", F.lit(1).alias("saved_seq")).distinct()).select("book_id", "seq")


@query("""
SELECT user_id AS book_id, max(event_id) AS position FROM events WHERE event_id % 3 = 0 GROUP BY user_id
""")
def reading_positions(spark, sf):
    k = F.col("event_id")
    return commands.positions(_events(spark, sf).select(F.col("user_id").alias("book_id"), k.alias("seq"), F.when(k % 3 == 0, "setProgress").otherwise("setNote").alias("edit"), k.alias("value")))


# jobs ---------------------------------------------------------------------------------------------------------------

ASKED = """spans AS (SELECT user_id AS book_id, event_id % 4 AS chapter_ord, event_id AS block_ord, CASE WHEN event_id % 6 = 0 THEN 'user' WHEN event_id % 6 = 1 THEN 'llm' ELSE 'rule' END AS origin, CASE WHEN event_id % 5 = 0 THEN 'llm' END AS suggested_by,
  CASE WHEN event_id % 7 <> 0 THEN 'f' || event_id % 3 END AS speaker, (event_id % 11) / 10.0 AS conf FROM events), asked AS (SELECT * FROM spans WHERE origin = 'rule' AND suggested_by IS NULL AND (speaker IS NULL OR conf < 0.9))"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select(F.col("user_id").alias("book_id"), (k % 4).alias("chapter_ord"), k.alias("block_ord"), F.lit(0).alias("s"), F.when(k % 6 == 0, "user").when(k % 6 == 1, "llm").otherwise("rule").alias("origin"), F.when(k % 5 == 0, "llm").alias("suggested_by"), F.when(k % 7 != 0, F.concat(F.lit("f"), k % 3)).alias("speaker"), ((k % 11) / 10.0).alias("conf"))


@query(f"WITH {ASKED} SELECT book_id, block_ord, 'R' || row_number() OVER (PARTITION BY book_id, chapter_ord ORDER BY block_ord) AS passage FROM asked")
def asked_passages(spark, sf):
    return prompts.asked_passages(_asked(spark, sf)).select("book_id", "block_ord", "passage")


@query(f"WITH {ASKED} SELECT book_id, count(*) AS asked FROM asked WHERE chapter_ord < 2 GROUP BY book_id")
def count_asked(spark, sf):
    spans = _asked(spark, sf)
    return prompts.count_asked(spans, spans.filter("chapter_ord < 2").select("book_id", "chapter_ord").distinct())


@query(f"""
WITH {SCRIPT}, l AS (SELECT book_id, chapter_ord, block_ord, CASE kind WHEN 2 THEN 1 ELSE 0 END AS asked, replace(replace(text, '»', CASE kind WHEN 2 THEN '[R: »' ELSE '[' || lower(who) || ': »' END), '«', '«]') AS line FROM script)
SELECT book_id, chapter_ord, sum(asked)::BIGINT AS passages, string_agg(line, chr(10) ORDER BY block_ord) AS prompt FROM l GROUP BY book_id, chapter_ord
""")
def speaker_prompts(spark, sf):
    """A prompt for each chapter of the script; passages are all called R here, so that SQL can follow."""
    rows = _script(spark, sf)
    asked = F.when(F.col("kind") == 2, "R")
    spans = rows.select("book_id", "block_ord", (F.locate("»", F.col("text")) - 1).alias("s"), F.locate("«", F.col("text")).alias("e"), asked.alias("passage"), F.lower("who").alias("speaker"))
    return prompts.prompts(rows.select("book_id", "chapter_ord", "block_ord", "text"), spans, rows.select("book_id", "block_ord", F.lit(0).alias("chunk"))).drop("chunk")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_id END AS n, CASE event_id % 5 WHEN 4 THEN 'none' ELSE 'f' || event_id % 9 END AS speaker FROM events
""")
def extracted_answers(spark, sf):
    k = F.col("event_id")
    body = F.concat(F.lit('{"n": '), k, F.lit(', "speaker": "f'), k % 9, F.lit('"}'))
    answer = F.when(k % 5 == 0, body).when(k % 5 == 1, F.concat(F.lit("Gerne:\n```json\n"), body, F.lit("\n``` fertig"))).when(k % 5 == 2, F.concat(F.lit("So: "), body, F.lit(" bitte"))).when(k % 5 == 3, F.concat(F.lit("```"), body, F.lit("```"))).otherwise("keine {Antwort}")
    rows = _events(spark, sf).select("event_id", prompts.extracted_json(answer).alias("v"))
    return rows.select("event_id", prompts.safe(F.col("v"), "$.n", "bigint").alias("n"), prompts.safe(F.col("v"), "$.speaker", "string", "none").alias("speaker"))


@query("""
WITH u AS (SELECT DISTINCT user_id AS book_id FROM events)
SELECT book_id, 0::BIGINT AS chapter_ord, 'R' || k AS passage, CASE k WHEN 2 THEN NULL ELSE 'f' || book_id % 5 END AS speaker, CASE k WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM u, (SELECT unnest([1, 2]) AS k)
""")
def model_judgements(spark, sf):
    """Percentages become fractions, the first of two judgements counts, unknown passages go."""
    books = _events(spark, sf).select(F.col("user_id").alias("book_id")).distinct()
    answer = F.concat(F.lit('{"items": [{"id": "R1", "speaker": "f'), F.col("book_id") % 5, F.lit('", "confidence": 80}, {"id": "R1", "speaker": "zz"}, {"id": " R2 ", "speaker": " ", "confidence": "?"}, {"id": "R77", "speaker": "f1"}]}'))
    zero = F.lit(0).cast("long").alias("chapter_ord")
    asked = books.select("book_id", zero, F.explode(F.array(F.lit("R1"), F.lit("R2"), F.lit("R3"))).alias("passage"))
    return prompts.judgements(books.select("book_id", zero, answer.alias("answer")), asked)


@query("""
WITH i AS (SELECT user_id AS book_id, event_id AS k, 'f' || event_id % 12 AS from_id, 'f' || event_id % 5 AS into_id, (event_id % 101)::DOUBLE AS c FROM events), v AS (SELECT * FROM i WHERE from_id <> into_id AND from_id <> 'f11'),
f AS (SELECT book_id, from_id, arg_min(into_id, k) AS into_id, arg_min(c, k) AS c FROM v GROUP BY ALL)
SELECT book_id, from_id, into_id, CASE WHEN c > 1 THEN c / 100 ELSE c END AS confidence, CASE WHEN c > 1 THEN c / 100 ELSE c END >= 0.85 AS apply, CASE WHEN c > 1 THEN c / 100 ELSE c END >= 0.8 AS preselect FROM f
""")
def cast_merge_suggestions(spark, sf):
    k = F.col("event_id")
    items = _events(spark, sf).select(F.col("user_id").alias("book_id"), k.alias("k"), F.concat(F.lit("f"), k % 12).alias("from_id"), F.concat(F.lit("f"), k % 5).alias("into_id"), (k % 101).cast("double").alias("confidence"))
    figures = items.select("book_id").distinct().select("book_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda x: F.concat(F.lit("f"), x))).alias("speaker"))
    return prompts.merge_suggestions(items, figures)


@query(f"""
{NAMED}, c AS (SELECT book_id, speaker, who AS name, count(*) AS lines, list_sort(list(DISTINCT chapter_ord + 1)) AS ch FROM named GROUP BY ALL),
s AS (SELECT book_id, speaker, string_agg(said, ' | ' ORDER BY block_ord) AS samples FROM (SELECT book_id, speaker, block_ord, 'Block ' || block_ord AS said, row_number() OVER (PARTITION BY book_id, speaker ORDER BY block_ord) AS k FROM named) WHERE k <= 2 GROUP BY ALL)
SELECT book_id, speaker, name, lines, CASE WHEN len(ch) > 4 THEN ch[1] || '–' || ch[-1] ELSE array_to_string(ch, ', ') END AS "where", samples FROM c JOIN s USING (book_id, speaker)
""")
def figure_cards(spark, sf):
    named = _named(spark, sf)
    blocks = _script(spark, sf).select("book_id", "block_ord", F.concat(F.lit("Block "), "block_ord").alias("text"))
    spans = named.select("book_id", "chapter_ord", "block_ord", "speaker", F.lit(0).alias("s"), F.lit(40).alias("e"))
    return prompts.figure_cards(_cast(spark, sf).drop("lines"), spans, blocks)


CALLS = "calls AS (SELECT user_id AS book_id, ['done', 'done', 'failed', 'skipped'][1 + event_id % 4] AS state, event_id % 900 AS input, event_id % 70 AS output FROM events)"


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select(F.col("user_id").alias("book_id"), F.get(F.array(*[F.lit(x) for x in ("done", "done", "failed", "skipped")]), (k % 4).cast("int")).alias("state"), (k % 900).alias("input"), (k % 70).alias("output"))


@query(f"""
WITH {CALLS}, g AS (SELECT book_id, count_if(state = 'done')::BIGINT AS done, count_if(state = 'failed')::BIGINT AS failed, count_if(state = 'skipped')::BIGINT AS skipped, coalesce(sum(CASE WHEN state = 'done' THEN input END), 0)::BIGINT AS input, coalesce(sum(CASE WHEN state = 'done' THEN output END), 0)::BIGINT AS output FROM calls GROUP BY book_id)
SELECT *, round((input * 0.5 + output * 2.0) / 1e6, 8)::DOUBLE AS cost FROM g
""")
def run_summary(spark, sf):
    return prompts.run_summary(_calls(spark, sf), 0.5, 2.0).withColumn("cost", F.col("cost").cast("double"))


@query(f"""
WITH {CALLS} SELECT book_id, round(sum(input) / 41.0 + sum(output) / 6.0, 4)::DOUBLE AS seconds, round(sum(CASE WHEN state = 'done' THEN input + 5 * output ELSE 0 END) / sum(input + 5 * output), 4)::DOUBLE AS done_share FROM calls GROUP BY book_id
""")
def run_estimate(spark, sf):
    calls = _calls(spark, sf).withColumn("done", F.col("state") == "done")
    seconds = prompts.estimated_seconds(calls, 41.0, 6.0)
    return seconds.join(prompts.eta(calls), "book_id").select("book_id", F.round("seconds", 4).cast("double").alias("seconds"), F.col("done_share").cast("double").alias("done_share"))


@query("""
SELECT doc_id, length(text) > 4500 AND doc_id % 2000 > 0 AND doc_id % 2000 < ceil(length(text) / 3) * 0.6 AS truncated FROM documents
""")
def truncated_prompts(spark, sf):
    return _documents(spark, sf).select("doc_id", prompts.truncated(F.length("text"), F.col("doc_id") % 2000).alias("truncated"))


@query("""
SELECT page_id, page_id % 4 = 0 OR page_id % 3 <> 2 AS allowed FROM pages
""")
def policy_gate(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://127.0.0.1:"), k % 60000, F.lit("/v1"))).when(k % 3 == 1, "http://box.local/api").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", prompts.allowed(url, k % 4 == 0).alias("allowed"))


@query("""
SELECT p_size AS book_id, p_partkey AS term, p_partkey % 50 AS n, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 50 DESC, p_partkey) AS place FROM part WHERE p_partkey % 4 NOT IN (0, 1) AND p_partkey % 5 <> 0 AND p_partkey % 3 = 0
""")
def terms_to_clear(spark, sf):
    k = F.col("p_partkey")
    origin = F.when(k % 4 == 0, "user").when(k % 4 == 1, "llm").otherwise("rule")
    return prompts.open_terms(table(spark, sf, "part").select(F.col("p_size").alias("book_id"), k.alias("term"), (k % 50).alias("n"), F.when(k % 3 == 0, "").otherwise("x").alias("hint"), origin.alias("origin"), (k % 5 == 0).alias("verified")))


# views --------------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 9 > 4 THEN 'schlicht' ELSE ['Rot – laut', 'Blau', 'Grün – leise', 'Orange', 'Violett'][1 + event_id % 9] END AS pen, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE event_id % 7 END::BIGINT AS s, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE event_id % 7 + 2 END::BIGINT AS e FROM events
""")
def pens_and_intervals(spark, sf):
    k = F.col("event_id")
    labels = F.array(F.lit(" laut"), F.lit(""), F.lit("leise "))
    kind = F.get(F.array(*[F.lit(x) for x in ("pause", "breath", "note", "speech")]), (k % 4).cast("int"))
    at = display.interval(kind, k % 7, k % 7 + 2, F.lit(3).cast("long"))
    return _events(spark, sf).select("event_id", display.pen_name(k % 9, labels).alias("pen"), at.alias("x")).select("event_id", "pen", "x.s", "x.e")


@query("""
SELECT event_id, ['iPad', 'iPhone', 'Android-Gerät', 'iPad', 'Browser'][1 + event_id % 5] AS device, event_id % 4 <> 0 AS changed, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 6 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END + event_id % 6) % (event_id % 6) END AS step, least(260, greatest(80, floor((event_id % 300) / 5.0 + 0.5) * 5))::BIGINT AS tempo FROM events
""")
def devices_steps_tempo(spark, sf):
    k = F.col("event_id")
    agent = F.get(F.array(*[F.lit(x) for x in ("Mozilla (iPad; CPU OS)", "Mozilla (iPhone; U)", "Mozilla (Linux; Android 14)", "Mozilla (Macintosh; Intel)", "Mozilla (Macintosh; Intel)")]), (k % 5).cast("int"))
    changed = display.may_have_changed(F.lit(1), F.lit(5), F.when(k % 4 != 1, F.when(k % 4 == 2, 2).otherwise(1)), F.when(k % 4 == 3, 6).otherwise(5))
    return _events(spark, sf).select("event_id", display.device(agent, F.when(k % 5 == 3, 5)).alias("device"), changed.alias("changed"), display.stepped(k % 6, F.when(k % 2 == 0, 1).otherwise(-1), k % 6).alias("step"), display.tempo(k % 300).alias("tempo"))


@query("""
WITH e AS (SELECT event_id, event_id % 5 AS id, CASE WHEN event_id % 7 <> 0 THEN 'f' || event_id % 3 END AS sp FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN id <> 2 WHEN event_id % 4 = 0 THEN false WHEN event_id % 3 = 0 THEN sp IS DISTINCT FROM 'f0' ELSE coalesce(sp IN ('f1', 'f2'), false) END AS dimmed FROM e
""")
def dimmed_spans(spark, sf):
    k = F.col("event_id")
    speaker = F.when(k % 7 != 0, F.concat(F.lit("f"), k % 3))
    return _events(spark, sf).select("event_id", display.dimmed(k % 5, speaker, F.when(k % 11 == 0, 2), k % 4 == 0, F.when(k % 3 == 0, "f0"), F.array(F.lit("f1"), F.lit("f2"))).alias("dimmed"))


MARKED = "m AS (SELECT user_id AS book_id, event_id % 3 AS chapter_ord, ['retake', 'bookmark', 'note', 'emphasis', 'speech'][1 + event_id % 5] AS type, CASE WHEN event_id % 7 < 6 THEN event_id % 7 END AS color FROM events)"


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return _events(spark, sf).select(F.col("user_id").alias("book_id"), (k % 3).alias("chapter_ord"), F.get(F.array(*[F.lit(x) for x in ("retake", "bookmark", "note", "emphasis", "speech")]), (k % 5).cast("int")).alias("type"), F.when(k % 7 < 6, k % 7).alias("color"))


@query(f"WITH {MARKED} SELECT book_id, chapter_ord, CASE WHEN color < 5 THEN color ELSE -1 END::INT AS color, count(*) AS n FROM m WHERE type = 'emphasis' GROUP BY ALL")
def pen_counts(spark, sf):
    return display.pen_counts(_marked(spark, sf))


@query(f"WITH {MARKED} SELECT book_id, count(*) AS \"all\", count_if(type = 'retake')::BIGINT AS retake, count_if(type = 'bookmark')::BIGINT AS bookmark, count_if(type = 'note')::BIGINT AS note, count_if(type = 'emphasis')::BIGINT AS emphasis FROM m WHERE type <> 'speech' GROUP BY book_id")
def mark_counts(spark, sf):
    return display.mark_counts(_marked(spark, sf))


@query(f"""
{NAMED}, c AS (SELECT book_id, speaker, count(*) AS lines FROM named GROUP BY ALL), n AS (SELECT book_id, chapter_ord, speaker, count(*) AS n FROM named GROUP BY ALL), h AS (SELECT DISTINCT book_id, chapter_ord FROM n)
SELECT h.book_id, h.chapter_ord, row_number() OVER (PARTITION BY h.book_id, h.chapter_ord ORDER BY coalesce(n.n, -1) DESC, c.lines DESC, c.speaker) AS place, c.speaker FROM h JOIN c USING (book_id) LEFT JOIN n ON n.book_id = h.book_id AND n.chapter_ord = h.chapter_ord AND n.speaker = c.speaker WHERE c.speaker IN ('anna', 'jonas')
""")
def cast_picker(spark, sf):
    cast = _cast(spark, sf).withColumn("aliases", F.when(F.col("speaker") == "jonas", F.array(F.lit("Kapitän HANNES"))).otherwise(F.array(F.lit("x"))))
    lines = _named(spark, sf).groupBy("book_id", "chapter_ord", "speaker").agg(F.count("*").alias("n"))
    return display.picker(cast, lines, " ann")
