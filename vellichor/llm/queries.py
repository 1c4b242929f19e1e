"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.llm import chat_format, decontamination, jaccard_join, line_dedup, media, packing, phrases, prefix_trie, substring_dedup, token_files, toxicity, url_filter, warc
from vellichor.session import spread, table

#: Rows whose labels may be learned from; the others are held out.
NOT_HELD_OUT = "crc32(cast(doc_id as string)) % 5 <> 0"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), usable=NOT_HELD_OUT)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair(table(spark, sf_dir, "conversations"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.align(media.recordings(spread(table(spark, sf_dir, "embeddings")))).withColumnRenamed("id", "vec_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spread(table(spark, sf_dir, "documents")), texts=False)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spread(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(spread(table(spark, sf_dir, "documents")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spread(table(spark, sf_dir, "conversations")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(table(spark, sf_dir, "pages")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_packing, op4_toxicity, op5_chat_format, op6_media, op7_substring_dedup, op8_token_files, op9_jaccard_join, op10_url_filter, op11_prefix_trie, op12_warc, op13_collocations)}

ORACLES = {
    "op7_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs WHERE len(ws) >= 13)
), earliest AS (SELECT s, min(doc_id) AS doc FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN earliest USING (s) WHERE doc < doc_id
), every_word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM every_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other
)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op10_url_filter": """
WITH cut AS (
  SELECT page_id, strpos(url, '://') AS cut_at, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN cut_at > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN cut_at > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS o, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
-- crc32: each byte is taken in, then eight shifts (-1)
bits AS (
  SELECT c, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))) AS ops FROM sizes
), shared AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], ops), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM bits
), rebuilt AS (
  SELECT s.c, o.o AS d, o.role, o.text FROM shared s JOIN own o ON o.c = s.base AND o.o <= s.h
  UNION ALL
  SELECT s.c, least(s.h, coalesce(b.n, 0)) + o.o - s.h, o.role, o.text FROM shared s JOIN own o ON o.c = s.c AND o.o > s.h LEFT JOIN sizes b ON b.c = s.base
), steps AS (
  SELECT c, d, length(text) AS n, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM sizes
), nodes AS (SELECT key, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n FROM steps GROUP BY key),
parents AS (SELECT DISTINCT b.key, a.key AS parent FROM steps a JOIN steps b ON a.c = b.c AND b.d = a.d + 1),
children AS (SELECT parent AS key, count(*) AS n_children FROM parents GROUP BY parent),
below AS (SELECT DISTINCT a.key, b.key AS other FROM steps a JOIN steps b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT b.key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n)::BIGINT AS saved_tokens
  FROM below b JOIN nodes n ON n.key = b.other LEFT JOIN children k ON k.key = b.other GROUP BY b.key
), ends AS (
  SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM steps) WHERE d = last GROUP BY key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN children k USING (key) LEFT JOIN ends e USING (key) LEFT JOIN parents p ON p.key = n.key LEFT JOIN nodes q ON q.key = p.parent
""",
    "op12_warc": r"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), parts AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER) AS numbers FROM rows
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(numbers, lambda n: [n // 32768, n // 1024 % 32, n // 32 % 32, n % 32])), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM parts
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), spoken AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), counts AS (
  SELECT lang, k, p, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spoken, (VALUES (1), (2), (3), (4)) AS t(k))
  ) GROUP BY lang, k, p
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(a) AS longer FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS t(m) WHERE m < k
  ) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts i ON i.lang = c.lang AND i.p = c.p WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * c.a
), cuts AS (
  SELECT c.lang, c.p, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c
  JOIN counts x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:j], ' ') JOIN counts y ON y.lang = c.lang AND y.p = array_to_string(c.w[j + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM lowest)
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
