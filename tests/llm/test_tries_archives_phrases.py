"""The prefix trie, WARC archives and phrase mining against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import gzip
import hashlib
import random
import re
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellichor.llm import phrases, prefix_trie, warc

# 11 prefix trie ---------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [t[1:] for t in own.get(c - c % 100, [])[:h] + own[c][h:]]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for top, members in nodes.items():
        below = [x for x in nodes if x[: len(top)] == top]
        parents = {x[:-1] for x in below if x}
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(top))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members), len(top), min(nodes[top[:-1]]) if top else None, len(members), sum(x[:-1] == top for x in below if x), sum(x not in parents for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = [(None, 1, "user", "of no conversation")]
    for conv in [*range(30), *range(100, 120), *range(205, 212)]:  # 200 is absent
        rows += [(conv, None if turn == 0 and conv % 3 == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé😀", None])) for turn in range(rng.randrange(9))]
    rows += [(7, 50, "user", "again"), (7, 50, "user", "again")]  # repeated rows
    rows += [(300, turn, "user", f"a long conversation {turn // 3}") for turn in range(60)]
    return rows


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 3])
def test_trie(spark, talk, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    frame = spark.createDataFrame([(*r, 1, 2) for r in talk], "conv_id long, turn long, role string, text string, depth long, path long").repartition(3)
    found = prefix_trie.trie(frame)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(talk)
    assert prefix_trie.trie(frame.limit(0)).count() == 0


def test_trie_of_equal_conversations_and_blocks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 2)
    rows = [(conv, turn, "user", "same") for conv in [*range(-5, 40), 1000] for turn in range(3)]
    found = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.count() == 4  # the remainder of -5 is -5 as in SQL, so it shares with 0
    last = found.filter("depth = 3").first()
    assert last.n_convs == 46 and last.ends_sha256 == hashlib.sha256(",".join(map(str, [*range(-5, 40), 1000])).encode()).hexdigest()


def test_running_totals_in_blocks(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.randrange(100)) for k in range(3) for p in range((10, 9000, 4096)[k])]
    frame = spark.createDataFrame(rows, "k long, p long, v long")
    sums = {(r.k, r.p): r.t for r in prefix_trie.running(frame, "k", "p", {"t": "v"}, backward=True).collect()}
    xors = {(r.k, r.p): r.t for r in prefix_trie.running(frame, "k", "p", {"t": "v"}, xor=True).collect()}
    for k in range(3):
        own = [v for a, _, v in rows if a == k]
        total, code = sum(own), 0
        for p, v in enumerate(own):
            code ^= v
            assert sums[k, p] == total and xors[k, p] == code
            total -= v


def test_short_conversations_need_few_stages(spark):
    """Each stage has as many tasks as there are partitions, so a small table with many partitions takes as long as there are stages."""
    rng = random.Random(11)
    rows = [(conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a", None])) for conv in range(30) for turn in range(rng.randrange(9))]
    context = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("trie", "trie")
    try:
        prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("trie") for s in tracker.getJobInfo(job).stageIds}
        assert sum(bool(i and i.numCompletedTasks) for i in map(tracker.getStageInfo, stages)) <= 50
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turns_are_numbered_over_parts(spark):
    """A conversation over several parts, with repeated rows, keeps its order."""
    rows = [(conv, turn, "user", f"{conv} {turn}") for conv in (1, 2, 3) for turn in range(40 if conv == 2 else 2)] + [(2, 39, "user", "2 39")]
    ordered = prefix_trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert sorted(r["at"] for r in ordered) == list(range(len(rows)))
    assert [r.conv_id for r in sorted(ordered, key=lambda r: r["at"])] == sorted(r[0] for r in rows)


def test_light_edges_are_few(spark):
    """A comb: without choosing the largest child its paths would be as many levels as it has teeth."""
    rows = [(1000 + conv, turn, "user", "x" if turn < conv else f"tooth {conv}") for conv in range(40) for turn in range(conv + 1)]
    convs, turns = prefix_trie.rebuilt(prefix_trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    walked = prefix_trie.running(turns, "conv_id", "depth", {"p1": "z1", "p2": "z2"}, xor=True)
    nodes = prefix_trie._node_table(convs, walked)
    paths = prefix_trie._heavy_paths(nodes, walked)
    assert paths.count() == nodes.count() == paths.select("depth", "p1", "p2").distinct().count()
    assert paths.agg(F.max("level")).first()[0] <= 6


# 12 WARC ----------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.b/c d\r\nX: y", "<p>hi\r\n\r\nWARC/1.1\r\nü"), (2, None, None), (3, "", ""), (4, "https://x.y?q", "z" * 3_000_000), (5, "u", "z" * 3_000_000), (None, "http://a.b/", "<p>hi\r\n\r\nWARC/1.1\r\nü"),
    (6, "a", "q"), (6, "a", "q"), (None, "n", "only null"), (None, "n", "only null"), (7, "http://h/\t", "WARC/1.1\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n"),
]


def brute_round_trip(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, x in rows if (x or "") == (html or "") and p is not None]
        repeats = bool(equal) and page != max(equal) and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if repeats else "response", max(equal) if repeats else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, first string, id long").repartition(3)


def test_round_trip(pages):
    found = warc.round_trip(pages)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_round_trip(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_are_whole(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "a"), least=5)
    files = list((tmp_path / "a").glob("*.gz"))
    records = warc.read_warc(spark, str(tmp_path / "a"))
    assert records.filter("error is not null").count() == 0
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 11, "metadata": 11, "response": 9, "revisit": 2}
    assert sum(gzip.open(f).read().count(b"\r\nWARC-Record-ID: <urn:uuid:") for f in files) == 33
    rows = warc.captures(records).collect()
    assert len(rows) == 11 and all(r.request.http_status is None and r.response.record_id in r.request.concurrent_to and r.response.record_id in r.metadata.concurrent_to for r in rows)
    texts = sorted((r.response.payload.decode() for r in rows if r.response.type == "response"), key=str)
    assert texts == sorted(["<p>hi\r\n\r\nWARC/1.1\r\nü", "", "", "z" * 3_000_000, "q", "q", "only null", "only null", PAGES[-1][2]], key=str)
    assert all(r.response.headers["warc-refers-to-date"] for r in rows if r.response.type == "revisit")
    assert {r.target_uri for r in rows} >= {"http://a.b/c%20d%0D%0AX:%20y", "http://h/%09", None}


def record(kind, name, block=b"", content="text/plain", concurrent=(), more=()):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"warc-concurrent-to: <{c}>" for c in concurrent), *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A member a record, links written in either record, through the request, or to nothing; members beyond the first; a cut file; a plain file."""
    http = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody"
    parts = [
        record("warcinfo", "i", b"software: x\r\n", "application/warc-fields"),
        record("response", "r1", http, "application/http; msgtype=response", ["q1"]), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "application/http"), record("metadata", "m1", b"a: 1\r\na: 2\r\nb:\r\n 3\r\n", "application/warc-fields", ["q1"], ["X-Long: one", " two"]),
        record("response", "r2", http, "application/http", ["q2", "m2"]), record("request", "q2"), record("metadata", "m2"), record("metadata", "m3", concurrent=["r2"]), record("request", "lost", concurrent=["nobody"]),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc").write_bytes(record("resource", "s", b"bytes\r\n\r\nmore") + b"\r\n" + record("request", "q9", concurrent=["s"]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", "r3", b"whole"))[:-9])
    (tmp_path / "d.warc").write_bytes(record("response", "r4", b"whole") + b"WARC/1.0\r\nContent-Length: 7\r\n\r\nhalf")
    (tmp_path / "e.warc").write_bytes(b"")
    records = warc.read_warc(spark, str(tmp_path)).cache()
    bad = {r.file.rpartition("/")[2]: r.error for r in records.filter("error is not null").collect()}
    assert set(bad) == {"c.warc.gz", "d.warc"} and all("cut off" in e for e in bad.values())
    m1 = records.filter("record_id = '<m1>'").first()
    assert m1.fields == {"a": "1", "b": "3"} and m1.headers["x-long"] == "one two"
    ids = lambda r: r and r.record_id.strip("<>")
    found = {(ids(r.response), ids(r.request), ids(r.metadata)) for r in warc.captures(records).collect()}
    assert {f for f in found if f[0] not in ("r2", "r3", None)} == {("r1", "q1", "m1"), ("s", "q9", None), ("r4", None, None)}
    assert {x for f in found for x in f if x} >= {"r2", "q2", "m2", "m3", "lost"} and (None, "lost", None) in found
    assert sum(f[0] == "r2" and f[1] == "q2" and f[2] in ("m2", "m3") for f in found) == 1
    assert records.filter("record_id = '<r1>'").first().http_status == 404 and records.filter("record_id = '<s>'").first().payload == b"bytes\r\n\r\nmore"


# 13 phrases -------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, shown):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        best = []
        for p, a in candidates.items():
            if 100 * longer[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:shown])]
    return sorted(out)


@pytest.fixture(scope="module")
def sayings():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("ab cd EF é😀 the of".split()) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\r\n"]) for _ in range(n))
    rows = [(say(rng.randrange(200)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    return [*rows, *rows[:5], (None, None), ("", "en"), ("...", "xx"), ("a b c d " * 500, "en"), ("never,a,phrase," * 100, "fr"), (say(5000), "en")]


@pytest.mark.parametrize("cut", [phrases.SLICE, 700, 40])
def test_phrases(spark, sayings, cut, monkeypatch):
    for name, value in {"SLICE": cut, "EXPAND": cut, "SHOWN": 40}.items():
        monkeypatch.setattr(phrases, name, value)
    frame = spark.createDataFrame([(t, x, 1, "k") for t, x in sayings], "text string, lang string, f long, key string").repartition(3)
    found = phrases.collocations(frame)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(sayings, phrases.MIN, 40)
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_a_full_filter_loses_nothing(spark, sayings, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    frame = spark.createDataFrame(sayings, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(frame).collect())) == brute_phrases(sayings, phrases.MIN, phrases.SHOWN)


def test_scores_are_exact_beyond_64_bits(spark):
    a, most = 9_000_000_000_000_000, 9_000_000_000_000_001
    frame = spark.createDataFrame([(1, 2, 0, 0, 2, a)], "w1 long, w2 long, w3 long, w4 long, size int, a long")
    every = spark.createDataFrame([(1, 0, 0, 0, most), (2, 0, 0, 0, a)], "w1 long, w2 long, w3 long, w4 long, f long")
    assert phrases.scored(frame, every).first().score == 2_000_000 * a // (a + most) == 999_999


def test_memory_of_a_shard():
    """Counting takes little beside a shard: an executor's workers share what its heap leaves."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 12))) for _ in range(20000)]
    text = " ".join(rng.choices(words, range(len(words), 0, -1), k=(4 << 20) // 8))
    batch = pa.RecordBatch.from_pydict({"text": [text[i : i + 2000] for i in range(0, len(text), 2000)], "lang": ["en"] * -(-len(text) // 2000)})

    class Sent:
        every = phrases.Filter(phrases.LEAST_BITS)
        every.set[:] = ~every.set
        value = every.bits, every.set

    for work in (phrases.vocabulary, phrases.counted(Sent, None)):
        tracemalloc.start()
        counts = sum(int(found.column("f").to_numpy().sum()) for found in work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert counts > 400_000
        assert peak < 35 * phrases.SLICE, work
