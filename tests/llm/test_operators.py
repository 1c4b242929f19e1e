"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellichor.llm import across, chat_format, components, decontamination, jaccard_join, line_dedup, media, packing, substring_dedup, token_files, toxicity, url_filter

DOCS = "doc_id long, text string, source string, key string, place long"  # clashing names on purpose
WORDS = [f"w{i}" for i in range(40)]


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    fresh = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    shared, out = fresh(60), []
    for i in range(40):
        kind = i % 8
        if kind == 0:
            out.append(fresh(120))
        elif kind == 1:
            out.append(out[rng.randrange(len(out))])
        elif kind == 2:
            w = (out[rng.randrange(len(out))] or "x").split(" ")
            for _ in range(2):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(fresh(30) + "\n" + shared + "\t" + fresh(11))
        elif kind == 4:
            out.append(fresh(rng.randrange(1, 9)).upper())
        elif kind == 5:
            out.append("a " * rng.randrange(5, 40))
        elif kind == 6:
            out.append(shared + "  " + fresh(200))
        else:
            out.append([None, "", " \n\t ", "ünï ✓ 😀 " * 5, fresh(3000)][(i // 8) % 5])
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None, "x", -1) for i, t in enumerate(texts)], DOCS).repartition(5)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# 1 decontamination ------------------------------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_leaks(documents, items):
    out = set()
    for d, text in documents:
        h = tokens(text)
        for i, item in items:
            b = tokens(item)
            window, tolerance = min(13, len(b)), 2 if len(b) >= 13 else 0
            if not b:
                continue
            for diagonal in range(-len(b), len(h)):
                equal = [b[q] == h[q + diagonal] for q in range(max(0, -diagonal), min(len(b), len(h) - diagonal))]
                if any(sum(equal[s : s + window]) >= window - tolerance for s in range(len(equal) - window + 1)):
                    out.add((d, i))
    return out


def test_masks_hit_every_pattern():
    for pattern in itertools.combinations(range(decontamination.WINDOW), decontamination.TOLERANCE):
        assert any(not {o + p for p in mask} & set(pattern) for mask in decontamination.MASKS for o in range(decontamination.WINDOW - mask[-1]))


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WORDS, 0])
def test_leaks(spark, bound):
    rng = random.Random(3)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate((20, 13, 30, 9, 5, 14))] + [(6, None), (7, ""), (8, "alone"), (9, "two words"), (10, "two words"), (11, " ".join(WORDS[:6]))]
    documents = [(0, None), (1, ""), (2, "Hello world")]
    for k, (_, item) in enumerate(items[:6]):
        for changes in range(4):
            w = item.split()
            for at in rng.sample(range(len(w)), min(changes, len(w))):
                w[at] = "other"
            documents.append((10 + 4 * k + changes, " ".join([*say(25), *w, *say(25)]).upper() + "."))
    documents += [(50, "we two words say"), (51, "Alone"), (52, "not alone, words two"), (53, " ".join(["x", *WORDS[:6]]))]
    documents.append(documents[4])
    frame = spark.createDataFrame([(d, t, "x") for d, t in documents], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(frame, bench, broadcast_words=bound).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(documents, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert decontamination.leaks(frame.limit(0), bench).count() == 0 == decontamination.leaks(frame, bench.limit(0)).count()
    assert {r.doc_id for r in decontamination.clean(frame, bench).collect()} == {d for d, _ in documents} - {d for d, _ in brute_leaks(documents, items)}


def test_leaks_without_ids(spark):
    """Documents and items without an id leak as others do; equal texts without an id are one document, different ones are told apart."""
    rng = random.Random(31)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item, other = say(20), say(25)
    rows = [(None, f"a {item} b", 1), (None, f"a {item} b", 2), (None, f"c {item}", 3), (None, "few words", 4), (None, None, 5), (1, item, 6), (2, "clean", 7), (3, f"x {other}", 8), (None, "clean too", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc int").withColumn("unnamed", F.lit(0)).withColumn("item", F.lit("x"))
    bench = spark.createDataFrame([(None, other), (0, item), (None, item), (None, None)], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()), key=str)
    assert found == sorted([(None, 0), (None, None), (None, 0), (None, None), (1, 0), (1, None), (3, None)], key=str)
    kept = decontamination.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc for r in kept.collect()) == [4, 5, 7, 9]


def test_no_python_in_leaks(docs, spark):
    plan = decontamination.leaks(docs, spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2 line dedup -----------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """Kept texts by exact all-pairs Jaccard and transitive closure."""
    lines = [(d, i, " ".join(x.split()).lower()) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    sets = [line_dedup.shingles(x[2]) for x in lines]
    root = list(range(len(lines)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(lines)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    gone = {lines[k][:2] for k in range(len(lines)) if find(k) != k}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["row", "places", "n_lines", "n_removed", "given", "line_no", "node", "norm", "stays", "copies", "a.b"]
    rows = [(d, f"one line of words here {d // 2}\nanother line", *(f"{n}{d}" for n in names)) for d in range(4)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    found = line_dedup.dedup_lines(frame)
    assert found.columns == frame.columns
    wanted = brute_lines([r[:2] for r in rows])
    assert {tuple(r) for r in found.collect()} == {(r[0], wanted[r[0]], *r[2:]) for r in rows}
    assert line_dedup.dedup_lines(frame.drop("n_lines", "n_removed")).columns == [c for c in frame.columns if not c.startswith("n_")] + ["n_lines", "n_removed"]


def test_line_dedup(spark, no_docs):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))
    base = [say(rng.randrange(1, 25)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "ab\nab\nAB  "), (4, "one line")]
    for d in range(5, 45):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                line = line.replace(line[len(line) // 2 :][:3], "zz", 1)
            lines.append(line if rng.random() < 0.6 else say(12))
        rows.append((d, "\n".join(lines)))
    frame = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], DOCS).repartition(4)
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    wanted = brute_lines(rows)
    assert set(found) == set(wanted)
    differing = [d for d in wanted if wanted[d] != found[d]]
    assert not differing, differing
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_of_white_space_and_case(spark):
    """Variants in case and white space of one line, short and long ones, are alike; lines of white space stay."""
    gap = " " * 40
    short = ["a b", "A\tB", f"a{gap}b", f"\tA{gap}\t{gap}B\r", f"a{gap} B", "a c", f"A{gap}C"]
    long = ["İstanbul and a line of some words", "İSTANBUL and a LINE of some words", f"\tİstanbul  and a line{gap}of some\twords\r", "another line that is like no other"]
    blank = ["\t" * 50, f"{gap}\r", "\t", " \f \v "]
    rows = [(d, x) for d, x in enumerate([*short, *long, *blank, *(f"a{' ' * k}b" for k in range(30, 60)), "\n".join([*short, *blank, *long])])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == brute_lines(rows)


def test_line_dedup_moves_the_texts_of_candidates_only(spark, monkeypatch):
    """What verification reads again are the lines that share a bucket, not all."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(d, word(60)) for d in range(300)] + [(400 + d, f"the same line but for its end, which is this number: {d}") for d in range(3)]
    kept = []
    monkeypatch.setattr(line_dedup, "staged", lambda df, *a, f=line_dedup.staged, **b: kept.append(f(df, *a, **b)) or kept[-1])
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(rows)
    assert [df.count() for df in kept if df.columns == ["node", "norm"]] == [3]


def test_line_dedup_leaves_texts_in_the_jvm(spark):
    """Lines go by Spark's expressions: no whole text is sent to a Python process, and bytes stay as they are."""
    line = "the same line in many of the documents, long enough for shingles"
    rows = [(0, line), (1, line), (2, f"{line}\n"), (3, f"\n{line}\n\nother\n{line}"), (4, f"a\n\u00e9\U0001f600 z\n{line}\nb\n"), (5, ""), (6, None), (7, f"{line}\n{line}"), (8, f"\n{line}\r\n \n"), (9, "\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    broken = spark.range(1).selectExpr("10 as doc_id", f"cast(concat(unhex('C3'), cast('\\n{line}\\n' as binary), unhex('FF41')) as string) as text")
    found = line_dedup.dedup_lines(frame.unionByName(broken))
    got = {r.doc_id: (r.text and bytes(r.text), r.n_lines, r.n_removed) for r in found.withColumn("text", F.col("text").cast("binary")).collect()}
    texts = {0: line, 1: "", 2: "", 3: "\n\nother", 4: "a\n\u00e9\U0001f600 z\nb\n", 5: "", 6: None, 7: "", 8: "\n \n", 9: "\n\n"}
    gone = {1: 1, 2: 1, 3: 2, 4: 1, 7: 2, 8: 1}
    assert got == {k: (None if t is None else t.encode(), 0 if t is None else dict(rows)[k].count("\n") + 1, gone.get(k, 0)) for k, t in texts.items()} | {10: (b"\xc3\n\xffA", 3, 1)}
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_boilerplate(spark):
    """Pairs of lines that share most of their text with all other pairs: in a bucket a line's partner is rarely the first or the previous one."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared, rows = word(200), []
    for d in range(0, 600, 2):
        own = word(28)
        rows += [(d, shared + own + word(12)), (d + 1, shared + own + word(12))]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, "s", "x", 1) for d, t in rows], DOCS).repartition(4)
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert found == brute_lines(rows)


def test_minhash_recall():
    rng, hits, n = random.Random(1), 0, 400
    for _ in range(n):
        line = "".join(rng.choice("abcdefghij ") for _ in range(200))
        other = line[:100] + "".join(rng.choice("xyz") for _ in range(8)) + line[108:]
        a, b = line_dedup.minhashes([line, other])
        hits += any((a[k : k + 4] == b[k : k + 4]).all() for k in range(0, line_dedup.BINS, 4))
    assert hits / n > 0.97


def test_overlaps_are_those_of_sets():
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab é😀") for _ in range(rng.randrange(8, 60))) for _ in range(400)]
    left, right = lines[:200], [x if k % 9 == 0 else lines[k][:30] + x for k, x in enumerate(lines[200:])]
    both, either = line_dedup.overlaps(left, right)
    for x, y, i, u in zip(left, right, both, either):
        a, b = line_dedup.shingles(x), line_dedup.shingles(y)
        assert (i, u) == (len(a & b), len(a | b))


def test_line_dedup_recall_on_hard_families(spark):
    """Families of variants, two words of fourteen changed in each: of the lines that exact links remove, nearly all go. Equal rows, null ids and a very long line beside them."""
    rng, rows = random.Random(21), []
    for _ in range(12):
        base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(14)]
        for _ in range(60):
            w = list(base)
            for at in rng.sample(range(14), 2):
                w[at] = "".join(rng.choice("qrstuvwxyz") for _ in range(7))
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    wanted = brute_lines(rows)
    odd = [(5000, "y" * 300_000 + "\nshort"), (5001, "short"), (5001, "short"), (None, "own line of nobody"), (None, "own line of nobody")]
    frame = spark.createDataFrame([*rows, *odd], "doc_id long, text string").repartition(4)
    out = line_dedup.dedup_lines(frame).collect()
    found = {r.doc_id: r.text for r in out if r.doc_id is not None and r.doc_id < 5000}
    gone = {d for d, t in wanted.items() if not t}
    assert all(found[d] == wanted[d] for d in wanted if wanted[d])
    assert len({d for d in gone if not found[d]}) >= 0.97 * len(gone)
    assert sorted((r.doc_id or 0, len(r.text)) for r in out if r.doc_id is None or r.doc_id >= 5000) == [(0, 18), (0, 18), (5000, 300_006), (5001, 0), (5001, 0)]


# 3 packing --------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, texts, no_docs):
    out = packing.pack(docs, capacity=100).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_words for r in rows) == len(words_of(t)) and [r.begin for r in rows] == [100 * k for k in range(len(rows))]
        assert all((r.bin is None) == (r.n_words == 0) for r in rows)
    bins = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        assert sum(r.n_words for r in rows) <= 100
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == [sum(x.n_words for x in rows[:k]) for k in range(len(rows))]
        named = [f"s{r.doc_id % 3}" for r in rows if r.doc_id % 5]
        assert len(named) == len(set(named)) and len({texts[r.doc_id] for r in rows}) == len(rows)
    assert packing.pack(no_docs).count() == 0


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(2)
    for _ in range(30):
        bins, plain = packing.Bins(50), []
        for _ in range(60):
            n, s, c = rng.randrange(1, 51), 1 << rng.randrange(4) if rng.random() < 0.8 else 0, 1 << rng.randrange(20)
            fits = [b for b in plain if b[1] >= n and not b[2] & s and not b[3] & c]
            number, _ = bins.place(n, s, c)
            if fits:
                chosen = next((b for b in plain if b[0] == number), None)
                assert chosen in fits and chosen[1] == min(b[1] for b in fits)
            else:
                assert number == len(plain)
                chosen = [number, 50, 0, 0]
                plain.append(chosen)
            chosen[1] -= n
            chosen[2] |= s
            chosen[3] |= c


# 4 toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity(spark, no_docs):
    rng = random.Random(4)
    bad = ["vilewretch", "scoundrel", "filthmonger", "dimwit"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) + rng.choice("abcdefg") * 3 for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(bad))
        rows.append((i, " ".join(w), "s", "x", 0))
        labels.append((i, int(i % 4 == 0)))
    rows += [(400, None, None, None, None), (401, "", "s", "x", 0), (402, "x " * 200_000, "s", "x", 0), (0, rows[0][1], "s", "x", 0)]
    frame, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known, "crc32(cast(doc_id as string)) % 5 <> 0")
    found = toxicity.score(frame, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert {r.doc_id for r in toxicity.keep_ordinary(frame, model).collect()} == {r.doc_id for r in found if not r.predicted}
    assert toxicity.fit(frame, known.filter("toxic = 0")).constant == 0.0 and toxicity.fit(no_docs, known).constant == 0.0
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_score_by_plain_recomputation(spark):
    """Every score again from the model's two dictionaries: windows by regular expression, one compression each, thresholds by hand."""
    import zstandard

    rng = random.Random(14)
    rows = [(i, " ".join((["vilewretch", "filthmonger"][i % 2] if i % 3 == 0 and k % 9 == 4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))) for k in range(50))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "Été. VILEWRETCH, 12 ,, naïve-" * 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert b" vilewret" in model.toxic and b" vilewret" not in model.ordinary

    def size(window, content):
        held = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = toxicity.parameters(len(content + toxicity.TAIL))
        held.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(window))

    found = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, text in [*rows[:12], *rows[300:]]:
        plain = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
        differences = [0] * (toxicity.HIGHEST - toxicity.LOWEST + 1)
        for k in range(0, len(plain), toxicity.WINDOW):
            window = b" " + b" ".join(plain[k : k + toxicity.WINDOW]) + b" " + toxicity.TAIL
            shorter = size(window, model.ordinary) - size(window, model.toxic + model.ordinary)
            differences[max(toxicity.LOWEST, min(toxicity.HIGHEST, shorter)) - toxicity.LOWEST] += 1
        logit = model.weights[0] + sum(w * np.log1p(n) for w, n in zip(model.weights[1:], [*differences, sum(differences)]))
        assert abs(found[i] - 1 / (1 + np.exp(-logit))) < 1e-9


# 5 chat formatting ------------------------------------------------------------------------------------------------


def brute_cost(roles):
    """Least cost over all role assignments."""
    best = float("inf")
    for labels in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0.0, 0
        for given, label in zip(roles, labels):
            cost += chat_format.RELABEL * (label != given)
            if state == label + 1:
                cost += chat_format.MERGE
            elif chat_format.NEEDS[state][label] is None:
                cost = float("inf")
                break
            else:
                cost += chat_format.INSERT * len(chat_format.NEEDS[state][label])
            state = label + 1
        best = min(best, cost + chat_format.END[state])
    return best


def legal(rendered):
    roles = re.findall(r"<\|(system|user|assistant)\|>\n", rendered)
    body = roles[1:] if roles[0] == "system" else roles
    return body and body == [("user", "assistant")[k % 2] for k in range(len(body))] and len(body) % 2 == 0


def test_chat_format(spark, monkeypatch):
    rng = random.Random(6)
    names = ["system", "user", "assistant", "tool", None]
    talks = {c: [rng.choice(names) for _ in range(rng.randrange(1, 6))] for c in range(60)}
    rows = [(c, t, r, None if t == 2 else f"{c}-{t}") for c, roles in talks.items() for t, r in enumerate(roles)]
    rows += [(999, t, rng.choice(names), "x" * (t % 5)) for t in range(400)]  # one hot conversation over all partitions
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ord int").repartition(6)
    found = chat_format.repair(frame)
    out = found.collect()
    assert sorted((r.conv_id, r.turn) for r in out) == sorted(r[:2] for r in rows)
    talk = {r.conv_id: r for r in chat_format.rendered_conversations(found).collect()}
    number = {"system": 0, "user": 1, "assistant": 2}
    for c, roles in talks.items():
        assert talk[c].cost == brute_cost([number.get(r, -1) for r in roles]), (c, roles, talk[c])
        assert legal(talk[c].rendered)
    assert legal(talk[999].rendered)
    whole = [number.get(r[2], -1) for r in rows if r[0] == 999]
    assert talk[999].cost == chat_format.to_go(np.array(whole), chat_format.END)[0][0]
    monkeypatch.setattr(chat_format, "ROWS_PER_PARTITION", 40)
    finer = {r.conv_id: r.rendered for r in chat_format.rendered_conversations(chat_format.repair(frame)).collect()}
    assert finer == {c: r.rendered for c, r in talk.items()}
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat_format.repair(twice).count() == 3 and chat_format.repair(frame.limit(0)).count() == 0


# 6 media ----------------------------------------------------------------------------------------------------------


def test_media_padded_with_silence(spark, monkeypatch):
    """The silences meet at an offset of too short an overlap, with more hits than the true offset has."""
    rng = np.random.default_rng(6)
    music = rng.integers(-(1 << 31), 1 << 31, 60).astype(np.int32)
    noisy = music.copy()
    noisy[np.arange(60) % 4 != 0] ^= 1 << 7  # runs of KEY equal marks are left at few places
    noisy[20:30] = music[20:30]
    silence = np.full(30, 5, np.int32)
    marks = {0: np.concatenate([silence, music]), 1: np.concatenate([noisy, silence])}
    frame = spark.createDataFrame([(k, m.tolist()) for k, m in marks.items()], "id long, marks array<int>")
    monkeypatch.setattr(media, "fingerprints", lambda _: frame)
    found = {r.id: (r.query_id, r.offset) for r in media.align(frame).collect()}
    assert found == {0: (None, None), 1: (0, -30)}


def test_media(spark):
    rng = np.random.default_rng(8)
    base = [media.tones(rng.normal(0, 0.125, 64)) for _ in range(60)]
    rows = [(i, b.tobytes(), "x") for i, b in enumerate(base)]
    moved = np.concatenate([rng.normal(0, 500, media.HOP * 6).astype("<i2"), base[20]])
    noisy = (base[40] + rng.normal(0, 300, len(base[40]))).astype("<i2")
    rows += [(100, base[0].tobytes(), "x"), (101, moved.tobytes(), "x"), (103, noisy.tobytes(), "x"), (104, None, "x"), (105, b"", "x"), (106, b"\0" * 40_000, "x"), (107, b"\0" * 40_000, "x"), (0, base[0].tobytes(), "x")]
    frame = spark.createDataFrame(rows, "id long, pcm binary, class_id string")
    out = media.align(frame).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    of = {r.id: r for r in out}
    assert of[100].class_id == of[0].class_id == 0 and of[106].class_id == of[107].class_id and of[104].class_id == of[105].class_id
    assert (of[101].query_id, of[101].offset) == (20, 6) and (of[103].query_id, of[103].offset) == (40, 0)
    marks = {r.id: np.array(r.marks, np.int32) for r in media.fingerprints(frame).collect()}
    wanted = {(q, r) for q in (0, 20, 40) for r in marks if of[r].class_id not in (of[q].class_id,) and any(n >= media.OVERLAP and e / 32 / n <= media.ERROR for e, n in (media.bit_errors(marks[q], marks[r], o) for o in range(-80, 81)))}
    found = {(r.query_id, r.id) for r in out if r.query_id in (0, 20, 40)}
    assert len(wanted & found) >= 0.9 * len(wanted) and found <= wanted
    assert media.align(frame.limit(0)).count() == 0


# 7 substring dedup ------------------------------------------------------------------------------------------------


def brute_repeats(rows, k=13):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode())
    return out


def test_cover():
    for a in range(7):
        for b in range(7):
            assert any((a + k) % 7 in substring_dedup.COVER and (b + k) % 7 in substring_dedup.COVER for k in range(7))


def test_substring_dedup(spark, docs, texts, no_docs):
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == brute_repeats(list(enumerate(texts)))
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_dedup_in_small_slices_and_with_repeated_ids(spark, docs, texts, monkeypatch):
    rows = [(3, texts[3]), (3, texts[6]), (1, texts[6]), (None, texts[6]), (9, "q " * 100), (8, "q " * 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id if r.doc_id is not None else 10**6, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame, texts=False).collect())
    n6, n3 = len(words_of(texts[6])), len(words_of(texts[3]))
    shared = len([w for w in words_of(texts[3]) if w in set(words_of(texts[6]))])
    assert out == sorted([(1, n6, 0), (3, n6, n6), (3, n3, out[[x[1] for x in out].index(n3)][2]), (10**6, n6, n6), (9, 100, 100), (8, 100, 0)]) and shared


# 8 token files ----------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, texts, no_docs, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    plain = Tokenizer.from_file(path)
    odd = [*texts, "a  b", "end ", "don't!!\n\n x", "x\u00a0y ", "<|endoftext|> z", "a .b", "..\n,", "x²y Ⅷ _a._", "\n \n", " 'll", "naïve, e\u0301t."]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, row string").repartition(3)
    start, wanted = 0, []
    for i, t in enumerate(odd):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_files(frame).collect())) == wanted
    token_files.write_tokens(frame, str(tmp_path / "t"), path)
    some = token_files.read_tokens(spark, str(tmp_path / "t"), "doc_id between 2 and 4").collect()
    assert sorted(r.doc_id for r in some) == [2, 3, 4] and all(len(r.ids) == r.n_tokens for r in some)
    assert token_files.token_files(no_docs).count() == 0


def test_encoder_agrees_with_the_library_on_random_strings(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, path = random.Random(5), token_files.default_tokenizer()
    signs = ["a", "b", "Z", "é", "ß", "×", "÷", "\u00a0", "\u3000", "\u0085", "\u0301", "1", "²", "Ⅷ", " ", "  ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", ".", ",", "'", "'s", "'ll", "!", "-", "_", "😀", "ж", "<|endoftext|>", "\x7f", "\x00", "ÿ"]
    texts = ["foo\n\n", "a\n", "\n", ""] + ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for size, cache in ((token_files.SLICE, token_files.CACHE), (999, 50)):
        monkeypatch.setattr(token_files, "SLICE", size)
        monkeypatch.setattr(token_files, "CACHE", cache)
        found = [x.tolist() for _, _, ids, n in token_files.Encoder(path).encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert found == wanted


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello there, WORLD", "", "a  b\n"]
    encoder = token_files.Encoder(path)
    assert not encoder.in_pieces
    found = [x.tolist() for _, _, ids, n in encoder.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert found == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(None, "b c"), (None, "a"), (3, "x y z"), (3, "x y z"), (3, None), (1, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(token_files.token_files(frame).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, None, 1, 3, 3, 3]
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]


def test_token_files_encodings_row_groups_and_page_indexes(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "ROW_GROUP", 1 << 18)
    monkeypatch.setattr(token_files, "PAGE", 16 << 10)
    rng = random.Random(2)
    frame = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(300))) for k in range(3000)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame, path, token_files.default_tokenizer())
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    assert files
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings), (column.path_in_schema, column.encodings)
    # A selective read decodes a small part of the rows: Spark counts those that its scan yields.
    some = token_files.read_tokens(spark, path, "doc_id = 1500")
    rows = some.collect()
    assert [r.doc_id for r in rows] == [1500] and "GreaterThan" not in str(rows)
    plan = some._jdf.queryExecution().executedPlan()
    scan = plan
    while scan.children().size():
        scan = scan.children().apply(0)
    some._jdf.queryExecution().executedPlan().executeCollect()
    assert scan.metrics().apply("numOutputRows").value() < 1500


# 9 Jaccard join ---------------------------------------------------------------------------------------------------


def brute_links(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("heavy", [16, 2])
def test_jaccard_join(spark, docs, texts, no_docs, heavy, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    rng = random.Random(11)
    boiler = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60))
    more = []
    for k in range(60):  # a large group of near copies, boilerplate with own endings, and small sets
        w = boiler.split(" ")
        if k % 3 == 0:
            w[rng.randrange(60)] = f"n{k}"
            more.append(" ".join(w))
        elif k % 3 == 1:
            more.append(boiler + " " + " ".join(f"o{k}x{j}" for j in range(rng.randrange(5, 60))))
        else:
            s = [f"t{j}" for j in range(rng.randrange(6, 20))]
            more.append(" ".join(s))
    rows = [*enumerate(texts), *((100 + k, t) for k, t in enumerate(more))]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame).collect()}
    assert found == brute_links(rows)
    assert jaccard_join.link_documents(no_docs).count() == 0


def test_across_deals_a_hot_key_in_blocks(spark, monkeypatch):
    """One key holds all sets: no cell may hold more than about two blocks, and the pairs are those of all against all."""
    rng = np.random.default_rng(4)
    shared = rng.integers(1, 1 << 62, 80).astype(np.uint64)
    sets = [np.concatenate([shared, rng.integers(1, 1 << 62, 5 + k % 25).astype(np.uint64)]) for k in range(300)]
    rows = [(7, k, len(x), k // 2, across.parity(x)) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key long, node long, n long, comp long, bitmap binary").repartition(4)
    monkeypatch.setattr(across, "BLOCK", 30)
    cells = across.dealt(frame).groupBy("cell").count().collect()
    assert len(cells) == 10 * 11 // 2 and max(r["count"] for r in cells) < 120
    found = {(r.a, r.b) for r in across.candidates(frame, 4).collect()}

    def may(a, b):
        apart = int(np.bitwise_count(np.frombuffer(rows[a][4], np.uint8) ^ np.frombuffer(rows[b][4], np.uint8)).sum())
        both = len(sets[a]) + len(sets[b])
        return 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 7 * ((both - apart) // 2) >= 3 * both

    assert found == {(a, b) for a, b in itertools.combinations(range(300), 2) if a // 2 != b // 2 and may(a, b)}


@pytest.mark.parametrize("module", [line_dedup, jaccard_join])
def test_groups_short_of_the_similarity_send_no_square_of_pairs(spark, monkeypatch, module):
    """Couples with a common beginning, each just short of linking with all others: pairs sent to be verified grow with the rows."""
    rng, sent = random.Random(6), []
    of_lines = module is line_dedup
    part = (lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) if of_lines else (lambda n: "".join(f" w{rng.randrange(10**6)}" for _ in range(n)))
    base, rows = part(247 if of_lines else 124), []
    for d in range(0, 240, 2):
        own = part(30 if of_lines else 15)
        rows += [(d, base + own + part(12 if of_lines else 6)), (d + 1, base + own + part(12 if of_lines else 6))]
    real = module.links_across

    def counted(members, sets, known, verify, *more):
        def told(pairs):
            sent.append(pairs.count())
            return verify(pairs)

        return real(members, sets, known, told, *more)

    monkeypatch.setattr(module, "links_across", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if of_lines:
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == brute_lines(rows)
    else:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame).collect()} == brute_links(rows)
    assert sent and sum(sent) <= 12 * len(rows), sent


def test_settled_links_join_what_all_links_join(spark, monkeypatch):
    """In one block and in many: fewer links than rows of a cell, and the components of all pairs that link."""
    rng = np.random.default_rng(14)
    shared = rng.integers(1, 1 << 62, 90)
    sets = [np.unique(np.concatenate([shared[: 60 + k % 31], rng.integers(1, 1 << 62, 5 + k % 17)])) for k in range(150)]
    rows = [(key, k, len(x), k // 3, x.tolist()) for key in (7, 8) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key long, node long, n long, comp long, elements array<long>").repartition(4)
    every = [(a, b) for a, b in itertools.combinations(range(150), 2) if a // 3 == b // 3 or 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]
    together = [(k, k - k % 3) for k in range(150)]
    joined = lambda edges: {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for elements in (1 << 20, 2500):
        monkeypatch.setattr(across, "ELEMENTS", elements)
        cells = across.dealt(frame, "elements").select("cell").distinct().count()
        found = [(r.a, r.b) for r in across.settled(frame, 4).collect()]
        assert (cells == 2) == (elements > 2500) and len(found) < 50 * cells
        assert all(4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b])) for a, b in found)
        assert joined([*found, *together]) == joined([*every, *together])


def test_merged_components(spark):
    rng = random.Random(3)
    first, more = ([(rng.randrange(80), rng.randrange(80)) for _ in range(30)] for _ in range(2))
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    whole = {r.node: r.component for r in components.components(frame(first + more)).collect()}
    found = components.merged(components.components(frame(first)), frame(more)).collect()
    assert len(found) == len(whole) and {r.node: r.component for r in found} == whole


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (5, 4), (500, 400)] + [(1000, k) for k in range(1001, 1100)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: find(k) for k in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10 URL filters ---------------------------------------------------------------------------------------------------


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    glob = lambda s: "".join("[\\s\\S]*" if c == "*" else "[\\s\\S]" if c == "?" else re.escape(c) for c in s)
    fits = [r for r in rules if re.fullmatch("(?:[\\s\\S]*\\.)?" + glob(r.host), host) and re.match(glob(r.path), path)]
    best = max(fits, key=lambda r: len(r.name)) if fits else None
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter(spark):
    rng = random.Random(12)
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.example.org/es/x?y=/de/", "http://example.org/en/1", "http://xexample.org/en/1", "x://a.com/de/://b", "http://h/.org/", "http://com/fr/é", "http://" + "a" * 5000 + ".com/de/"]
    urls += ["".join(rng.choice(["http", "://", "a", ".", "org", "com", "example", "/", "de/", "fr/", "es/", "?", "#", "N", "é"]) for _ in range(9)) for _ in range(400)]
    frame = spark.createDataFrame([(k % 390, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    wild = (*url_filter.RULES, *(url_filter.Rule("block", f"h{k}*.long-name-{k}.org", f"/p?th{k}/*x") for k in range(9)), url_filter.Rule("block", "a*", "/d*/"))
    for rules in (url_filter.RULES, wild):
        found = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(frame, rules).collect())
        wanted = sorted((k % 390, h, p, r or "", v) for k, (h, p, r, v) in enumerate(plain_judge(u, rules) for u in urls))
        assert found == wanted
    assert url_filter.judge_urls(frame.limit(0)).count() == 0 and url_filter.judge_urls(frame, ()).filter("verdict = 'allow'").count() == len(urls)
