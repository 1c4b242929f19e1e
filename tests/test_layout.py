"""Pages, pieces of text, ordered folds and versions against plain replays of their rules."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from vellichor.operators import ordered, rebase, render, undo
from vellichor.sources import epub, pdf_items
from vellichor.streaming import timer

# pages --------------------------------------------------------------------------------------------------------------

LINE = "doc_id long, page long, line long, text string, x0 double, x1 double, y double, size double"


def plain_heads(pages):
    key = lambda text: re.sub(r"\d+", "#", text).lower()
    many = max(3, len(pages) // 4)
    tops, bottoms = [key(p[0][0]) for p in pages if p], [key(p[-1][0]) for p in pages if p]
    number = re.compile(r"\s*[-–—\[(]?\s*(?:seite\s+|page\s+)?(?:\d{1,4}|[ivxlcdm]{1,7})\s*[-–—\])]?\s*", re.I)
    out = []
    for page in pages:
        rest = list(page)
        while rest and (number.fullmatch(rest[0][0]) or tops.count(key(rest[0][0])) >= many):
            rest.pop(0)
        while rest and (number.fullmatch(rest[-1][0]) or bottoms.count(key(rest[-1][0])) >= many):
            rest.pop()
        out.append(rest)
    return out


def upper_median(values, otherwise):
    return sorted(values)[len(values) // 2] if values else otherwise


def plain_paragraphs(pages):
    """Lines are (text, x0, x1, y, size)."""
    lines = [(*line, number) for number, page in enumerate(pages) for line in page]
    half = lambda v: int(v * 2 + 0.5) / 2
    body = upper_median([half(x[4]) for x in lines if len(x[0]) > 20], 10)
    inner = [x for x in lines if abs(x[4] - body) < body * 0.15]
    starts = [int(x[1] + 0.5) for x in inner]
    margin = min(starts, key=lambda s: (-starts.count(s), s)) if starts else 0
    width = upper_median([x[2] - margin for x in inner if len(x[0]) > 20], 400)
    gap = upper_median([a[3] - b[3] for p in pages for a, b in zip(p, p[1:]) if 0 < a[3] - b[3] < body * 3], body * 1.2)
    heading = lambda x: x[4] >= body * 1.2
    alone = lambda x: heading(x) or (x[1] - margin > body * 2 and abs((x[1] - margin) - (margin + width - x[2])) < body * 3)
    out = []
    for i, x in enumerate(lines):
        opens = True
        if i:
            before = lines[i - 1]
            far = before[5] == x[5] and before[3] - x[3] > gap * 1.6
            run = alone(x) and alone(before) and heading(x) == heading(before) and not far
            indent = x[1] - margin > body * 0.8 and not alone(x)
            short = before[2] - margin < width * 0.72 and re.search(r"[.!?…:»«\"'”“]\s*$", before[0])
            opens = not run and bool(alone(x) or alone(before) or far or indent or short)
        if opens:
            out.append([x[0], "h2" if heading(x) else "p", x[5]])
        elif re.search(r"[a-zäöüß][-­‐‑]$", out[-1][0], re.I) and x[0][0].islower():
            out[-1][0] = out[-1][0][:-1] + x[0]
        else:
            out[-1][0] += " " + x[0]
    return [tuple(p) for p in out]


def book_of_pages(rng, n_pages):
    pages = []
    for page in range(n_pages):
        y, rows = 760.0, []
        if page % 7 != 3:
            rows += [(f"Der Band, Seite {page}", 50.0, 140.0, 780.0, 8.0), (rng.choice([f"- {page} -", "xiv", f"Seite {page}"]), 200.0, 220.0, 768.0, 8.0)]
        for _ in range(rng.randrange(0, 14)):
            y -= rng.choice([12.0, 12.0, 12.0, 12.5, 30.0])
            kind = rng.random()
            words = " ".join(rng.choice(["wort", "Fluss", "ein", "sehr", "blatt."]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "-", "«", "‐"])
            size = 14.0 if kind < 0.08 else rng.choice([10.0, 10.2, 9.9])
            x0 = 50.0 + (12 if 0.1 < kind < 0.2 else 75 if 0.2 < kind < 0.3 else rng.choice([0.0, 0.2]))
            rows.append((words, x0, x0 + 5.0 * len(words) if kind > 0.3 or kind < 0.2 else 330.0 - x0, y, size))
        if page % 5 != 1:
            rows.append((f"Verlag {page}", 50.0, 90.0, -10.0, 8.0))
        pages.append(rows)
    return pages


def test_heads_and_paragraphs(spark):
    rng = random.Random(4)
    books = {d: book_of_pages(rng, n) for d, n in enumerate((1, 2, 5, 14, 40))}
    books[9] = [[("12", 50.0, 60.0, 700.0, 10.0)], [("Nur das", 50.0, 90.0, 700.0, 10.0)]]  # a page of nothing but its number
    rows = [(d, p, k, *line) for d, pages in books.items() for p, page in enumerate(pages) for k, line in enumerate(page)]
    frame = spark.createDataFrame(rows, LINE).repartition(3)
    counts = spark.createDataFrame([(d, len(pages)) for d, pages in books.items()], "doc_id long, pages long")
    kept = pdf_items.without_running_heads(frame, counts)
    wanted = {d: plain_heads(pages) for d, pages in books.items()}
    assert sorted((r.doc_id, r.page, r.text, r.y) for r in kept.collect()) == sorted((d, p, x[0], x[3]) for d, pages in wanted.items() for p, page in enumerate(pages) for x in page)
    found = {}
    for r in pdf_items.paragraphs(kept).orderBy("doc_id", "para").collect():
        found.setdefault(r.doc_id, []).append((r.text, r.type, r.page))
    assert found == {d: plain_paragraphs(pages) for d, pages in wanted.items() if any(pages)}
    assert pdf_items.paragraphs(pdf_items.without_running_heads(frame.limit(0))).count() == 0


# ordered folds ------------------------------------------------------------------------------------------------------


def plain_chunks(sizes, most):
    out, start, used, chunk = [], 0, 0, 0
    for i, n in enumerate(sizes):
        if used + n > most and i > start:
            start, used, chunk = i, 0, chunk + 1
        used += n
        out.append(chunk)
    return out


@pytest.mark.parametrize("rows", [ordered.ROWS, 7, 1])
def test_chunks(spark, rows, monkeypatch):
    """One chapter with most of the blocks, over many partitions; empty blocks, blocks longer than a chunk, ties of none."""
    monkeypatch.setattr(ordered, "ROWS", rows)
    rng = random.Random(rows)
    books = {(1, 0): [rng.choice([0, 0, 3, 8, 20, 21, 40, 100]) for _ in range(90)], (1, 1): [5], (2, 0): [0, 0, 50, 0], (3, 2): [30] * 9, (4, 0): [0] * 12}
    blocks = [(*key, 2 * k + 5, "x" * n if n or k % 2 else None) for key, sizes in books.items() for k, n in enumerate(sizes)]
    frame = spark.createDataFrame(blocks, "book_id long, chapter_ord long, block_ord long, text string").repartition(4)
    for most in (20, 41):
        found = ordered.chunks(frame, most)
        got = {}
        for r in found.orderBy("block_ord").collect():
            got.setdefault((r.book_id, r.chapter_ord), []).append((r.place, r.chunk))
        assert got == {key: list(enumerate(plain_chunks(sizes, most))) for key, sizes in books.items()}
    near = {(r.chunk, r.block_ord) for r in ordered.with_context(found, 2).filter("context and book_id = 3").collect()}
    wanted = plain_chunks(books[3, 2], 41)
    assert near == {(wanted[k], 2 * j + 5) for k in range(1, 9) if wanted[k] != wanted[k - 1] for j in range(max(k - 2, 0), k)}
    assert ordered.chunks(frame.limit(0), 20).count() == 0


@pytest.mark.parametrize("rows,segment", [(ordered.ROWS, ordered.SEGMENT), (9, 3)])
def test_speed(spark, rows, segment, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", rows)
    monkeypatch.setattr(ordered, "SEGMENT", segment)
    rng = random.Random(8)
    samples = [("a" if k % 9 else "b", k, *(rng.choice([0, None, 5, 80, 300, 4000]) if k % 11 == 0 else rng.randrange(1, 4000) for _ in range(4))) for k in range(400)]
    profile = {}
    for by, _, pm, pt, om, ot in samples:
        if pm and pt and om and ot:
            p, o, w = pt / (pm / 1000), ot / (om / 1000), pt + ot
            if by not in profile:
                profile[by] = (p, o, w)
            else:
                a, b, n = profile[by]
                old = min(n, 50_000)
                profile[by] = ((a * old + p * w) / (old + w), (b * old + o * w) / (old + w), old + w)
    frame = spark.createDataFrame(samples, "model string, seq long, prompt_ms long, prompt_tokens long, output_ms long, output_tokens long").repartition(3)
    found = {r.model: (r.prompt_tps, r.output_tps, r.samples) for r in ordered.speed(frame, "model", 50_000).collect()}
    assert set(found) == set(profile) and all(found[k] == pytest.approx(profile[k]) for k in profile)
    assert ordered.speed(frame.limit(0), "model").count() == 0


# pieces of text -----------------------------------------------------------------------------------------------------


def plain_rendered(text, sentences, notes, formats, cast):
    n = len(text)
    clamp = lambda v: max(0, min(n, v))
    points = sorted((a for a in notes if a["type"] in ("pause", "breath")), key=lambda a: a["at"])
    ranged = [a for a in notes if a["type"] not in ("pause", "breath")]
    cuts = {0, n, *(clamp(v) for x in sentences for v in x), *(clamp(v) for a in ranged for v in (a["s"], a["e"])), *(clamp(v) for f in formats for v in f[1:]), *(clamp(p["at"]) for p in points)}
    bounds, pos = [], 0
    for i, (a, z) in enumerate(sentences):
        bounds += [(None, pos, a)] if a > pos else []
        bounds.append((i, a, z))
        pos = z
    if pos < n or not bounds:
        bounds.append((None, pos, n))
    badges, begun, placed, out = set(), set(), set(), []
    for seg, (sentence, start, end) in enumerate(bounds):
        inner, mine = sorted(c for c in cuts if start <= c <= end), []

        def place(at):
            for p in points:
                if p["at"] == at and p["id"] not in placed:
                    placed.add(p["id"])
                    mine.append(("point", at, at, None, p["id"], p["type"]))

        for x, y in zip(inner, inner[1:]):
            place(x)
            over = [a for a in ranged if a["s"] <= x and y <= a["e"]]
            top = {}
            for a in over:
                top[a["type"]] = a
            said, pen = top.get("speech"), top.get("emphasis", {}).get("color")
            fresh = {a["id"] for a in over if a["type"] == "speech" and a["id"] not in badges}
            badges |= fresh
            who = said and (said["id"], said["speaker"], said["origin"] != "user" and (said["speaker"] is None or said["confidence"] < 0.5), said["origin"] == "user", (cast.get(said["speaker"], "?") if said["id"] in fresh else None))
            mine.append(("text", x, y, text[x:y], who, *(k in top for k in ("quote", "emphasis", "retake", "note", "bookmark")), pen if pen is not None and 0 <= pen < 6 else None, *(any(f[0] == k and f[1] <= x and y <= f[2] for f in formats) for k in ("em", "strong"))))
            for a in over:
                if a["type"] in ("retake", "note", "bookmark") and a["id"] not in begun:
                    begun.add(a["id"])
                    mine.append(("start", x, x, a["note"] if a["type"] == "note" else (a["note"] or None) if a["type"] == "retake" else None, a["id"], a["type"]))
        place(end)
        if sentence is not None and any(m[0] == "text" for m in mine):
            k = max(i for i, m in enumerate(mine) if m[0] == "text")
            mine[k] = (*mine[k][:3], re.sub(r"\.([«»“”‘’‹›\"')\]}]*\s*)$", r"\1", mine[k][3]), *mine[k][4:])
        words = len(re.findall(r"[^\W\d_]+", text[start:end])) if sentence is not None else 0
        out += [(seg, sentence, words, *m) for m in mine]
    return out


def test_rendered(spark):
    rng = random.Random(6)
    kinds = ["speech", "quote", "emphasis", "retake", "note", "bookmark", "pause", "breath"]
    texts = ["", "Ja.", "Er ging. »Komm.« Dann blieb er. Und?", "a" * 700 + ". B.) ", "x", "Satz eins. Satz zwei. "]
    bounds = [[], [(0, 3)], [(0, 8), (9, 16), (17, 31), (32, 36)], [(0, 701), (702, 706)], [], [(1, 10), (11, 21)]]
    cast = {"anna": "An", "jonas": "Jo"}
    blocks, notes, formats, wanted = [], [], [], {}
    for k, (text, sentences) in enumerate(zip(texts, bounds)):
        own = []
        for i in range(60 if k == 3 else 14):
            s = rng.randrange(-2, len(text) + 2)
            own.append({"id": f"{k}-{i}", "type": rng.choice(kinds), "s": s, "e": s + rng.randrange(0, 12 if k != 3 else 400), "at": rng.randrange(0, len(text) + 3), "speaker": rng.choice(["anna", "jonas", "who", None]), "confidence": rng.choice([0.2, 0.5, 0.9]), "origin": rng.choice(["user", "rule"]), "color": rng.choice([None, 0, 5, 6]), "note": rng.choice(["", "hm", None])})
        style = [(rng.choice(["em", "strong"]), a := rng.randrange(0, len(text) + 1), a + rng.randrange(0, 9)) for _ in range(3)]
        wanted[k] = plain_rendered(text, sentences, own, style, cast)
        blocks.append((1, k, text, sentences or None))
        notes += [(1, k, a["id"], i, a["type"], a["s"], a["e"], a["at"], a["speaker"], a["confidence"], a["origin"], a["color"], a["note"], "long" if i % 2 else None) for i, a in enumerate(own)]
        formats += [(1, k, *f) for f in style]
    frames = [spark.createDataFrame(blocks, "book_id long, block_ord long, text string, sentences array<struct<s:long,e:long>>"), spark.createDataFrame(notes, "book_id long, block_ord long, id string, ord long, type string, s long, e long, at long, speaker string, confidence double, origin string, color long, note string, length string"), spark.createDataFrame(formats, "book_id long, block_ord long, kind string, s long, e long"), spark.createDataFrame([(1, *x) for x in cast.items()], "book_id long, speaker string, badge string")]
    found = {k: [] for k in wanted}
    for r in render.rendered(*frames).orderBy("block_ord", "ix").collect():
        if r.kind == "text":
            rest = ((r.id, r.speaker, r.weak, r.user, r.badge) if r.id else None, r.quote, r.emphasis, r.retake, r.note, r.bookmark, r.pen, r.italic, r.bold)
        else:
            rest = (r.id, r.mark)
        found[r.block_ord].append((r.seg, r.sentence, r.words, r.kind, r.s, r.e, r.text, *rest))
    assert found == wanted, [(b, x, y) for b in wanted for x, y in zip(found[b], wanted[b]) if x != y][:4]
    assert render.rendered(frames[0].limit(0), *frames[1:]).count() == 0
    hits = [(1, k, at) for k, text in enumerate(texts) for at in range(len(text) + 1)]
    got = {(r.block_ord, r.offset, r.id) for r in render.covering(frames[1], spark.createDataFrame(hits, "book_id long, block_ord long, offset long")).collect()}
    assert got == {(k, at, a[2]) for _, k, at in hits for a in notes if a[1] == k and a[4] not in ("pause", "breath") and a[5] <= at < max(a[6], a[5] + 1)}


# versions -----------------------------------------------------------------------------------------------------------

JOURNAL = "book_id long, seq long, action string, edit string, target string, value string, ts string"


def random_journal(rng, book, n, broken=False):
    rows, undos, redos = [], 0, 0
    for k in range(n):
        action = rng.choice(["edit"] + ["undo"] * (undos > 0 or broken) * 2 + ["redo"] * (redos > 0 or broken) * 2)
        undos, redos = (undos + 1, 0) if action == "edit" else (undos - 1, redos + 1) if action == "undo" else (undos + 1, redos - 1)
        named = (rng.choice(["setSpeaker", "setNote", "addMark"]), rng.choice("xyz"), rng.choice(["1", "2", None])) if action == "edit" else (None, None, None)
        rows.append((book, 3 * k + 1, action, *named, f"t{k}"))
    return rows


def replay(rows):
    """After each action: (seq, the state as a dict, both stacks)."""
    undos, redos, out = [], [], []
    for _, seq, action, edit, target, value, ts in rows:
        if action == "edit":
            undos, redos = [*undos, (seq, edit, target, value, ts)], []
        elif action == "undo":
            if not undos:
                return out, seq
            undos, redos = undos[:-1], [*redos, undos[-1]]
        else:
            if not redos:
                return out, seq
            undos, redos = [*undos, redos[-1]], redos[:-1]
        state = {}
        for _, edit, target, value, ts in undos:
            state[target, {"setSpeaker": "speaker", "setNote": "note", "addMark": "exists"}[edit]] = value
            state["book", "modifiedAt"] = ts
        out.append((seq, {k: v for k, v in state.items() if v is not None}, undos, redos))
    return out, None


@pytest.mark.parametrize("rows", [ordered.ROWS, 10])
def test_undo_and_redo(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", rows)
    rng = random.Random(9)
    journals = {b: random_journal(rng, b, n, broken=b > 3) for b, n in enumerate((1, 25, 60, 61, 12, 12, 12))}
    frame = spark.createDataFrame([r for j in journals.values() for r in j], JOURNAL).repartition(3)
    plain = {b: replay(j) for b, j in journals.items()}
    assert {r.book_id: r.seq for r in undo.without_effect(frame).collect()} == {b: bad for b, (_, bad) in plain.items() if bad}
    changed = undo.changes(frame).cache()
    held = undo.intervals(changed)
    last = {}
    for share in (0, 0.3, 0.7, 1):
        at = {b: states[int(share * (len(states) - 1))] for b, (states, _) in plain.items() if states}
        moments = spark.createDataFrame([(b, x[0]) for b, x in at.items()], "book_id long, at long")
        wanted = {(b, *k): v for b, x in at.items() for k, v in x[1].items()}
        assert {(r.book_id, r.target, r.property): r.value for r in undo.version(held, moments).collect()} == wanted
        for before, was in last.values():  # from every earlier moment, and back
            for a, z, want in ((before, moments, wanted), (moments, before, was)):
                assert {(r.book_id, r.target, r.property): r.value for r in undo.moved(undo.version(held, a), changed, a, z).collect()} == want
        last[share] = (moments, wanted)
    found = {}
    for r in undo.stacks(frame, 5).orderBy("level").collect():
        found.setdefault((r.book_id, r.stack), []).append(r.entry)
    ends = {b: states[-1] for b, (states, _) in plain.items() if states}
    assert found == {(b, "undo"): [e[0] for e in x[2][-5:]] for b, x in ends.items() if x[2]} | {(b, "redo"): [e[0] for e in x[3][::-1]] for b, x in ends.items() if x[3]}


def test_a_new_edit_ends_what_can_be_redone(spark):
    rows = [(1, 1, "edit", "setNote", "x", "a", "t1"), (1, 2, "undo", None, None, None, "t2"), (1, 3, "edit", "setNote", "x", "b", "t3"), (1, 4, "redo", None, None, None, "t4"), (1, 5, "edit", "setNote", "x", "c", "t5")]
    frame = spark.createDataFrame(rows, JOURNAL)
    assert [tuple(r) for r in undo.without_effect(frame).collect()] == [(1, 4)]
    assert [(r.seq, r.old, r.new) for r in undo.changes(frame).filter("property = 'note'").orderBy("seq").collect()] == [(1, None, "a"), (2, "a", None), (3, None, "b")]
    assert undo.intervals(undo.changes(frame.filter("seq < 4"))).filter(F.col("until").isNull()).count() == 2


# rebasing -----------------------------------------------------------------------------------------------------------


def plain_rebase(journal, annotations, cast, current):
    """One command after the other on the other version."""
    there = {("annotation", a[0]) for a in annotations} | {("figure", c[0]) for c in cast}
    marks, names = {}, {}
    for a in sorted(annotations):
        marks.setdefault(a[1:], a[0])
    for speaker, name in sorted(cast):
        names.setdefault(name.lower(), speaker)
    place_of, values, ids, live_ids, removed, out = {a[0]: a[1:] for a in annotations}, dict(current), {}, set(there), set(), []
    for seq, edit, target, figure, value, created, *place in journal:
        kind = "figure" if edit == "updateCast" else "annotation"
        refs = [(kind, target)] * (target is not None) + [("figure", figure)] * (figure is not None)
        lacking = sorted(k for k, i in refs if (k, i) not in live_ids) if edit != "removeAnnotation" else []
        new_target, new_figure = ids.get((kind, target), target), ids.get(("figure", figure), figure)
        said, made, outcome = new_figure or value, None, "applied"
        free = lambda k, i: f"{i}-{seq}" if (k, i) in there else i
        if lacking:
            out.append((seq, edit, new_target, new_figure, None, "skipped", lacking[0]))
            continue
        if edit == "addMark":
            key = (*place, value)
            made, outcome = (marks[key], "unchanged") if key in marks else (free("annotation", created), "applied")
            marks[key] = made
            place_of[created] = key
        elif edit == "addCast":
            made, outcome = (names[value.lower()], "unchanged") if value.lower() in names else (free("figure", created), "applied")
            names[value.lower()] = made
        elif edit == "splitSpeech":
            made = free("annotation", created)
        elif edit == "removeAnnotation":
            if new_target in removed or not (("annotation", new_target) in there or ("annotation", target) in ids):
                outcome = "unchanged"
            removed.add(new_target)
            if target in place_of:
                marks.pop(place_of[target], None)
        else:
            prop = {"setSpeaker": "speaker", "setNote": "note", "updateCast": "name"}[edit]
            outcome = "unchanged" if values.get((new_target, prop)) == said else "applied"
            values[new_target, prop] = said
        if made:
            k = "figure" if edit == "addCast" else "annotation"
            ids[k, created] = made
            live_ids.add((k, created))
        out.append((seq, edit, new_target, new_figure, made, outcome, None))
    return out


def test_rebased(spark):
    rng = random.Random(12)
    frames, wanted = ([], [], [], []), {}
    for book in range(6):
        annotations = [(f"b{i}", "speech", i, 0, 5, None) for i in range(8) if rng.random() < 0.7] + [(f"m{i}" if i else "n1", "note", i, 0, 9, "hm") for i in range(3) if rng.random() < 0.7]
        cast = [(f"f{i}", f"Figure {i}") for i in range(4) if rng.random() < 0.7] + [("g1", "NAME 1")] * (book % 2)
        current = {(f"b{i}", "note"): rng.choice(["x", "y"]) for i in range(4)}
        journal, parts, people, gone = [], [], [], set()
        for seq in range(1, 60):
            edit = rng.choice(["addMark", "splitSpeech", "addCast", "setSpeaker", "setNote", "updateCast", "removeAnnotation"])
            on_text = rng.choice([x for x in [*(f"b{i}" for i in range(8)), *parts[-4:], *parts[-4:]] if x not in gone] or ["b0"])
            who = rng.choice([*(f"f{i}" for i in range(4)), *people[-3:]])
            row = [seq, edit, None, None, None, None, None, None, None, None]
            if edit == "addMark":
                row[4:] = [rng.choice(["hm", "so"]), f"n{seq}", "note", rng.randrange(3), 0, 9]
                parts.append(f"n{seq}")
            elif edit == "splitSpeech":
                row[2:6] = [on_text, rng.choice([who, None]), None, f"p{seq}"]
                parts.append(f"p{seq}")
            elif edit == "addCast":
                row[4:6] = [f"Name {rng.randrange(4)}", f"c{seq}"]
                people.append(f"c{seq}")
            elif edit == "updateCast":
                row[2], row[4] = who, rng.choice(["x", "y"])
            elif edit == "removeAnnotation":
                row[2] = on_text
                if rng.random() < 0.8:
                    gone.add(on_text)
            else:
                row[2] = on_text
                row[3 if edit == "setSpeaker" else 4] = who if edit == "setSpeaker" else rng.choice(["x", "y"])
            journal.append(tuple(row))
        wanted[book] = plain_rebase(journal, annotations, cast, current)
        for frame, rows in zip(frames, (journal, annotations, cast, [(*k, v) for k, v in current.items()])):
            frame += [(book, *r) for r in rows]
    schemas = ("book_id long, seq long, edit string, target string, figure string, value string, created string, type string, block_ord long, s long, e long", "book_id long, id string, type string, block_ord long, s long, e long, value string", "book_id long, speaker string, name string", "book_id long, target string, property string, value string")
    tables = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(frames, schemas)]
    found = {book: [] for book in wanted}
    for r in rebase.rebased(*tables).orderBy("seq").collect():
        found[r.book_id].append(tuple(r)[1:])
    assert found == wanted, [(b, x, y) for b in wanted for x, y in zip(found[b], wanted[b]) if x != y][:4]
    assert {r[5] for rows in wanted.values() for r in rows} == {"applied", "unchanged", "skipped"}
    assert rebase.rebased(tables[0].limit(0), *tables[1:]).count() == 0


def test_skipped_commands_spread_along_creations(spark):
    """A chain of parts cut from parts, whose first was cut from what is gone."""
    rows = [(1, k, "splitSpeech", f"p{k - 1}", f"p{k}") for k in range(1, 9)] + [(1, 20, "setNote", "p8", None), (1, 21, "setNote", "q", None), (1, 22, "removeAnnotation", "p3", None)]
    journal = spark.createDataFrame(rows, "book_id long, seq long, edit string, target string, created string").withColumn("figure", F.lit(None).cast("string"))
    there = spark.createDataFrame([(1, "annotation", "q")], "book_id long, kind string, id string")
    assert sorted(r.seq for r in rebase.skipped(journal, there).collect()) == [*range(1, 9), 20]


# EPUB files ---------------------------------------------------------------------------------------------------------


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in entries.items():
            box.writestr(name, text)
    return out.getvalue()


CONTAINER = '<?xml version="1.0"?><c:container xmlns:c="urn:x"><c:rootfiles><c:rootfile full-path="OEBPS/book.opf"/></c:rootfiles></c:container>'
PACKAGE = """<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> Der  Band </dc:title><dc:title>zweiter</dc:title><dc:creator>A. &amp; B.</dc:creator><dc:language/><dc:date>1900</dc:date></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="x nav"/><item id="a" href="old.xhtml" media-type="application/xhtml+xml"/><item id="a" href="text/../text/a%201.xhtml" media-type="application/xhtml+xml"/>
<item id="b" href="b.xhtml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="d" href="gone.xhtml" media-type="application/xhtml+xml"/><item id="p" href="p.png" media-type="image/png"/><item id="e" href="empty.xhtml" media-type="text/html"/></manifest>
<spine><itemref idref="n"/><itemref idref="a"/><itemref idref="p"/><itemref idref="b"/><itemref idref="d"/><itemref idref="c"/><itemref idref="e"/><itemref idref="b"/><itemref idref="unknown"/></spine></package>"""
WHOLE = {
    "META-INF/container.xml": CONTAINER, "OEBPS/book.opf": PACKAGE, "OEBPS/nav.xhtml": '<nav><a href="text/a%201.xhtml#top"> </a><a href="./text/a 1.xhtml">Erster&nbsp;Teil</a><a href="text/a 1.xhtml">später</a></nav>',
    "OEBPS/x/toc.ncx": '<ncx><navMap><navPoint><navLabel><text>Aus ncx</text></navLabel><content src="../b.xhtml"/><navPoint><navLabel><text>innen</text></navLabel><content src="../c.xhtml#s"/></navPoint></navPoint></navMap></ncx>',
    "OEBPS/text/a 1.xhtml": "<p>Ohne Kopf</p>", "OEBPS/b.xhtml": "<p>nur Text<p>und mehr", "OEBPS/c.xhtml": "<h1>I</h1><h2>Der Fluss</h2><h1>I</h1><h2>viertens</h2><p>x</p>", "OEBPS/empty.xhtml": "<p> </p>", "OEBPS/old.xhtml": "<p>alt</p>",
}


def test_epub_tables(spark, tmp_path):
    plain = {"META-INF/container.xml": CONTAINER, "OEBPS/book.opf": '<package><manifest><item id="k" href="k.html" media-type="text/html"></manifest><spine><itemref idref="k"></spine></package>', "OEBPS/k.html": "<p>k"}
    files = {"whole.epub": archive(WHOLE), "sub/plain.v2.epub": archive(plain), "broken.epub": b"PK\x03\x04no", "bare.epub": archive({"mimetype": "application/epub+zip"}), "other.txt": b"text"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(epub.EpubSource)
    found = spark.read.format("book_epub").load(str(tmp_path))
    rows = spark.createDataFrame([(str(tmp_path / k), v) for k, v in files.items() if k.endswith("epub")], "path string, content binary")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, epub.opened(rows).collect()), key=str)
    short = lambda path: path[len(str(tmp_path)) + 1 :]
    assert {short(r.path): r.value.split(":")[0] for r in found.filter("kind = 'error'").collect()} == {"broken.epub": "BadZipFile", "bare.epub": "ValueError"}
    books = {short(r.path): tuple(r)[1:] for r in epub.metadata(found).collect()}
    assert books == {"whole.epub": ("Der  Band", "A. & B.", None, None, "1900"), "sub/plain.v2.epub": ("plain.v2", None, None, None, None)}
    chapters = {(short(r.path), r.place): (r.id, r.href, r.title, r.n_blocks) for r in epub.chapters(epub.blocks(found)).collect()}
    assert chapters == {
        ("whole.epub", 2): ("ch002", "OEBPS/text/a 1.xhtml", "Erster Teil", 1), ("whole.epub", 4): ("ch004", "OEBPS/b.xhtml", "Aus ncx", 2), ("whole.epub", 6): ("ch006", "OEBPS/c.xhtml", "I – Der Fluss", 5),
        ("whole.epub", 8): ("ch008", "OEBPS/b.xhtml", "Aus ncx", 2), ("sub/plain.v2.epub", 1): ("ch001", "OEBPS/k.html", "Kapitel 1", 1),
    }
    one = spark.read.format("book_epub").option("kinds", "metadata").load(str(tmp_path / "whole.epub"))
    assert one.rdd.getNumPartitions() == 1 and sorted(r.name for r in one.collect()) == ["author", "date", "title"]
    assert found.rdd.getNumPartitions() == 4


# the timer ----------------------------------------------------------------------------------------------------------


class Plain:
    """The timer as it is pressed."""

    def __init__(self):
        self.running, self.before, self.since, self.start, self.words = False, 0, 0, None, 0

    def elapsed(self, now):
        return self.before + (now - self.since if self.running else 0)

    def press(self, now, action, position):
        if action == "toggle":
            action = "pause" if self.running else "start"
        if action == "start" and not self.running:
            self.start = position if self.start is None else self.start
            self.since, self.running = now, True
        elif action == "pause" and self.running:
            self.before, self.running = self.elapsed(now), False
        elif action == "track" and self.running:
            self.words = max(0, position - self.start)
        elif action == "reset":
            self.running, self.before, self.start, self.words = False, 0, None, 0

    def row(self, now):
        ms = self.elapsed(now) // 1000
        return self.running, ms, self.words, int(self.words / (ms / 60_000) + 0.5) if ms >= 20_000 and self.words else None


def plain_paces(events, end):
    out, timers = [], {}
    for reader in sorted({e[0] for e in events}):
        own, clock, last = sorted(e[1:] for e in events if e[0] == reader), Plain(), None
        for k, (at, seq, action, position) in enumerate(own):
            clock.press(at, action, position)
            out.append((reader, at, seq, action, *clock.row(at)))
            left = 20_000_000 - clock.elapsed(at)
            if clock.running and left > 0 and at + left <= (own[k + 1][0] if k + 1 < len(own) else end) and at + left <= end:
                out.append((reader, at + left, None, "known", *clock.row(at + left)))
    return sorted(out, key=str)


def test_timer_as_table_and_as_stream(spark, tmp_path):
    rng = random.Random(3)
    events, seq = [], 0
    for reader in range(5):
        at = 1_700_000_000_000_000 + rng.randrange(10**6)
        for _ in range(40):
            seq += 1
            at += rng.choice([0, 700_000, 3_000_000, 9_000_123, 25_000_000])
            events.append((reader, at, seq, rng.choice(["start", "start", "pause", "toggle", "track", "track", "track", "reset"]), rng.randrange(400)))
    end = max(e[1] for e in events) + 3_600_000_000
    events.append((9, end, seq + 1, "pause", 0))  # moves the watermark on
    wanted = plain_paces(events, end)
    assert any(r[3] == "known" for r in wanted)
    frame = spark.createDataFrame(events, "reader long, at long, seq long, action string, position long").select("reader", F.timestamp_micros("at").alias("ts"), "seq", "action", "position")
    plain = lambda rows: sorted(((r.reader, r.at, r.seq, r.action, r.running, r.elapsed_ms, r.words, r.wpm) for r in rows.withColumn("at", F.unix_micros("ts")).collect()), key=str)
    assert plain(timer.paces(frame.repartition(3))) == wanted

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(events[:-1], key=lambda e: e[1] + rng.randrange(60_000_000))  # out of order by a minute at most
    for k, part in enumerate([rows[:70], rows[70:140], rows[140:], [events[-1]]]):
        batch = spark.createDataFrame(part, "reader long, at long, seq long, action string, position long").select("reader", F.timestamp_micros("at").alias("ts"), "seq", "action", "position")
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = timer.pace_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    found = plain(spark.read.parquet(str(tmp_path / "out")))
    assert [r for r in found if r[0] != 9] == [r for r in wanted if r[0] != 9]
