"""The library on small inputs: values worked out by hand, and properties that must hold."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellichor import catalogue
from vellichor.functions import text as T
from vellichor.operators import attribution, colors, edits, jobs, rebase, segment, speech, stats, views
from vellichor.plans.analysis import analyse
from vellichor.sources import books, containers, pages, pdf_items
from vellichor.streaming import journal

BLOCK = "book_id long, chapter_ord long, block_ord long, type string, text string"


@pytest.fixture(scope="module")
def sample(spark):
    texts = [(0, "h1", "Kapitel 1"), (0, "p", "Anna stand am Ufer und sah dem Boot nach."), (0, "p", "»Kommst du mit?«, fragte Anna. »Es wird bald dunkel.«"), (0, "p", "»Gleich«, antwortete Jonas."), (0, "p", "»Du trödelst immer.«"), (0, "p", "»Und du bist ungeduldig.«"), (1, "h1", "Kapitel 2"), (1, "p", "»Guten Morgen«, sagte Paul. Er setzte sich zu ihnen."), (1, "p", "»Morgen«, sagte Anna.")]
    return spark.createDataFrame([(1, c, k, t, x) for k, (c, t, x) in enumerate(texts)], BLOCK).cache()


@pytest.fixture(scope="module")
def analysed(sample):
    return analyse(sample)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "given", "wanted"), [
    (T.word_count, "Der Häuptling grüßte Müller.", 4), (T.slug, "Miß Tibbetts", "miss-tibbetts"), (T.slug, "Ärger Ödön", "arger-odon"), (T.slug, "…", "x"),
    (T.initials, "Bones", "Bo"), (T.initials, "Leutnant Tibbetts", "LT"), (T.initials, "M'anin", "M'"), (T.initials, "7", "?"),
    (T.without_final_period, "Ende.«", "Ende«"), (T.without_final_period, "Ende...", "Ende.."), (T.without_final_period, "Ende.)\n", "Ende)\n"), (T.capitalized, "hAUS", "Haus"),
    (T.is_local_url, "http://localhost:11434/v1", True), (T.is_local_url, "http://192.168.1.5", True), (T.is_local_url, "http://nas.local", True), (T.is_local_url, "http://[::1]:8080", True), (T.is_local_url, "https://api.example.com", False), (T.is_local_url, "http://172.32.0.1", False), (T.is_local_url, "nothing", False),
])
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


@pytest.mark.parametrize(("text", "wanted"), [
    ("Das ist z. B. gut. Dr. Müller kam am 3. Oktober. Er ging.", 3), ("»Kommst du?«, fragte sie.", 1), ("»Warte!« Er ging.", 2), ("Er war... müde.", 1), ("J. R. R. Tolkien schrieb.", 1), ("Es waren 3.14 Meter.", 1), ("Am 45. Er kam.", 2), ("", 0),
])
def test_sentences(spark, text, wanted):
    assert len(one(spark, text, segment.sentence_spans)) == wanted


def test_sentence_spans_of_the_sample(sample):
    spans = {r.block_ord: [(x.s, x.e) for x in r.sentences] for r in segment.with_sentences(sample).collect()}
    assert spans[2] == [(0, 30), (31, 53)] and spans[7] == [(0, 27), (28, 52)] and spans[0] == []
    rows = segment.sentences(sample).orderBy("gsid").collect()
    assert [r.gsid for r in rows] == list(range(1, 10)) and [r.sid for r in rows] == [1, 2, 3, 4, 5, 6, 1, 2, 3]
    texts = {r.block_ord: r.text for r in sample.collect()}
    assert all(texts[r.block_ord][r.s : r.e] == r.text for r in rows)


@pytest.mark.parametrize(("text", "style"), [("»Ja.«", "guillemets_de"), ("« Oui. »", "guillemets_fr"), ("„Ja.“", "low_high_de"), ("“Yes.”", "curly_en"), ('"Yes."', "straight"), ("— Ja — sagte er.", "dash"), ("Er ging.", "none")])
def test_quote_style(spark, text, style):
    rows = spark.createDataFrame([(1, 0, k, "p", text) for k in range(6)] + [(1, 0, 6, "p", "Er ging.")], BLOCK)
    assert speech.quote_style(rows).first()["style"] == style


def test_inner_and_open_speech(spark):
    rows = spark.createDataFrame([(1, 0, 0, "p", "»Er sagte ‚nein‘ und ging.«"), (1, 0, 1, "p", "»Offen"), (1, 0, 2, "p", "»und weiter.«"), (1, 0, 3, "p", "»Neu.«")], BLOCK)
    found = [tuple(r)[2:] for r in speech.speech_spans(rows).orderBy("block_ord", "span_ix").collect()]
    assert found == [(0, 0, 0, 27, False, False, False), (0, 1, 10, 16, False, False, True), (1, 0, 0, 6, True, False, False), (2, 0, 0, 13, False, True, False), (3, 0, 0, 6, False, False, False)]


def test_attribution_of_the_sample(analysed):
    found = [(r.block_ord, r.s, r.e, r.speaker, r.via, r.conf) for r in analysed.attributed.orderBy("block_ord", "s").collect()]
    assert found == [(2, 0, 16, "anna", "inquit_after", 0.95), (2, 31, 53, "anna", "same_paragraph", 0.7), (3, 0, 8, "jonas", "inquit_after", 0.95), (4, 0, 20, "anna", "alternation", 0.4), (5, 0, 25, "jonas", "alternation", 0.4), (7, 0, 14, "paul", "inquit_after", 0.95), (8, 0, 8, "anna", "inquit_after", 0.95)]
    row = analysed.stats().first()
    assert (row.chapters, row.blocks, row.sentences, row.words, row.speech, row.unattributed, row.needs_review, row.minutes) == (2, 9, 9, 42, 7, 0, 2, 0)
    assert {(r.speaker, r.slot) for r in analysed.slots().collect()} == {("anna", 0)}
    assert {(r.chapter_ord, r.speaker, r.slot) for r in analysed.chapter_slots().collect()} == {(0, "jonas", 1), (1, "paul", 1)}


def test_pronouns_nearness_and_inquit_before(spark):
    texts = ["»Guten Tag«, sagte Anna.", "»Wie geht es?«, fragte Jonas.", "»Gut«, erwiderte sie.", "Anna sagte: »Ich gehe.«", "Jonas nickte.", "»Dann geh.«", "»Ja«, sagte ich."]
    rows = spark.createDataFrame([(1, 0, k, "p", t) for k, t in enumerate(texts)], BLOCK)
    found = {r.block_ord: (r.speaker, r.via) for r in attribution.attribute(rows, speech.speech_spans(rows)).collect()}
    assert found[2] == ("anna", "pronoun") and found[3] == ("anna", "inquit_before") and found[5] == ("jonas", "proximity") and found[6] == ("ich-erzahler", "pronoun")


def test_names_merge_unless_titles_differ(spark):
    rows = spark.createDataFrame([(1, "hamilton", "Hamilton", 2), (1, "captain-hamilton", "Captain Hamilton", 1), (1, "miss-tibbetts", "Miß Tibbetts", 1), (1, "leutnant-tibbetts", "Leutnant Tibbetts", 3)], "book_id long, speaker string, name string, lines long")
    assert {r.speaker: r.merged for r in attribution.merged_names(rows).collect()} == {"hamilton": "hamilton", "captain-hamilton": "hamilton", "miss-tibbetts": "miss-tibbetts", "leutnant-tibbetts": "leutnant-tibbetts"}


def test_forced_slots(spark):
    cast = spark.createDataFrame([(1, f"f{k}", f"F{k}", 20 - k) for k in range(15)], "book_id long, speaker string, name string, lines long")
    forced = spark.createDataFrame([(1, "f3", 0), (1, "f5", 0)], "book_id long, speaker string, slot long")
    found = {r.speaker: r.slot for r in colors.global_slots(cast, forced).collect()}
    assert found["f3"] == 0 and found["f0"] == 1 and len(set(found.values())) == len(found) == 12


def test_pronunciation(spark):
    rows = spark.createDataFrame([(1, k, "Gestern kam Effi mit der alten Kutsche aus Hohen-Cremmen. ") for k in range(3)], "book_id long, gsid long, text string")
    found = {r.term: (r.kind, r.n) for r in stats.pronunciation_terms(rows).collect()}
    assert found == {"Effi": ("name", 3), "Hohen-Cremmen": ("name", 3)}


def test_search(spark, sample):
    assert [(r.block_ord, r.s, r.e) for r in views.hits(sample, "morgen").orderBy("block_ord").collect()] == [(7, 7, 13), (8, 1, 7)]
    assert views.hits(sample, "m").count() == 0
    odd = spark.createDataFrame([(1, 0, 0, "p", "Er sagte „geht’s  gut“.")], BLOCK)
    assert views.hits(odd, "\"geht's gut\"").count() == 1


def test_render_pieces(spark, sample):
    marks = spark.createDataFrame([(1, 2, "a", 0, 16), (1, 2, "b", 5, 20)], "book_id long, block_ord long, id string, s long, e long")
    rows = views.render_pieces(sample, marks).filter("block_ord = 2").orderBy("ix").collect()
    assert [(r.s, r.e, r.ids) for r in rows] == [(0, 5, "a"), (5, 16, "a,b"), (16, 20, "b"), (20, 53, "")]


def test_marks_csv(spark, sample):
    marks = spark.createDataFrame([(1, 2, "a", "note", 1, 7, 'so; "ja"'), (1, 1, "b", "retake", 0, 4, None)], "book_id long, block_ord long, id string, type string, s long, e long, note string")
    listed = views.mark_list(marks, sample).withColumn("title", F.lit("I")).withColumn("sentence", F.lit(3)).withColumn("pen", F.lit(None).cast("string"))
    assert views.marks_csv(listed).first().csv == '\ufeffArt;Kapitel;Kapiteltitel;Satz;Text;Notiz;Farbe\r\nRetake;1;I;3;Anna;;\r\nNotiz;1;I;3;Kommst;"so; ""ja""";\r\n'
    assert views.marks_text(listed).first().text == 'Retake · Kap. 1, Satz 3: Anna\nNotiz · Kap. 1, Satz 3: Kommst – so; "ja"'


def test_comparison(spark):
    schema = "book_id long, block_ord long, s long, e long, speaker string, conf double"
    truth = spark.createDataFrame([(1, 0, 0, 10, "a", 1.0), (1, 1, 0, 10, "b", 1.0), (1, 2, 0, 10, "c", 1.0), (1, 3, 0, 10, "d", 1.0)], schema)
    found = spark.createDataFrame([(1, 0, 0, 9, "a", 0.9), (1, 1, 2, 10, "x", 0.9), (1, 2, 0, 10, "c", 0.4), (1, 3, 8, 12, "d", 0.9)], schema)
    assert tuple(views.compared(truth, found).first()) == (1, 4, 3, 2, 1, 0, 1, 1)


def test_edits(spark):
    log = spark.createDataFrame([(1, 0, "setSpeaker", "a1", "anna"), (1, 1, "setSpeaker", "a1", "paul"), (1, 2, "setSpeaker", "gone", "x"), (1, 3, "confirmSpeech", "a2", None), (1, 4, "removeAnnotation", "a3", None)], "book_id long, seq long, edit string, target string, value string")
    spans = spark.createDataFrame([(1, f"a{k}", "jonas", 0.4, "alternation") for k in (1, 2, 3, 4)], "book_id long, id string, speaker string, conf double, via string")
    after = edits.apply_speakers(spans, log)
    assert sorted(map(tuple, after.collect())) == [(1, "a1", "paul", 1.0, "user"), (1, "a2", "jonas", 1.0, "user"), (1, "a4", "jonas", 0.4, "alternation")]
    earlier = edits.apply_speakers(spans, log.filter("seq < 1"))
    assert ("a1", "replace", "speaker", "anna", "paul") in [tuple(r)[1:] for r in edits.changes(earlier, after, ["book_id", "id"], ["speaker", "conf"]).collect()]
    current = spark.createDataFrame([(1, "a1", "speaker", "anna")], "book_id long, target string, property string, value string")
    none = {c: F.lit(None).cast("string") for c in ("figure", "created", "type")} | {c: F.lit(None).cast("long") for c in ("block_ord", "s", "e")}
    annotations = spans.select("book_id", "id").withColumns({c: x for c, x in none.items() if c not in ("figure", "created")} | {"value": F.lit(None).cast("string")})
    cast = spark.createDataFrame([], "book_id long, speaker string, name string")
    outcome = {r.seq: r.outcome for r in rebase.rebased(log.withColumns(none), annotations, cast, current).collect()}
    assert outcome == {0: "unchanged", 1: "applied", 2: "skipped", 3: "unchanged", 4: "applied"}  # a3 is there, so it is removed


def test_suggestions(spark):
    rows = spark.createDataFrame([(1, "a", 0.8, "rule", "a", 0.9), (2, "a", 0.4, "rule", "b", 0.85), (3, "a", 0.6, "rule", "b", 0.7), (4, "a", 1.0, "user", "b", 0.9), (5, "a", 0.95, "rule", "b", 0.5)], "id long, speaker string, conf double, via string, suggested string, confidence double")
    found = {r.id: (r.decision, r.new_speaker, round(r.new_conf, 3)) for r in edits.suggested(rows).collect()}
    assert found == {1: ("confirmed", "a", 0.97), 2: ("changed", "b", 0.77), 3: ("queued", "a", 0.45), 4: ("kept", "a", 1.0), 5: ("noted", "a", 0.95)}


def test_jobs(spark):
    assert jobs.chunk_chars(8_192) >= 6_000 and 40_000 <= jobs.chunk_chars(32_768) <= 60_000 and jobs.chunk_chars(262_144) == 60_000
    prompts = spark.createDataFrame([(1, "x"), (2, "fail")], "id long, prompt string")

    def transport(prompt):
        if prompt == "fail":
            raise TimeoutError
        return prompt.upper()

    assert sorted(map(tuple, jobs.answered(prompts, transport).collect())) == [(1, "X", None), (2, None, "TimeoutError")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "from_id string, to_id string")
    assert sorted(map(tuple, jobs.resolved(chain).collect())) == [("a", "c"), ("b", "c"), ("x", "y")]
    runs = spark.createDataFrame([(1, k, 1.0) for k in range(5)], "run long, job long, cost double")
    assert jobs.within_ceiling(runs, 3.0).count() == 3


def test_html():
    found = pages.blocks_of("<p>a <em>b<i> c</em> d</i>&#8199;e<h2>f</h2><dd><u>g</u> <b>h</p></b></dd><svg><p>no</p><table>no</table>no</svg></table>i<section>j</section><p/>k")
    assert [(t, x, [tuple(m.values()) for m in ms]) for t, x, ms in found] == [("p", "a b c d e", [(3, 5, "em"), (2, 7, "em")]), ("h1", "f", []), ("p", "g h", [(0, 1, "em")]), ("p", "ij", []), ("p", "k", [])]
    assert pages.blocks_of(None) == [] == pages.blocks_of(" \u00a0<b></b>")
    found = pages.blocks_of("<head><title>no</title></head><h1>I</h1><p>Ein  <em>kursives</em>&nbsp;Wort<br>hier</p><script>x</script><blockquote>Zitat &amp; mehr</blockquote><h3>drei</h3><table><tr><td>no</td></tr></table>")
    assert [(t, x) for t, x, _ in found] == [("h1", "I"), ("p", "Ein kursives Wort hier"), ("quote", "Zitat & mehr"), ("h2", "drei")]
    assert found[1][2] == [{"s": 4, "e": 12, "kind": "em"}]


def test_epub_and_packages(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", '<package><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="text/c%201.xhtml" media-type="application/xhtml+xml"/><item id="p" href="p.png" media-type="image/png"/></manifest><spine><itemref idref="nav"/><itemref idref="c1"/><itemref idref="p"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", '<html><body><nav><a href="text/c%201.xhtml#x">Der Fluss</a></nav></body></html>')
        z.writestr("OEBPS/text/c 1.xhtml", "<html><body><p>Hallo</p></body></html>")
    book = containers.packed_book(json.dumps({"schemaVersion": 1, "meta": {"title": "T"}, "new": {"kept": 1}}), b"src", "a.epub", "{broken")
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    rows = spark.createDataFrame([("a.epub", box.getvalue()), ("b.hbk", book), ("c.pdf", b"%PDF-1.7"), ("d.bin", b"??"), ("e.html", b"<p>")], "path string, content binary")
    assert {r.path: r.f for r in rows.select("path", containers.format_of(F.col("content"), F.col("path")).alias("f")).collect()} == {"a.epub": "epub", "b.hbk": None, "c.pdf": "pdf", "d.bin": None, "e.html": "html"}
    assert [tuple(r)[1:3] + (r.toc_title,) for r in containers.epub(rows.filter("path = 'a.epub'")).collect()] == [(2, "OEBPS/text/c 1.xhtml", "Der Fluss")]
    opened = containers.parsed(containers.unpacked(rows.filter("path in ('b.hbk', 'd.bin')"))).selectExpr("path", "typed.meta.title", "changes", "error", "try_variant_get(extras, '$.new.kept', 'int') as kept").orderBy("path").collect()
    assert tuple(opened[0]) == ("b.hbk", "T", None, None, 1) and opened[1].error == "BadZipFile"


def test_pdf(spark):
    rows = []
    for page in range(1, 5):
        rows += [(1, page, "Der Titel", 50.0, 560.0, 60.0, 8.0), (1, page, f"- {page} -", 200.0, 30.0, 20.0, 8.0)]
        for k in range(6):
            rows += [(1, page, f"Zeile {k} auf", 50.0, 500.0 - 13.5 * k, 100.0, 10.0), (1, page, "Sei-" if k == 5 else "Blatt", 152.0 + 5, 500.0 - 13.5 * k, 40.0, 10.0)]
    items = spark.createDataFrame(rows, "doc_id long, page long, str string, x double, y double, width double, size double")
    found = pdf_items.paragraphs(pdf_items.without_running_heads(pdf_items.lines(items))).orderBy("para").collect()
    whole = " ".join(r.text for r in found)
    assert "Titel" not in whole and "- 1 -" not in whole and whole.startswith("Zeile 0 auf Blatt Zeile 1 auf Blatt")


def test_chapters(spark):
    rows = spark.createDataFrame([(1, 0, k, "p", t) for k, t in enumerate(["Kapitel 1", "Der Fluss fließt.", "Kapitel 2", "II", "Mehr Text hier."])], BLOCK)
    found = books.chapters(rows).orderBy("block_ord").collect()
    assert [(r.chapter_ord, r.type) for r in found] == [(1, "h1"), (1, "p"), (2, "h1"), (2, "h2"), (2, "p")]
    assert books.chosen_chapters(books.chapters(rows).withColumn("chapter_ord", F.col("chapter_ord") - 1), "2-", 4).count() == 3


def test_streams(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(source)
    stream = journal.event_stream(spark, source, events.schema)
    stream = stream.select(F.col("user_id").alias("book_id"), F.lit("pad").alias("device"), F.col("event_id").alias("seq"))
    query = journal.handed_over(stream).writeStream.format("memory").queryName("handed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("handed").count() == events.count()
    batch = journal.activity(events)
    assert batch.agg(F.sum("n")).first()[0] == events.count() and journal.sessions(events).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("name", ["doc_word_count", "speech_spans", "chapter_colors", "search_offsets", "word_prefix_progress", "inquit_explicit"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "vellichor", tmp_path / "vellichor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]")


def test_entry_without_a_package(tmp_path):
    """Where a package of the operators for training corpora is missing, the library's queries are all there."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    hidden = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; from vellichor import catalogue; print(set(e.queries()) >= set(catalogue.QUERIES), set(e.oracle_sql()) >= set(catalogue.ORACLES), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", hidden], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-3:] == ["True", "True", "False"], done.stderr


def test_sentence_edits(spark):
    rows = spark.createDataFrame([("»Kommst du mit?«, fragte Anna. »Es wird bald dunkel.«", [(0, 30), (31, 53)])], "text string, spans array<struct<s:long,e:long>>")
    merged = edits.merged_sentences(F.col("spans"), F.lit(0))
    assert [tuple(x) for x in rows.select(merged.alias("x")).first().x] == [(0, 53)]
    again = rows.select("text", merged.alias("spans")).select(edits.split_sentences(F.col("spans"), F.col("text"), F.lit(30)).alias("x")).first().x
    assert [tuple(x) for x in again] == [(0, 30), (31, 53)]
    assert [tuple(x) for x in rows.select(edits.split_sentences(F.col("spans"), F.col("text"), F.lit(0)).alias("x")).first().x] == [(0, 30), (31, 53)]


def test_cast_edits(spark):
    slots = spark.createDataFrame([(1, "anna", 0), (1, "jonas", 3)], "book_id long, speaker string, slot long")
    wanted = spark.createDataFrame([(1, "jonas", 0)], "book_id long, speaker string, slot long")
    assert {r.speaker: r.slot for r in edits.swapped(slots, wanted).collect()} == {"anna": 3, "jonas": 0}
    taken = spark.createDataFrame([(1, "frau-berger", "Frau Bergér"), (1, "anna", "Anna")], "book_id long, speaker string, name string")
    names = spark.createDataFrame([(1, "  Frau   Berger "), (1, "ANNA"), (1, "Ida")], "book_id long, name string")
    assert {r.name: r.speaker for r in edits.new_ids(names, taken).collect()} == {"Frau Berger": "frau-berger-2", "Ida": "ida"}


def test_ink(spark):
    from vellichor.operators import ink

    rows = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 0.0), (50.0, 1.0)])], f"id long, points {ink.POINTS}")
    assert {r.id: len(r.points) for r in ink.simplified(rows).collect()} == {1: 3, 2: 2}
    assert {r.id: r.x for r in rows.select("id", ink.is_strike(F.col("points")).alias("x")).collect()} == {1: False, 2: True}
    assert rows.filter(ink.touches(F.col("points"), F.lit(11.0), F.lit(9.0), 2.0)).count() == 1
    valid = spark.createDataFrame([([[1, 2], [3, 4, 5, 6]],), ([[1, 2, 3]],), ([],)], "s array<array<int>>")
    assert [r.x for r in valid.select(ink.is_valid(F.col("s")).alias("x")).collect()] == [True, False, False]


def test_script_holds_whole_utterances(spark, sf):
    signs = str.maketrans(dict.fromkeys("»«„“”‚‘›‹\"\r\n.!?…:", " "))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text").collect()
    said = {(r.conv_id, r.turn): r.text.translate(signs) for r in rows}
    assert max(map(len, said.values())) > 80
    opened = {}
    who = {"user": "Anna", "assistant": "Jonas", "system": "Paul"}
    roles = {(r.conv_id, r.turn): who[r.role] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role").collect()}
    for k in said:
        opened[k] = len(f"{roles[k]} sagte: ") if k[1] % 3 == 1 else 0
    found = catalogue.QUERIES["speech_spans_all"](spark, sf).collect()
    assert sorted((r.book_id, r.block_ord, r.s, r.e) for r in found) == sorted((*k, opened[k], opened[k] + len(t) + 2) for k, t in said.items())
    texts = {(r.book_id, r.block_ord): r.text for r in catalogue.QUERIES["review_context_all"](spark, sf).select("book_id", "block_ord", "text").collect()}
    assert texts and all(f"»{said[k]}«" in t for k, t in texts.items())
    words = {r.book_id: r.words for r in catalogue.QUERIES["book_stats"](spark, sf).collect()}
    whole = books.script(spark.read.parquet(f"{sf}/conversations.parquet")).groupBy("book_id").agg(F.sum(T.word_count(F.col("text"))).alias("n")).collect()
    assert words == {r.book_id: r.n for r in whole}


def test_ranges(spark):
    from vellichor.functions import selection as S

    text = "Ja – »Makara, der   Fluss«, sagte er; gut."
    row = lambda c: spark.createDataFrame([(text,)], "text string").select(c(F.col("text")).alias("x")).first().x
    lit = lambda n: F.lit(n).cast("long")
    at = text.index("ara, der")
    assert tuple(row(lambda t: S.snapped(t, lit(at), lit(at + 7)))) == (6, 17) == tuple(row(lambda t: S.snapped(t, lit(at + 7), lit(at))))
    assert text[5:26] == "»Makara, der   Fluss«" and tuple(row(lambda t: S.snapped(t, lit(at), lit(text.index("luss") + 1), quotes=True))) == (5, 26)
    assert tuple(row(lambda t: S.trimmed(t, lit(-3), lit(3)))) == (0, 2) and row(lambda t: S.range_error(t, lit(17), lit(19))) == "blank" and row(lambda t: S.range_error(t, lit(3), lit(3))) == "range" and row(lambda t: S.range_error(t, lit(3), lit(5))) is None
    found = row(lambda t: S.breath_chunks(t, lit(100)))
    assert [(text[c.s - 100 : c.e - 100], c.text) for c in found] == [(c.text, c.text) for c in found] and "".join(c.text for c in found) == text
    assert [c.text for c in found if c.breath] == ["–", ",", ",", ";"] and row(lambda t: S.breath_chunks(F.lit("ohne"), lit(0))) is None
    assert tuple(row(lambda t: S.context(t, lit(6), lit(12), 8))) == ("Ja – »", "Makara", ", der  …") and [row(lambda t: S.char_class(F.lit(c))) for c in "aÄ1 ."] == ["nal", "nau", "n", "s", ""]


def test_colors_after_an_edit_keep_old_slots(spark):
    from vellichor.operators import commands

    lines = spark.createDataFrame([(1, 0, k, i) for i, k in enumerate("abcde")], "book_id long, chapter_ord long, speaker string, first long")
    slots = spark.createDataFrame([(1, "a", 0)], "book_id long, speaker string, slot int")
    old = spark.createDataFrame([(1, 0, "b", 0), (1, 0, "c", 4), (1, 0, "d", 4), (1, 0, "e", 1), (1, 0, "z", 2)], "book_id long, chapter_ord long, speaker string, slot int")
    assert {r.speaker: r.slot for r in commands.normal_colors(lines, slots, old).collect()} == {"b": 2, "c": 4, "d": 3, "e": 1}


def test_merging_follows_the_lines():
    t = frozenset
    assert attribution.merges([("leutnant-t", 3, t(["leutnant"]), False), ("t", 5, t(), False), ("kapitaen-t", 9, t(["kapitän"]), False)]) == {"kapitaen-t": "kapitaen-t", "t": "kapitaen-t", "leutnant-t": "leutnant-t"}
    assert attribution.merges([("a", 4, t(), True), ("herr-a", 4, t(["herr"]), False)]) == {"a": "a", "herr-a": "a"}
    assert attribution.merges([("dr-b", 1, t(["dr"]), False), ("b", 2, t(), False), ("prof-b", 1, t(["prof"]), False)]) == {"b": "b", "dr-b": "b", "prof-b": "b"}


def test_scripted_transport_answers_prompts(spark):
    from vellichor.operators import prompts

    ask = prompts.scripted_transport({r"R\d": '{"items": []}'})
    found = jobs.answered(spark.createDataFrame([(1, "R7?"), (2, "nothing")], "id long, prompt string"), ask)
    assert sorted(map(tuple, found.collect())) == [(1, '{"items": []}', None), (2, "{}", None)]
