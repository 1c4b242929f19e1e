"""Every stage of the pipeline against brute force on its own input, and run() against the stages."""

import corpus_pipeline
import pytest
from test_operators import brute_leaks, brute_lines, brute_links, words_of

from vellichor.llm import toxicity
from vellichor.llm.queries import NOT_HELD_OUT


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        if name != "packing":
            assert found.columns == docs.columns, name
            assert dict(found.dtypes) == dict(docs.dtypes), name
        docs = spark.createDataFrame(found.collect(), found.schema)
        out.append(docs.collect())
    return out


def texts_of(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]


def test_toxicity_stage(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), usable=NOT_HELD_OUT)
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert sorted(texts_of(stages[1])) == sorted(x for x in texts_of(stages[0]) if x[0] not in toxic)


def test_line_stage(stages):
    wanted = brute_lines(texts_of(stages[1]))
    found = dict(texts_of(stages[2]))
    assert found == wanted
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_join_stage(stages):
    components = brute_links(texts_of(stages[2]))
    assert {r.doc_id for r in stages[3]} == {d for d, (_, c) in components.items() if c == d}


def test_decontamination_stage(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = texts_of(stages[3])
    short = [(d, t) for d, t in rows if len(t) < 4000]
    leaking = {d for d, _ in brute_leaks(short, items)}
    kept = {r.doc_id for r in stages[4]}
    assert {d for d, _ in short} - leaking == kept & {d for d, _ in short}


def test_packing_stage_and_run(spark, sf, stages):
    assert sum(r.n_words for r in stages[5]) == sum(len(words_of(t)) for _, t in texts_of(stages[4]))
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages[5]))
