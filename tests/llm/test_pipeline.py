"""The corpus pipeline: every stage against a plain version of its decision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from huestrata.llm import catalog, language, quality
from tests.llm.helpers import LARGER, LARGEST, documents, table
from tests.llm.test_near import plain_components, plain_fingerprint


def test_stages_are_named_and_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "packing"]


@pytest.fixture(scope="module")
def kept(spark):
    """What each filtering stage keeps of its own input."""
    docs, out = table(spark, "documents", LARGER), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, LARGER)
        assert after.columns == docs.columns
        out.append((docs.collect(), after.collect()))
        docs = after.sparkSession.createDataFrame(out[-1][1], docs.schema)
    return out


def test_filters_keep_exactly_what_their_models_say(spark, kept):
    words = catalog.language_model(spark, LARGER)
    scored = language.identify(table(spark, "documents", LARGER), words).collect()
    want = {r.doc_id for r in scored if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE}
    assert {r.doc_id for r in kept[0][1]} == want
    model = catalog.quality_model(spark, LARGER)
    sizes = quality.Sizes(model.good, model.bad)
    before, after = kept[1]
    score = dict(zip([r.doc_id for r in before], model.scores(np.array([sizes.difference(r.text) for r in before]))))
    assert {r.doc_id for r in after} == {i for i, s in score.items() if s >= corpus_pipeline.LEAST_QUALITY}
    assert len(after) < len(before)


def test_clean_documents_stay(spark, kept):
    good = {r.doc_id for r in table(spark, "labels", LARGER).filter("quality = 1").collect()}
    for before, after in kept[:2]:
        there = [r.doc_id for r in before if r.doc_id in good]
        assert len(good & {r.doc_id for r in after}) >= 0.97 * len(there)


def test_quality_stage_decides_as_op6(spark):
    """Scores between 0.3 and 0.5, of which sf0.1 has some, are rejected by both."""
    good = {r.doc_id for r in catalog.op6_quality(spark, LARGEST).filter("predicted = 1").collect()}
    kept = corpus_pipeline.by_quality(spark, table(spark, "documents", LARGEST), LARGEST)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good


def test_one_document_of_each_component_stays(kept):
    before, after = kept[2]
    before = sorted(before, key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(before[i].doc_id for i in set(roots))
    assert len(after) < len(before)


def test_dedup_of_rows_without_ids_and_repeats(spark):
    long = "one two three four five six seven eight nine ten"
    docs = documents(spark, [long, long, "other words are in here", "other words are in here", None, ""], [None, 4, None, None, 9, 9])
    stage = corpus_pipeline.STAGES[2][1]
    rows = stage(spark, docs.withColumn("extra", F.lit(1)), "unused").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == [
        (False, 4, long), (False, 9, ""), (True, 0, "other words are in here"),
    ]
    assert stage(spark, docs.filter("false"), "unused").collect() == []


def test_run_packs_what_is_left(spark, kept):
    rows = corpus_pipeline.run(spark, LARGER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[2][1]}
    lengths = {}
    for r in rows:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


CLASHES = {"_lang": "kept", "_score": 0.25, "_digest": "own", "_key": "k", "_fp": 7, "_count": 3, "lang_pred": "x", "score": 1}


def with_clashes(docs):
    return docs.withColumns({name: F.lit(value) for name, value in CLASHES.items()})


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:-1]])
def test_columns_of_clashing_names_keep_their_values(spark, stage):
    docs = table(spark, "documents", LARGER).limit(60)
    plain = stage(spark, docs, LARGER)
    clashing = stage(spark, with_clashes(docs), LARGER)
    assert clashing.columns == [*docs.columns, *CLASHES]
    rows = clashing.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect()) != []
    assert all(r[name] == value for r in rows for name, value in CLASHES.items())


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, stage):
    docs = table(spark, "documents", LARGER).filter("false")
    assert stage(spark, docs, LARGER).collect() == []


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:2]])
def test_filters_decide_by_the_text_alone(spark, stage):
    """Null ids, repeated rows and nulls elsewhere change no decision; null texts never count as a language."""
    docs = table(spark, "documents", LARGER).limit(40)
    bare = docs.select(*[F.lit(None).cast(t).alias(c) if c != "text" else F.col(c) for c, t in docs.dtypes])
    kept = sorted(r.text for r in stage(spark, docs, LARGER).collect())
    assert sorted(r.text for r in stage(spark, bare.unionByName(bare), LARGER).collect()) == sorted(kept * 2)
    null = docs.limit(1).withColumn("text", F.lit(None).cast("string"))
    if stage is corpus_pipeline.by_language:
        assert stage(spark, null, LARGER).collect() == []
    else:
        assert stage(spark, null, LARGER).count() == stage(spark, null.fillna("", ["text"]), LARGER).count()


def test_of_rows_with_one_id_and_text_the_first_by_digest_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b", None, None), (1, text, "a", None, None), (1, None, "a", None, None), (1, "", "a", None, None)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    stage = corpus_pipeline.without_near_duplicates
    found = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, schema).repartition(parts)
        found.add(tuple(sorted(map(tuple, stage(spark, docs, "unused").collect()), key=repr)))
    assert len(found) == 1
    assert len(found.pop()) == 2


def test_rows_that_go_are_taken_out_by_shuffle_where_they_are_many(spark, monkeypatch, kept):
    from huestrata.sources import shared

    before, after = kept[2]
    docs = spark.createDataFrame(before, table(spark, "documents", LARGER).schema)
    monkeypatch.setattr(shared.broadcast_if_small, "__defaults__", (0,))
    rows = corpus_pipeline.without_near_duplicates(spark, docs, "unused").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in after)
