"""The corpus pipeline and the registered queries on small tables."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from orbweave.llm import chosenpath, langid, linetemplates, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and gave, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).checkpoint()
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_in_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "language_id", "line_dedup", "ngram_jaccard", "best_fit_packing"]
    for _, given, made in stages[:-1]:
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(ids(made)) <= set(ids(given))


def test_each_decision_takes_effect(spark, stages):
    (_, raw, clean), (_, _, known), (_, _, lines), (_, _, single), (_, _, packed) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.toxicity(raw, labels, corpus_pipeline._learn, "toxic", "doc_id", "text")
    assert ids(clean) == ids(scored.where("predicted = 0"))
    found = langid.languages(clean, corpus_pipeline._learn(F.col("doc_id")), "lang", "doc_id", "text")
    assert ids(known) == ids(found.where("not rejected"))
    assert ids(lines) == ids(known)
    kept = linetemplates.drop_recurring_lines(known, "doc_id", "text")
    assert {(r[0], r[1]) for r in lines.select("doc_id", "text").collect()} == {
        (r[0], r[1]) for r in kept.select("doc_id", "text").collect()}
    assert lines.where("n_chars <> length(text)").count() == known.where("n_chars <> length(text)").count()
    classes = chosenpath.similarity_classes(lines, "doc_id", "text").join(lines.select("doc_id", "text"), "doc_id")
    assert ids(single) == ids(classes.where("doc_id = class_id"))
    assert sorted(set(ids(packed))) == ids(single)


def test_run_equals_stages(spark, stages):
    """Both place the same pieces; which of two equally long ones comes first is open."""
    same = [sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
            for df in (corpus_pipeline.run(spark, SF), stages[-1][2])]
    assert same[0] == same[1]


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12", None, "s", 2), (None, "the thing", "en", "s", 9),
            (4, "x " * 50_000, "en", "s", 1), (5, "the thing over there", "en", "s", 1), (6, "the thing over there", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            made = stage(spark, given, SF)
            assert made.count() <= max(1, given.count()) * 30


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert {"op3_line_dedup", "op5_nearest_neighbours", "op8_exact_dedup", "op9_ngram_jaccard", "op11_repeats", "op12_phrases"} <= set(entry.oracle_sql())


def test_of_documents_without_words_one_stays(spark):
    rows = [(7, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (5, None, "en", "s", 0), (9, "words that stay", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert ids(corpus_pipeline.drop_near_copies(spark, docs, SF)) == [3, 9]
