"""Stages of the pipeline on rows of their own."""

import corpus_pipeline


def test_later_stages_get_the_identified_language(spark):
    words = {"en": "the thing that they were seeing there", "de": "und der Schnee ist nicht schwarz gewesen"}
    rows = [(2 * i + j, f"{words[lang]} {i}", lang) for i in range(60) for j, lang in enumerate(words)]
    rows += [(1000, words["de"], "en"), (1001, words["en"], None), (1002, "123", "en"), (1003, "vj", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars")
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns
    langs = {r.doc_id: r.lang for r in found.collect()}
    assert langs[1000] == "de" and langs[1001] == "en" and langs[0] == "en" and langs[1] == "de"
    assert not {1002, 1003} & langs.keys() and len(langs) == 122
