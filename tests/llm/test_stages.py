"""Stages of the pipeline on small documents."""

import random

import corpus_pipeline


def test_near_dedup_keeps_one_row_of_each_group(spark):
    words = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [
        (None, words("a")), (None, words("a").upper()), (None, words("a")),  # a group of null ids only
        (None, words("b")), (1, words("b").upper()),  # a null id in a group with another id
        (2, words("c")), (2, words("d")), (0, words("d").upper()),  # an id in two groups, least in one
        (3, words("e")), (3, words("e").upper()), (3, words("f")), (3, words("f")),  # an id in two groups, several times in each
        (None, None), (4, ""),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string")
    found = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(found, key=str) == sorted([(None, words("a")), (1, words("b")), (2, words("c")), (0, words("d")), (3, words("e")), (3, words("f")), (4, "")], key=str)


def test_suffix_dedup_leaves_replacement_characters_of_the_text(spark):
    r = random.Random(4)
    passage = " ".join(r.choices(["rain", "stone", "gr\u00fcn", "lamp", "river", "moon"], k=80))
    # \u00e9 and \u0169 end in the same byte, \u00e9 and \u00e8 begin with the same one
    texts = ["a\ufffdb \u00e9" + passage + "\u00e9 end\ufffd", "two \u0169" + passage + "\u00e8 fin", "left \ufffd alone"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    expected = ["a\ufffdb  end\ufffd", "two  fin", "left \ufffd alone"]
    assert found == {k: (t, len(t)) for k, t in enumerate(expected)}
