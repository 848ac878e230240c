"""Near duplicates among rows whose doc_id is null or repeated."""

from collections import Counter

import corpus_pipeline

from barspark.llm.ngram_jaccard import jaccard_classes

A = " ".join(f"w{k}" for k in range(60))
B = A + " tail"
ALONE = " ".join(f"z{k}" for k in range(60))


def test_a_copy_without_id_comes_first(spark):
    # In one task, in this order: the copy without an id must not stand for the one with an id.
    df = spark.createDataFrame([(None, A), (5, A), (1, B)], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id, r.set_id) for r in jaccard_classes(df).collect()}
    assert got == {(None, 1, 5), (5, 1, 5), (1, 1, 1)}


def test_one_row_of_each_class_stays(spark):
    rows = [(None, A), (1, A), (1, B), (1, A), (7, B), (None, ALONE), (None, ALONE), (9, ALONE), (3, "only one"), (None, None), (None, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = corpus_pipeline.one_of_each_class(spark, df, "")
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    first = [x for x in got if x in ((1, A), (1, B))]
    assert len(first) == 1 and got == Counter([*first, (9, ALONE), (3, "only one"), (None, None), (None, ""), (4, None)])
