"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

import re
from collections import Counter

import corpus_pipeline
from test_operators_llm import brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    other = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert len(other - kept) <= 0.1 * len(other)
    insults = {r.doc_id for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"), "doc_id").collect() if re.search("moron|idiot|stupid|clown|loser|scum|trash", r.text or "")}
    assert insults and len(insults & kept) <= 0.2 * len(insults)
    lines = stages["line_dedup"](spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert lines.columns == columns and sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == brute_lines(rows)
    one = stages["ngram_jaccard_join"](spark, docs, SF)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {c for _, c in brute_classes(rows).values()}
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "ids"] and {r.doc_id for r in out.collect()} <= {i for i, _ in rows}
