"""The pipeline's rows against the stages' operators, stage by stage."""

import re

import corpus_pipeline
from strandloom.llm import wide_simhash

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    from strandloom.llm.staging import stage

    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, before, SF), name)
        assert after.columns == columns, name
        kept, had = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= had and len(kept) == after.count()
        if name == "line_dedup":
            assert kept == had
        if name == "simhash_near_dedup":
            classes = wide_simhash.near_copies(before).collect()
            assert kept == {r.component_id for r in classes}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(max(1, len(w) - 12)) if w}
            assert {len(w) for w in windows} == {13}
            clean = lambda w: windows.isdisjoint(tuple(w[i : i + 13]) for i in range(len(w) - 12))
            assert kept == {r.doc_id for r in before.collect() if clean(words(r.text))}
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    ids = [(r.doc_id, r.mix_copy) for r in mixed.select("doc_id", "mix_copy").collect()]
    assert len(ids) == len(set(ids)) and {d for d, _ in ids} <= {r.doc_id for r in before.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.mix_copy) for r in again.select("doc_id", "mix_copy").collect()) == sorted(ids)
