import re

import corpus_pipeline
from pulsegrid.llm import toxicity
from pulsegrid.llm.common import written
from test_copies import shingle_groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs, out = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        out[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
    predicted = {r.doc_id: r.predicted for r in toxicity.score_documents(documents, labels).collect()}
    clean = {d for d in texts if not predicted[d]}
    assert {r.doc_id for r in out["toxicity"].collect()} == clean
    last = {}
    for d in sorted(clean):
        last[texts[d].encode().lower()] = d
    assert {r.doc_id for r in out["exact dedup"].collect()} == set(last.values())
    kept = {r.doc_id for r in out["near dedup"].collect()}
    groups = shingle_groups([(d, texts[d]) for d in last.values()], 5, 80)
    assert kept == {d for d, n, component in groups if d == component or not n} and len(kept) == out["near dedup"].count()
    mixed = [r.doc_id for r in out["mixing"].collect()]
    assert set(mixed) <= kept and max(mixed.count(d) for d in set(mixed)) <= 2
    words = lambda ids: sum(len(re.findall(r"[^\x20\x09-\x0D]+", texts[d])) for d in ids)
    assert abs(words(mixed) - 1.5 * words(kept)) < 0.05 * words(kept)
    pieces = out["packing"].where("piece = 0").collect()
    assert sorted(r.doc_id for r in pieces) == sorted(mixed)


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns


def chain(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, SF), "test")
        assert name == "packing" or docs.columns == columns
    return docs


def test_odd_rows_go_through_all_stages(spark, odd):
    """The rows 'null id' (twice without an id) and 'Same Text here' (three times) leave one row each."""
    pieces = chain(spark, odd).where("piece = 0")
    ids = {r.doc_id for r in pieces.collect()}
    assert {None, 6, 7, 8, 9} <= ids and 5 not in ids


def test_empty_table_goes_through_all_stages(spark, empty):
    assert chain(spark, empty).count() == 0
