import corpus_pipeline
from tenetdq.llm.common import table
from tests.llm.helpers import empty
from tests.llm.test_dedup import exact_by_hand, near_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    start = docs.collect()
    extra = spark.createDataFrame([(None, None, None, None, None), (10_000, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, SF)
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in start}
    once = stages["exact_dedup"](spark, spoken, SF)
    owners = {k for k, _ in exact_by_hand([(r.doc_id, r.text) for r in start]).values()}
    rows = sorted(once.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in rows} == owners
    near = stages["minhash_near_dedup"](spark, once, SF)
    heads = {rows[h].doc_id for _, _, h in near_by_hand([r.text for r in rows], 5, 80)}
    assert {r.doc_id for r in near.collect()} == heads
    clean = stages["benchmark_decontamination"](spark, near, SF)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    held = {r.doc_id for r in near.collect() if any(i in r.text for i in items)}
    assert {r.doc_id for r in clean.collect()} == heads - held
    assert docs.columns == spoken.columns == once.columns == near.columns == clean.columns
    packed = stages["best_fit_packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == heads - held


def test_stages_on_an_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
