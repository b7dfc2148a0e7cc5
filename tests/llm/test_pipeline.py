"""The chain against what each stage has to do, on the smallest tables and on planted cases."""

import os

import pytest

import corpus_pipeline
from fitloom.llm import common, packing, registry, secrets, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = common.read(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stage(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    toxic = {r.doc_id for r in common.read(spark, SF, "labels").filter("toxic = 0").collect()}
    kept = {r.doc_id for r in seen["toxicity"][1].collect()}
    assert len(toxic - kept) <= 0.03 * len(toxic)
    comp = simhash.near_duplicates(seen["simhash"][0]).toPandas()
    assert {r.doc_id for r in seen["simhash"][1].collect()} == set(comp.component_id)
    for r in seen["secrets"][1].collect():
        assert not secrets.base_findings(r.text)
    texts = {r.doc_id: r.text for r in seen["secrets"][1].collect()}
    mixed = seen["mixing"][1].collect()
    assert all(texts[r.doc_id] == r.text for r in mixed)
    want = sum(r.length for r in common.stage(packing.pieces(seen["mixing"][1], packing.tokenizer_path()), "test-p").collect())
    assert sum(r.length for r in docs.collect()) == want


def test_registry_names():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")] == list(range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
