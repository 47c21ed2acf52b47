from collections import Counter

import corpus_pipeline
from burrow.llm import fertility, forest_join, secret_scan, toxicity
from burrow.llm.queries import QUERIES, query  # noqa: F401
from burrow.session import materialise

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, DATA), name)
        assert after.columns == docs.columns
        if name == "toxicity":
            dropped = {r.doc_id for r in toxicity.judged(before, marks).where("predicted = 1").collect()}
        elif name == "quality_rules":
            import public_tokenizers as p

            judged = fertility.judged(before, p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model"))
            dropped = {r.doc_id for r in judged.where("NOT kept").collect()}
        elif name == "jaccard_join":
            dropped = {r.doc_id for r in forest_join.linked(before).where("doc_id <> class_id").collect()}
        else:
            dropped = set()
            assert secret_scan.scanned(after).where("is_secret").count() == 0
        assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect() if r.doc_id not in dropped)
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    assert Counter((r.doc_id, r.piece) for r in rows) == Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, DATA).collect())


def test_stages_of_odd_and_no_rows(spark, odd, none_at_all):
    for docs in (odd, none_at_all):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            kept = out.count()
            assert kept <= n or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
