import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as p
    from veridicta.llm.compression import quality_scores

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    before = docs
    outs = []
    for _, f in p.STAGES:
        out = f(spark, before, SF).cache()
        outs.append(out)
        before = out
    good = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert {r[0] for r in outs[0].select("doc_id").collect()} == {r[0] for r in good.select("doc_id").collect()}
    assert all(o.columns == docs.columns for o in outs[:4])
    texts = [r[0] for r in outs[1].select("text").collect()]
    assert len({tuple(t.split()) for t in texts}) == len(texts)
    assert outs[2].count() == outs[1].count()
    pieces = outs[4].groupBy("sequence_id").agg({"length": "sum"})
    assert pieces.where("`sum(length)` > 4096").isEmpty()
    assert p.run(spark, SF).count() == outs[4].count()
