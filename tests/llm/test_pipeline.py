import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_their_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            after = docs.count()
            assert 0 < after <= before
            before = after
        else:
            whole = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert len(whole) == before
            assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)
