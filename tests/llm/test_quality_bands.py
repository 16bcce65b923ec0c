"""The pipeline's quality stage on short labelled documents, by bands of length."""

import corpus_pipeline


def test_short_documents_are_judged_by_their_common_words(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, folder).select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    base = corpus_pipeline.quality.verdicts(docs).where("not base_failed").select("doc_id", "n_words").collect()
    for low, high, good, bad in ((50, 100, 38, 0), (100, 200, 85, 2)):
        band = [r.doc_id for r in base if low <= r.n_words < high and r.doc_id in labels]
        assert [sum(labels[x] == q and x in kept for x in band) for q in (1, 0)] == [good, bad]
        assert all(x in kept for x in band if labels[x] == 1)
    assert not {233, 442, 890, 982} & kept
