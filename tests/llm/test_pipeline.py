"""The pipeline stage by stage against plain Python."""

import corpus_pipeline


def test_stages_keep_their_promises(spark, sf):
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == before.columns
        rows, kept = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(kept) <= set(rows)
        if name == "exact_dedup":
            last = {}
            for i, r in rows.items():
                key = r["text"].encode().lower()
                last[key] = max(i, last.get(key, i))
            assert set(kept) == set(last.values())
        if name == "secret_scan":
            assert set(kept) == set(rows) and all(r["n_chars"] == len(r["text"]) for r in kept.values())
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
