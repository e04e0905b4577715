"""The corpus pipeline as a whole, on the smallest tables, against the operators that it calls one by one."""

import corpus_pipeline
from fennmark.llm import bpe, decontamination, jaccard, quality, secrets
from fennmark.llm.queries import BYTE_BPE
from fennmark.llm.shared import stored, table

SF_DIR = "/root/testdata/sf0.001"


def test_whole_run_keeps_what_its_stages_keep(spark):
    docs = table(spark, SF_DIR, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "benchmark_passages", "secret_scans", "tokens"]
    kept = stored(quality.kept_documents(docs), "pipeline-test")
    single = stored(jaccard.one_of_each(kept), "pipeline-test")
    clean = stored(decontamination.clean_documents(single, table(spark, SF_DIR, "benchmark")), "pipeline-test")
    hand = bpe.encode_documents(stored(secrets.redact(clean), "pipeline-test"), BYTE_BPE, with_ids=True, with_text=False)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == hand.columns
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect())
    assert rows == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in hand.collect())
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert 0 < len(rows) < len(ids) and {r[0] for r in rows} <= set(ids) and len({r[0] for r in rows}) == len(rows)
