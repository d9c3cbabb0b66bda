"""The stages in turn hold what each operator says of its own input."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import decontaminate, minhash  # noqa: E402
from pathlib import Path  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(SF))
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, docs)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    before, after = seen["near_duplicates"]
    want = minhash.brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {w[0] for w in want if w[3]}
    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = before.collect()
    want = {r.doc_id for r, b in zip(rows, decontaminate.brute([r.text for r in rows], items), strict=True) if not b[-1]}
    assert {r.doc_id for r in after.collect()} == want
    before, after = seen["pii"]
    assert after.count() == before.count()
    assert seen["sentencepiece"][1].where("not exact").count() == 0
    assert corpus_pipeline.run(spark, str(SF)).count() == docs.count()
