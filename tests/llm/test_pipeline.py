import corpus_pipeline as cp
import public_tokenizers
from helpers import SMALL, docs
from tokenizers import Tokenizer

from gradeflow.llm import decontam, secret_scan, simhash, toxicity
from gradeflow.llm.common import table, write_scratch


def test_stages_one_by_one(spark):
    kept = table(spark, SMALL, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    for name, stage in cp.STAGES:
        out = write_scratch(stage(spark, kept, SMALL), "t")
        before, after = kept.collect(), out.collect()
        if name != "encoding":
            assert out.dtypes == kept.dtypes
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            p = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(kept, table(spark, SMALL, "labels")).collect()}
            assert ids == {k for k, v in p.items() if not v}
        elif name == "near_duplicates":
            c = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept).collect()}
            assert ids == set(c.values()) and len(after) == len(ids)
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.leaks(kept, table(spark, SMALL, "benchmark")).collect()}
            assert ids == {r["doc_id"] for r in before} - bad
        elif name == "secrets":
            old = {r["doc_id"]: r["text"] for r in before}
            assert ids == set(old)
            changed = [r["doc_id"] for r in after if r["text"] != old[r["doc_id"]]]
            assert set(changed) <= {k for k, t in old.items() if secret_scan.candidates_of(t or "")}
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            n = {r["doc_id"]: len(lib.encode(r["text"] or "").ids) for r in before}
            assert {r["doc_id"]: r["n_tokens"] for r in after} == n
        kept = out
    assert {tuple(r) for r in cp.run(spark, SMALL).collect()} == {tuple(r) for r in kept.collect()}


def test_stages_on_an_empty_table(spark):
    for name, stage in cp.STAGES:
        assert stage(spark, docs(spark, []).drop("key").limit(0), SMALL).collect() == []
