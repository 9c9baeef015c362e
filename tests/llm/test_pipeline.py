"""Each stage of the pipeline against its operator's rules, and the driver's contract without the package."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from faultfold.llm import pii, quality_rules
from faultfold.llm.common import written


def test_stages(spark, data, read):
    docs = read("documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, data), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        seen[name] = (before, after)
    for name in ("quality_classifier", "quality_rules", "near_dedup"):
        before, after = seen[name]
        assert 0.5 * len(before) < len(after) < len(before)
        assert all(after[i] == before[i] for i in after)
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    before, after = seen["quality_classifier"]
    wrong = [i for i in labels if i in before and (i in after) != bool(labels[i])]
    assert len(wrong) <= 0.05 * len(labels)
    before, after = seen["quality_rules"]
    kept = quality_rules.ledger(spark.createDataFrame(list(before.values()))).where(
        ~quality_rules.failed(quality_rules.CURRENT)
    )
    assert {r.doc_id for r in kept.collect()} == set(after)
    before, after = seen["pii"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert not pii.rule_spans(r.text) and r.n_chars == len(r.text)
        if not pii.rule_spans(before[i].text):
            assert r.text == before[i].text or "[PHONE]" in r.text or "[CARD]" in r.text or "[IP]" in r.text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"][1])


def test_the_rest_works_without_the_package():
    root = Path(corpus_pipeline.__file__).parent
    code = (
        "import sys; sys.modules['faultfold.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and len(e.queries()) > 80"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
    for path in (root / "faultfold").rglob("*.py"):
        if "llm" not in path.parts:
            assert "faultfold.llm" not in path.read_text()
