"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
from moodtide.llm import common
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in common.table(spark, FOLDER, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.written(stage(spark, docs, FOLDER))
        after = {r["doc_id"]: r["text"] if "text" in docs.columns else None for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert set(before) - set(after) <= {i for i, t in before.items() if not re.search(r"[^\W\d_]", t or "") or len(t) < 40}
        elif name == "lines":
            gone, want = brute.line_rows(list(before.items())), {}
            for i, t in before.items():
                own = (t or "").split("\n")
                full = [k for k, x in enumerate(own) if re.search(brute.BLANK, x)]
                if not full or any((i, k) not in gone for k in full):
                    want[i] = "\n".join(x for k, x in enumerate(own) if (i, k) not in gone)
            assert after == want
        elif name == "near_duplicates":
            _, component = brute.components(list(before.items()))
            assert set(after) == {i for i in before if component.get(i, i) == i}
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not brute.contamination(t, items)[2]}
        else:
            assert set(after) == set(before)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
