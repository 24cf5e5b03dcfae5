from pyspark.sql import functions as F

import corpus_pipeline

from quillgraph.llm import pii, toxicity
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs.collect(), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = {r.doc_id for r in kept["toxicity"]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 and r.doc_id not in clean for r in before) <= 0.1 * len(before)
    groups = brute([(r.doc_id, r.text) for r in kept["toxicity"]], 5, 80)
    assert {r.doc_id for r in kept["near_copies"]} == {i for i, (_, c) in groups.items() if i == c}
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in kept["personal_data"])
    assert len(kept["personal_data"]) == len(kept["near_copies"])
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["personal_data"]}
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mixing"]}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rejects_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    scorer = toxicity.Scorer(model)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {r.doc_id for r in docs.collect() if scorer.score(r.text) < 0.5}
