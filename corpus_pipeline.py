"""The corpus pipeline: five stages over documents, each one operator of quillgraph.llm.

Toxic documents go; of near-duplicates one stays; personal data becomes placeholders; sources are mixed to their
target weights; what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import jaccard, mixing, packing, pii, toxicity
from quillgraph.llm.common import id_remainder, read, shared_dir


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels outside its hold-out fold."""
    learn = F.coalesce(id_remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), learn))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def personal_data_goes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans replaced by their kind; n_chars follows the new text."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenized documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_go),
    ("near_copies", near_copies_go),
    ("personal_data", personal_data_goes),
    ("mixing", sources_mixed),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Each stage's rows are written to the shared folder and read by the next; once that has written its own, they are
    removed, so that one copy of the corpus is there at a time. The last one is left to the returned DataFrame.
    Nulls, empty texts, repeated rows, empty tables and clashing columns are as the stages' operators state.
    """
    docs = read(spark, sf_dir, "documents")
    where, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{where}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
