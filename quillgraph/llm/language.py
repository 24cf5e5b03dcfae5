"""Language identification by compression: the language whose dictionary compresses a text best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_sample, id_remainder, mapped, read
from quillgraph.llm.zdict import Codec, content

LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def fit(docs: DataFrame, learn: Column, per_language: int = 1000, dictionary_bytes: int = 400_000, all_bytes: int = 64_000_000, excerpt: int = 2000) -> dict[str, bytes]:
    """A raw-content dictionary for each language.

    Learns from about `per_language` rows a language among those where `learn` holds, with text and lang; of a text
    of over `excerpt` characters, from eight slices of that many together that stand evenly over all of it. A
    dictionary has at most dictionary_bytes, all together all_bytes: that bounds what is broadcast however many
    languages there are. A language needs at least one row with a letter. No such row at all: no dictionaries.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.col("lang").alias("l"))
    some = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.col("t"), (i * F.floor(F.char_length("t") / 8) + 1).cast("int"), F.lit(excerpt // 8))), "\n")
    picked = bounded_sample(rows, "l", ["id", "t"], per_language).withColumn("t", F.when(F.char_length("t") > excerpt, some).otherwise(F.col("t"))).distinct()
    texts: dict[str, list[bytes]] = {}
    for r in picked.orderBy("l", "id", "t").toLocalIterator():
        if LETTER.search(r.t):
            texts.setdefault(r.l, []).append(r.t.lower().encode("utf-8", "replace"))
    each = min(dictionary_bytes, all_bytes // max(1, len(texts)))
    return {k: content(v, each) for k, v in sorted(texts.items())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], held_out: Column, margin: float = 0.01, level: int = 6, piece: int = 2048) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs, from its whole text.

    The smallest compressed size wins; of equal ones, the language with the larger dictionary, then by name. score is the weight of the winner among
    exp(-(size - smallest) / scale). A long text is compressed piece by piece, so memory doesn't grow with it. rejected: the second size is within `margin` of the smallest, or there was
    nothing to decide on. Null text, no letter or no dictionaries: `und`, score 0, rejected. Other columns of docs are
    not read; repeated rows give repeated results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = [(k, -len(v), Codec(v, level, piece)) for k, v in shared.value.items()]
        for batch in batches:
            names, scores, rejected = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if text is None or not codecs or not LETTER.search(text):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                data = text.lower().encode("utf-8", "replace")
                sizes = sorted((c.size(data), n, k) for k, n, c in codecs)
                least = sizes[0][0]
                scale = 1 + 0.01 * least
                names.append(sizes[0][2])
                scores.append(1 / sum(math.exp(-(s - least) / scale) for s, *_ in sizes))
                rejected.append(len(sizes) > 1 and sizes[1][0] - least < margin * least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out.alias("held_out")), run, SCHEMA)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the hold-out fold: see classify()."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return classify(docs, fit(docs, ~held), held)
