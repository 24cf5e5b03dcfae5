"""Quality by compression: is a text cheaper under the dictionary of good or of bad labelled text?"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_sample, id_remainder, mapped, read, spread
from quillgraph.llm.zdict import Codec, content

#: Level of compression and bytes of a piece: short pieces keep the dictionary, not the text itself, in command.
LEVEL, PIECE = 9, 512
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the line that turns a size difference into log odds."""

    good: bytes
    bad: bytes
    slope: float
    shift: float

    def scorer(self):
        good, bad = Codec(self.good, LEVEL, PIECE), Codec(self.bad, LEVEL, PIECE)

        def score(text: str | None) -> float:
            x = difference(good, bad, (text or "").encode("utf-8", "replace"))
            return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -40, 40))))

        return score


def difference(good: Codec, bad: Codec, data: bytes) -> float:
    """(size under bad - size under good) / their sum: above 0 if the text is more like the good ones."""
    b, g = bad.size(data), good.size(data)
    return (b - g) / (b + g)


def line(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, each class with half of the weight."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    c = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        c = c + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (w * (y - p)) - 1e-2 * c)
    return float(c[0] / scale), float(c[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, dictionary_bytes: int = 400_000, longest: int = 200_000) -> Model:
    """Dictionaries from half of a bounded sample of labelled rows (about per_class of each class), the line from the rest.

    A dictionary of dictionary_bytes takes an equal share of each of its texts: see content(). The line is fitted to
    whole texts. Labelled texts of over `longest` characters aren't drawn, so that what comes to the driver has a
    bound; scoring has no such limit. Of several texts of one id one is taken. Only label rows where `learn` holds count; null labels or texts don't. Without rows of both classes the
    score is 0.5 for any text.
    """
    marks = labels.where(learn & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    picked = bounded_sample(marks, "y", ["id"], per_class)
    # about 2 * per_class ids, so this side is small whatever the corpus holds
    rows = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= longest)).select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(picked.distinct()), "id")
    rows = rows.groupBy("id", "y").agg(F.min("t").alias("t")).withColumn("h", spread(F.col("id"), F.lit("half")))
    texts: dict[tuple[int, bool], list[bytes]] = {}
    for r in rows.orderBy("id", "y").toLocalIterator():
        texts.setdefault((r.y, r.h < 0.5), []).append(r.t.encode("utf-8", "replace"))
    good, bad = (content(texts.get((k, True), []), dictionary_bytes) for k in (1, 0))
    if not good or not bad:
        return Model(good, bad, 0.0, 0.0)
    g, b = Codec(good, LEVEL, PIECE), Codec(bad, LEVEL, PIECE)
    pairs = [(difference(g, b, t), k) for k in (0, 1) for t in texts.get((k, False), [])]
    if len({k for _, k in pairs}) < 2:
        return Model(good, bad, 200.0, 0.0)
    x, y = (np.array(v, dtype=float) for v in zip(*pairs, strict=True))
    return Model(good, bad, *line(x, y))


def classify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from its whole text alone.

    Null counts as an empty text and gets a score too. Repeated rows give repeated results; other columns of docs
    are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*shared.value).scorer()
        for batch in batches:
            s = np.array([score(v.as_py()) for v in batch.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out.alias("held_out")), run, SCHEMA)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside the hold-out fold: see classify()."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return classify(docs, fit(docs, labels, ~held), held)
