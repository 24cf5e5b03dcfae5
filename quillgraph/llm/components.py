"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import attach, cut, mapped, sweep


#: Links that one task joins into trees at once.
LOCAL = 10_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that connect what the given ones do, LOCAL of them at a time: each node hangs on its least one."""

    def flat(links: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(y, y)
            return x

        for u, v in links:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
        ends = [(x, root(x)) for x in list(parent)]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends if e[0] != e[1]], pa.int64()) for k in (0, 1)], ["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        while len(held) > LOCAL:
            yield flat(held[:LOCAL])
            held = held[LOCAL:]
    yield flat(held)


def _least(links: DataFrame) -> DataFrame:
    """For each node u its smallest neighbour or itself, as m, beside each link (u, v)."""
    low = links.groupBy("u").agg(F.min("v").alias("q_m"), F.count(F.lit(1)).alias("q_n"))
    return attach(links, low.select("u", F.least("u", "q_m").alias("m"), "q_n"), "u")


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the smallest node that links reach.

    First every LOCAL links are made into stars where they are; that is all where there are no more than those. Else
    each round hangs every node's larger neighbours, then its smaller ones, onto the smallest; a component of n nodes
    becomes a star in about log n rounds. Every round is written to the shared folder. No link: no rows.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    n = _state(now)[0]
    now = cut(mapped(now.coalesce(max(1, -(-n // LOCAL))), _stars, "u long, v long"))
    before = None
    while n > LOCAL and (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(large)
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        del both, large, small
        sweep(links.sparkSession)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
