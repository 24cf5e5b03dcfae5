import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by resharing the excess again and again, as stated."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 0, "b": 5, None: 7}, {"z": 3}, {f"s{i}": (i * 37) % 91 + 1 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_query_equals_sql_and_meets_targets(spark):
    sf = "/root/testdata/sf0.001"
    df = mixing.op8_systematic_mix(spark, sf)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ", ".join(df.columns)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(c.sql(f"SELECT {names} FROM ({mixing.ORACLE})").fetchall())
    assert all(taken <= 2 * size for _, size, _, _, taken in rows)


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 3}") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.plan(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect():
        assert abs(r.k - r.t) <= 800


def test_ranks_without_one_task(spark):
    d = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    got = mixing.ranked(d, "g", [F.col("v").desc()], ["g", "v"]).collect()
    assert all(r.q_rank == 5000 - r.v for r in got)


def test_mix_emits_the_planned_copies(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 4}") for i in range(200)] + [(5, "same", "s1")] * 6
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = sum(r.copies for r in mixing.plan(d).collect())
    out = mixing.mix(d)
    assert out.count() == planned and out.columns == d.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(d).collect()))


def test_ties_and_maps(spark):
    rows = [(1, f"w{i} x", "s", {"k": i % 3}) for i in range(40)] * 2 + [(None, "a b", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string, int>")
    out = mixing.mix(d)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in mixing.plan(d).collect())
    again = mixing.mix(spark.createDataFrame(rows[::-1], d.schema).repartition(7))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
