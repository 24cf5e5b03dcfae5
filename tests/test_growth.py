"""What steps make in between: rows and shuffles that would grow faster than the tables."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import match
from quillgraph.plans import views, workload

SF = "/root/testdata/sf0.001"


def nodes(df):
    """The nodes of df's plan after a run, without repeats."""
    df.collect()
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        x = left.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(x.plan())
        else:
            out.append(x)
            left += [x.children().apply(i) for i in range(x.children().size())]
    return out


def most_rows(df):
    found = [x.metrics().get("numOutputRows") for x in nodes(df)]
    return max(m.get().value() for m in found if m.isDefined())


def test_many_references_and_publications_share_a_key(spark):
    rng = random.Random(7)
    kinds = ("article", "book", None)
    pubs = [(f"p{i}", "10.1/A", "Title", rng.choice(kinds if k else kinds[1:]), rng.choice((None, *range(2000, 2009))), rng.choice((None, 0, 3, 7))) for k in (0, 1) for i in range(k * 200, k * 200 + 200)]
    refs = [(i, f"10.1/{'a' if i % 2 else 'b'}", "title" if i % 3 else "", rng.choice((None, *range(1998, 2012)))) for i in range(300)]
    keyed = match.publication_keys(
        spark.createDataFrame(pubs, "id string, doi string, t string, type string, year int, citations_count bigint").select(
            "id", "doi", F.struct(F.col("t").alias("preferred")).alias("title"), F.struct(F.lit("v").alias("name")).alias("conference"), F.struct(F.lit("s").alias("title")).alias("source"), "type", "year", "citations_count", F.array().alias("authors")
        )
    )

    def best(hint):
        order = lambda p: ({"article": 0, "book": 4}.get(p[3], 9), abs((p[4] or 9999) - (hint or 9999)), -(p[5] or 0), p[0])
        return min(pubs, key=order)[0]

    found = match.matched(spark.createDataFrame(refs, "row_uid int, doi_key string, title_key string, year_hint bigint"), keyed)
    want = {(i, "doi" if doi == "10.1/a" else "title", best(hint)) for i, doi, title, hint in refs if doi == "10.1/a" or title}
    assert {(r.row_uid, r.method, r.pub_id) for r in found.collect()} == want
    assert most_rows(found) <= len(pubs) + len(refs)


def reads(df, column):
    """Scans in df's plan that read `column`."""
    return sum(x.nodeName().startswith("Scan parquet") and column in x.output().mkString() for x in nodes(df))


@pytest.mark.parametrize("name", ["nested_regroup", "shared_contexts", "per_paper_rate", "anova_stats", "intent_ci"])
def test_lines_travel_once_to_their_orders_and_not_to_parts(spark, name):
    df = workload.QUERIES[name](spark, SF)
    twice = 2 if name == "intent_ci" else 1  # the human level beside each bar
    assert reads(df, "l_orderkey") <= twice and reads(df, "p_partkey") == 0


@pytest.mark.parametrize("name", ["distance_medians", "distance_kde", "mean_distance_per_context"])
def test_tasks_follow_the_size_of_the_tables(spark, monkeypatch, name):
    monkeypatch.setattr(views, "TASK_BYTES", 10_000, raising=False)
    lines = views.table(spark, SF, "lineitem")
    most = max(x.outputPartitioning().numPartitions() for x in nodes(workload.QUERIES[name](spark, SF)) if x.nodeName() == "Window")
    assert most >= sum(os.path.getsize(p.removeprefix("file://")) for p in lines.inputFiles()) // 10_000


def test_missing_and_repeated_parts(spark, tmp_path):
    c = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        cols = c.sql(f"SELECT * FROM '{SF}/{t}.parquet' LIMIT 0").columns
        what = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "part":
            what = f"SELECT * FROM ({what}) WHERE p_partkey % 10 <> 3 UNION ALL SELECT * FROM ({what}) WHERE p_partkey % 10 = 4"
        if t == "lineitem":
            what = f"SELECT {', '.join('CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_partkey END AS l_partkey' if x == 'l_partkey' else x for x in cols)} FROM ({what})"
        c.sql(f"COPY ({what}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert not views.one_part_each(views.table(spark, str(tmp_path), "lineitem"), views.table(spark, str(tmp_path), "part"))
    for name in ("per_paper_rate", "label_preservation"):
        df = workload.QUERIES[name](spark, str(tmp_path))
        want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({workload.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)
