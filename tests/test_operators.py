import json
import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import tails
from quillgraph.operators import adapter, analytics, dyads, graph, match, slots, statistics
from quillgraph.sources import io, schemas

BIB = schemas.BIB


def test_slots_merge_in_order(spark):
    e = lambda t: {k: t if k == "title" else None for k in ("title", "author", "authors", "year", "date", "doi", "venue", "journal", "booktitle", "publisher")}
    rows = [("p", 0, "s", "A", ["k1", "k2"], {"k1": e("one")}, "c1"), ("p", 1, "s", "B", [], {}, "c2"), ("p", 2, "s", "A", ["k2", "k3"], {"k1": e("other"), "k3": e("three")}, "c3")]
    df = spark.createDataFrame(rows, f"paper string, raw_index int, section string, citation_sentence string, cite_keys array<string>, bib_entries {BIB}, cite_command string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("before_citation", "after_citation", "masked_paragraph")})
    got = {r.context_index: r for r in slots.merged(df).collect()}
    assert got[0].cite_keys == ["k1", "k2", "k3"] and got[0].source_context_indices == [0, 2] and got[0].cite_commands == ["c1", "c3"] and got[0].num_citations_required == 3
    assert {k: v.title for k, v in got[0].bib_entries.items()} == {"k1": "one", "k3": "three"}
    assert got[1].num_citations_required == 1 and got[1].bib_entries == {}
    assert slots.merged(df, most=1).count() == 1


def test_labels_join_and_resume(spark):
    filled = spark.createDataFrame([("p", "s", "x", 0), ("p", "s", "y", 1)], "paper string, section string, citation_sentence string, context_index int")
    done = spark.createDataFrame([("p", "s", "x", 0, "supporting"), ("p", "s", "x", 5, "mentioning")], "paper string, section string, citation_sentence string, context_index int, intent string")
    got = {r.context_index: r for r in slots.with_original_labels(filled, done).collect()}
    assert got[0].original_intent == "mentioning" and got[1].original_error == "missing_phase_a"
    res = spark.createDataFrame([("a", 0, "supporting", None), ("a", 1, None, None), ("b", 0, "supporting", None), ("c", None, None, None), ("d", 0, "supporting", "e")], "paper string, context_index int, intent string, error string")
    assert sorted(r.paper for r in io.finished(res, "paper", "intent", "error").collect()) == ["b", "c"]
    old = res.select("paper", "context_index", "intent", "error")
    assert {(r.paper, r.to_do) for r in slots.reused_labels(spark.createDataFrame([("a", 0), ("a", 1), ("z", 0)], "paper string, context_index int"), old).collect()} == {("a", False), ("a", True), ("z", True)}


def test_adapter_offline_is_repeatable_and_retries(spark):
    p = spark.createDataFrame([("q\nRequired citation count: 2", 400, 0, 2), ("q\nRequired citation count: 1", 400, 1, 1)], "prompt string, budget int, context_index int, num_citations_required int")
    got = adapter.generated(p).collect()
    assert all(r.error is None and r.result.citation_count == r.num_citations_required for r in got)

    def bad(system, prompt, budget):
        raise RuntimeError("down")

    quick = adapter.Policy(attempts=3, sleep=False)
    assert [r.attempts for r in adapter.ask(p, (bad, adapter.offline), "", quick).orderBy("context_index").collect()] == [2, 1]
    failed = adapter.generated(p, (bad,), policy=quick)
    assert {r.error for r in failed.collect()} == {"api_error"}
    assert adapter.judged(p).where("intent is null").isEmpty()
    assert adapter.repaired(failed.select("prompt", "budget", "context_index", "num_citations_required", "error"), lambda b: adapter.generated(b.drop("error"))).where("error is not null").isEmpty()


def test_matching_prefers_identifier_then_rank(spark):
    refs = spark.createDataFrame([(1, "10.1/a", "same title", 2020), (2, "", "same title", 2020), (3, "", "", None), (4, "10.9/none", "other", None)], "row_uid int, doi_key string, title_key string, year_hint bigint")
    pubs = spark.createDataFrame(
        [("p1", "10.1/A", "x", "preprint", 2020, 5), ("p2", "10.1/a", "x", "article", 1990, 0), ("p4", None, "The same title!", "article", 2021, 1), ("p3", None, "Same Title", "article", 2021, 1), (None, None, None, "article", 1, 1)],
        "id string, doi string, t string, type string, year int, citations_count bigint",
    )
    pubs = pubs.select("id", "doi", F.struct(F.col("t").alias("preferred")).alias("title"), F.struct(F.lit("v").alias("name")).alias("conference"), F.struct(F.lit("s").alias("title")).alias("source"), "type", "year", "citations_count", F.array(F.lit(1)).alias("authors"))
    keyed = match.publication_keys(pubs)
    found = match.matched(refs, keyed)
    assert {(r.row_uid, r.method, r.pub_id) for r in found.collect()} == {(1, "doi", "p2"), (2, "title", "p3")}
    at = {r.row_uid: r for r in match.with_match(refs, found).collect()}
    assert (at[1].doi_agrees, at[1].year_agrees, at[2].doi_agrees, at[2].year_agrees, at[4].doi_agrees) == (True, False, None, False, None)


def test_master_rows(spark):
    row = json.dumps({"source_model": "m", "arxiv_id": "x", "context_index": 0, "cite_keys": ["k", "gone"], "bib_entries": {"k": {"title": "T", "date": "2020-01", "journal": "", "booktitle": "B", "doi": "DOI:1"}}, "recommended_papers": [{"title": "R", "year": "2019"}]})
    df = spark.createDataFrame([(row,)], "j string").select(F.from_json("j", schemas.JUDGED).alias("r")).select("r.*")
    got = {(r.kind, r.position): r for r in match.master_rows(df).collect()}
    assert got["original", 0].venue == "B" and got["original", 0].year == "2020" and got["original", 0].doi_key == "1" and got["original", 1].title == "" and got["recommended", 0].year_hint == 2019


EDGES = [("A", "B", 1), ("B", "C", 1), ("C", "D", 1), ("E", "F", 1), ("F", "G", 1), ("E", "G", 1)]


@pytest.mark.parametrize("how", ["joins", "memory"])
def test_distances(spark, how):
    edges = spark.createDataFrame(EDGES, schemas.EDGE)
    pairs = spark.createDataFrame([("A", "D"), ("A", "E"), ("A", "A"), ("A", "Z"), ("Z", "Z"), ("D", "A"), ("E", "G")], "source string, target string")
    if how == "joins":
        got = graph.distances(pairs, graph.hops_by_joins(edges, pairs.select(F.col("source").alias("id"))), graph.nodes(edges))
    else:
        got = graph.hops_in_memory(edges, pairs)
    assert {(r.source, r.target): r.d for r in got.collect()} == {("A", "D"): 3, ("A", "E"): -1, ("A", "A"): 0, ("A", "Z"): None, ("Z", "Z"): None, ("D", "A"): 3, ("E", "G"): 1}


def test_coauthor_edges(spark):
    rows = [(1, 2015, ["a", "b", "b", "", None]), (2, 2024, ["b", "c", "d"]), (3, 2025, ["a", "c"]), (4, 2014, ["a", "c"]), (5, 2020, ["a"]), (6, 2020, [f"x{i}" for i in range(25)] + ["a"]), (7, 2020, ["c", "d"])]
    pubs = spark.createDataFrame(rows, "id int, year int, researchers array<string>")
    seed = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {(r.src, r.dst): r.weight for r in graph.coauthor_edges(pubs, seed, (2015, 2025)).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("b", "d"): 1, ("c", "d"): 1}
    every = {(r.src, r.dst): r.weight for r in graph.coauthor_edges(pubs, None, (2015, 2025)).collect()}
    assert every["c", "d"] == 2
    m = graph.membership(spark.createDataFrame(EDGES, schemas.EDGE), spark.createDataFrame([("A",), ("B",)], "id string")).first()
    assert (m.both, m.one, m.neither, m.disordered) == (1, 1, 4, 0)


def test_careers(spark):
    rows = [("p1", 2000, ["r", "r"], [2001, 2025], ["", "x"]), ("p2", 2001, ["r"], [2024], ["DE"]), ("p3", 2030, ["r"], [], ["FR"])]
    pubs = spark.createDataFrame(rows, "id string, year int, researcher_ids array<string>, c array<int>, research_org_countries array<string>").withColumn("citations", F.transform("c", lambda y: F.struct(y.alias("year"))))
    people = spark.createDataFrame([("r",), ("q",)], "id string")
    got = {r.id: r for r in dyads.researcher_table(pubs, people, people, 2025).collect()}
    assert (got["r"].n_pubs, got["r"].citations_before, got["r"].first_country, got["r"].career_age) == (2, 2, "DE", 25) and got["q"].n_pubs is None


def test_attribute_limits(spark):
    rows = [("h", "p", "supporting", -1, 0, 0, 1), ("h", "p", "supporting", 30, 5, 3, 1), ("h", "p", "supporting", 31, 5, 3, None), ("h", "p", "odd", 3, 5, 3, 1), ("h", "p", "supporting", None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "source string, paper string, intent string, recency int, citations int, teamsize int, cited_id int")
    got = sorted((r.attr, r.value) for r in analytics.attributes_long(df).collect())
    assert got == [("citations", 1.0), ("citations", 5.0), ("recency", 30.0), ("teamsize", 1.0), ("teamsize", 3.0)]


def test_intervals_of_few(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {r.g: r.ci for r in analytics.mean_and_ci(df, "v", "g").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.96 * math.sqrt(2) / math.sqrt(2))


def test_tails():
    # values of printed tables
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.256, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert math.isnan(tails.normal_two_sided(float("nan")))


def test_welch_needs_five(spark):
    a = statistics.moments(spark.createDataFrame([("x", float(v)) for v in range(5)], "g string, v double"), "v", "g")
    b = statistics.moments(spark.createDataFrame([("x", float(v)) for v in (9, 8, 7, 9)], "g string, v double"), "v", "g")
    assert statistics.welch(a, b, ["g"]).first().p is None
    c = statistics.moments(spark.createDataFrame([("x", float(v)) for v in (9, 8, 7, 9, 8)], "g string, v double"), "v", "g")
    r = statistics.welch(a, c, ["g"]).first()
    assert r.t == pytest.approx(-7.75) and r.p < 0.001


def test_sources(spark, tmp_path):
    p = tmp_path / "a1"
    p.mkdir()
    (p / "metadata.json").write_text(json.dumps({"arxiv_id": "arXiv:1", "title": "T", "year": 2025, "first_arxiv_date": "2025-01-01"}))
    (p / "contexts.json").write_text(json.dumps([{"citation_sentence": "x", "section": "s"}, {"citation_sentence": "y"}]))
    (p / "bib_entries.json").write_text(json.dumps({"k": {"title": "long enough"}}))
    q = tmp_path / "b2"
    q.mkdir()
    (q / "metadata.json").write_text(json.dumps({"arxiv_id": "2", "year": "2025", "first_arxiv_date": "2024-12-31"}))
    got = {r.folder: r for r in io.papers(spark, str(tmp_path)).collect()}
    assert got["a1"].has_bib and not got["b2"].has_bib
    assert [(r.folder, r.raw_index, r.citation_sentence) for r in io.contexts(spark, str(tmp_path)).orderBy("raw_index").collect()] == [("a1", 0, "x"), ("a1", 1, "y")]
    assert [r.folder for r in io.in_scope(io.papers(spark, str(tmp_path)), io.Config()).collect()] == ["a1"]
    (tmp_path / "d.csv").write_text("arxiv_id,preprint_date\narXiv:1,2024-01-01\n1,2024-02-02\n")
    assert [tuple(r) for r in io.preprint_dates(spark, str(tmp_path / "d.csv")).collect()] == [("1", "2024-02-02")]
    assert io.preprint_dates(spark, str(tmp_path / "none.csv")).count() == 0
    made = []
    for _ in range(2):
        io.reuse(spark, str(tmp_path / "t"), lambda: made.append(1) or spark.range(3))
    assert made == [1]
    io.write(spark.createDataFrame([(1, "a"), (2, "b")], "x int, m string"), str(tmp_path / "w"), ("m",))
    io.write(spark.createDataFrame([(3, "b")], "x int, m string"), str(tmp_path / "w"), ("m",))
    assert sorted((r.x, r.m) for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [(1, "a"), (3, "b")]


def test_focal_cross_fill(spark):
    a = spark.createDataFrame([("1", "", "p", "c", "f", "l", "3.0", "2025")], "paper string, venue_id string, preprint_id string, conference_name string, first_author_first string, first_author_last string, citations_count string, year string")
    b = spark.createDataFrame([("1", "v", "q", "", "", "", "", ""), ("2", "w", "", "", "", "", "", "")], a.schema)
    got = {r.paper: r for r in io.cross_filled(a, b).collect()}
    assert (got["1"].venue_id, got["1"].preprint_id, got["1"].citations_count) == ("v", "p", 3) and (got["2"].venue_id, got["2"].year) == ("w", None)
