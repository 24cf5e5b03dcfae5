"""References matched to publications: identifier first, title for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import agreement, doi_key, first_filled, original_year, title_key, to_int, type_rank


def master_rows(judged: DataFrame) -> DataFrame:
    """One row per citation: the original ones of each slot by key, the recommended ones by rank, with match keys."""
    base = judged.select("source_model", F.col("arxiv_id").alias("paper"), "context_index", "cite_keys", "bib_entries", "recommended_papers")
    e = F.try_element_at(F.col("bib_entries"), F.col("key"))
    orig = base.select("source_model", "paper", "context_index", F.posexplode("cite_keys").alias("position", "key"), "bib_entries").select(
        "source_model", "paper", "context_index", "position", F.lit("original").alias("kind"), F.col("key").alias("cite_key_or_rank"), F.coalesce(e["title"], F.lit("")).alias("title"),
        first_filled(e["author"], e["authors"]).alias("authors"), original_year(F.coalesce(e["year"], e["date"])).alias("year"), F.coalesce(e["doi"], F.lit("")).alias("doi"), first_filled(e["journal"], e["booktitle"], e["venue"], e["publisher"]).alias("venue"),
    )
    rec = base.select("source_model", "paper", "context_index", F.posexplode("recommended_papers").alias("position", "w")).select(
        "source_model", "paper", "context_index", "position", F.lit("recommended").alias("kind"), F.col("position").cast("string").alias("cite_key_or_rank"), F.coalesce("w.title", F.lit("")).alias("title"),
        F.coalesce("w.authors", F.lit("")).alias("authors"), original_year(F.col("w.year")).alias("year"), F.coalesce("w.doi", F.lit("")).alias("doi"), F.coalesce("w.venue", F.lit("")).alias("venue"),
    )
    both = orig.unionByName(rec)
    return both.withColumns({"doi_key": doi_key(F.col("doi")), "title_key": title_key(F.col("title")), "year_hint": to_int(F.col("year"))})


def publication_keys(pubs: DataFrame) -> DataFrame:
    """Publications with an identifier or a title, flat, with the same keys."""
    at = pubs.where(F.col("doi").isNotNull() | F.col("title.preferred").isNotNull())
    return at.select(
        F.col("id").alias("pub_id"), F.col("doi").alias("pub_doi"), F.lower("doi").alias("pub_doi_key"), F.col("title.preferred").alias("pub_title"), title_key(F.col("title.preferred")).alias("pub_title_key"),
        F.col("year").alias("pub_year"), F.coalesce("conference.name", "source.title").alias("pub_venue"), F.col("citations_count").alias("pub_citations"), F.size("authors").alias("pub_team"), F.lower("type").alias("pub_type"),
    )


def _order() -> list[Column]:
    """Kind of work, distance of years (a missing one is 9999), citations, then the id, so that no tie is left."""
    return [type_rank(F.col("pub_type")), F.abs(F.coalesce("pub_year", F.lit(9999)) - F.coalesce("year_hint", F.lit(9999))), F.coalesce("pub_citations", F.lit(0)).desc(), F.col("pub_id")]


def _candidates(pubs: DataFrame, key: str) -> DataFrame:
    """One row for each filled key (q_key): the publications that can be the best one of a reference with that key.

    They are of the key's first kind of work and the best of their year, so there are no more than years, however many
    publications share a key.
    """
    row = F.struct(*pubs.columns)
    year, order = F.coalesce("pub_year", F.lit(9999)), F.struct(type_rank(F.col("pub_type")).alias("kind"), (-F.coalesce("pub_citations", F.lit(0))).alias("cited"), F.col("pub_id"))
    at = pubs.where(F.col(key) != "").groupBy(F.col(key).alias("q_key"), year.alias("q_year")).agg(F.min(order).alias("q_order"), F.min_by(row, order).alias("q_row"))
    every = at.groupBy("q_key").agg(F.min("q_order.kind").alias("q_kind"), F.collect_list(F.struct("q_year", "q_order", "q_row")).alias("q_all"))
    return every.select("q_key", F.filter("q_all", lambda x: x["q_order"]["kind"] == F.col("q_kind")).alias("q_all"))


def hits(refs: DataFrame, pubs: DataFrame, ref_key: str, pub_key: str, method: str, uid: str = "row_uid") -> DataFrame:
    """The best publication of each reference whose key is filled and equal.

    References meet the few candidates of their key, not all publications that share it.
    """
    kept = [c for c in pubs.columns]
    # empty keys go before the join: they match nothing, and would gather in one task
    at = refs.where(F.col(ref_key) != "").select(uid, F.col(ref_key).alias("q_k"), "year_hint").join(_candidates(pubs, pub_key), F.col("q_k") == F.col("q_key"))
    away = F.transform("q_all", lambda x, i: F.struct(F.abs(x["q_year"] - F.coalesce("year_hint", F.lit(9999))).alias("away"), x["q_order"].alias("order"), i.alias("i")))
    at = at.select(uid, "year_hint", F.col("q_all")[F.array_min(away)["i"]]["q_row"].alias("q_row")).select(uid, "year_hint", "q_row.*")
    best = at.withColumn("q_n", F.row_number().over(Window.partitionBy(uid).orderBy(*_order()))).where("q_n = 1")
    return best.select(uid, F.lit(method).alias("method"), *kept)


def matched(refs: DataFrame, pubs: DataFrame, uid: str = "row_uid") -> DataFrame:
    """One row per matched reference: by identifier, or by title where that found none."""
    by_doi = hits(refs, pubs, "doi_key", "pub_doi_key", "doi", uid)
    rest = refs.join(by_doi.select(uid), uid, "left_anti")
    return by_doi.unionByName(hits(rest, pubs, "title_key", "pub_title_key", "title", uid))


def with_match(refs: DataFrame, found: DataFrame, uid: str = "row_uid") -> DataFrame:
    """References with what they matched, and whether given identifier and year agree with it (null: not given)."""
    at = refs.join(found, uid, "left")
    given_doi, hit = F.when(F.col("doi_key") != "", F.col("doi_key")), F.col("pub_id").isNotNull()
    return at.withColumn("doi_agrees", F.when(hit, agreement(given_doi, F.col("pub_doi_key")))).withColumn("year_agrees", F.when(hit, agreement(F.col("year_hint"), F.col("pub_year").cast("bigint"))))


def method_shares(at: DataFrame) -> DataFrame:
    """Rows by method (null: unmatched) and their percentage."""
    n = at.groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def match_rates(at: DataFrame, source: str = "source", kind: str = "kind") -> DataFrame:
    """Total, matched and rate by source and kind, by kind, and over all, in one pass (null: all)."""
    c = at.groupingSets([[source, kind], [kind], []], source, kind).agg(F.count(F.lit(1)).alias("total"), F.count("pub_id").alias("matched"))
    return c.withColumn("pct", F.round(100.0 * F.col("matched") / F.col("total"), 6))


def quality(at: DataFrame, *by: str) -> DataFrame:
    """Matched rows, those that give an identifier or a year, and how many of these agree."""
    m = F.col("pub_id").isNotNull()

    def share(a: str, b: str) -> Column:
        return F.round(F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0)), 6)

    c = at.groupBy(*by).agg(F.count_if(m).alias("matched"), F.count_if(m & (F.col("doi_key") != "")).alias("doi_provided"), F.count_if(m & F.col("doi_agrees")).alias("doi_agree"), F.count_if(m & F.col("year_hint").isNotNull()).alias("year_provided"), F.count_if(m & F.col("year_agrees")).alias("year_agree"))
    return c.withColumn("doi_agree_pct", share("doi_agree", "doi_provided")).withColumn("year_agree_pct", share("year_agree", "year_provided"))


def focal_matches(focal: DataFrame, pubs: DataFrame) -> DataFrame:
    """Focal papers with the publications of their venue id and of their preprint id."""
    ids = focal.select(F.col("venue_id").alias("pub_id")).union(focal.select("preprint_id")).where("pub_id is not null").distinct()
    kept = pubs.join(ids, "pub_id", "left_semi")

    def side(name: str) -> DataFrame:
        return kept.select(*(F.col(c).alias(f"{name}_{c}") for c in kept.columns))

    at = focal.join(side("venue"), F.col("venue_id") == F.col("venue_pub_id"), "left").join(side("preprint"), F.col("preprint_id") == F.col("preprint_pub_id"), "left")
    # a publication that was found counts 0 citations where it has none
    for s in ("venue", "preprint"):
        at = at.withColumn(f"{s}_citations", F.when(F.col(f"{s}_pub_title").isNotNull(), F.coalesce(f"{s}_pub_citations", F.lit(0))))
    return at


def nested(at: DataFrame, contexts: DataFrame | list[str], source: str = "source", paper: str = "paper") -> DataFrame:
    """One row per source and paper: contexts in order, each with its original and recommended items in order and counts.

    `contexts` has the other columns of contexts; or it names those of `at` that all rows of a context share, which
    spares a join. Contexts without any citation row are not in the result.
    """
    shared = contexts if isinstance(contexts, list) else []
    fields = [c for c in at.columns if c not in (source, paper, "context_index", "kind", *shared)]
    item = F.struct(F.col("position"), *(F.col(c) for c in fields if c != "position"))

    def items(kind: str) -> list[Column]:
        mine = F.col("kind") == kind
        return [F.array_sort(F.collect_list(F.when(mine, item))).alias(kind), F.count_if(mine).alias(f"n_{kind}"), F.count_if(mine & F.col("pub_id").isNotNull()).alias(f"n_{kind}_matched")]

    by_context = at.groupBy(source, paper, "context_index").agg(*items("original"), *items("recommended"), *(F.first(c).alias(c) for c in shared))
    if not isinstance(contexts, list):
        by_context = by_context.join(contexts, [source, paper, "context_index"], "left")
    inside = F.struct("context_index", *(c for c in by_context.columns if c not in (source, paper, "context_index")))
    out = by_context.groupBy(source, paper).agg(F.array_sort(F.collect_list(inside), lambda a, b: (a["context_index"] - b["context_index"]).cast("int")).alias("contexts"), *(F.sum(c).alias(c) for c in ("n_original", "n_original_matched", "n_recommended", "n_recommended_matched")))
    return out


def shared_contexts(at: DataFrame, n_sources: int, source: str = "source", paper: str = "paper") -> DataFrame:
    """Rows of the contexts in which each of n_sources has a matched citation."""
    found = F.collect_set(F.when(F.col("pub_id").isNotNull(), F.col(source))).over(Window.partitionBy(paper, "context_index"))
    known = at.where(F.col(paper).isNotNull() & F.col("context_index").isNotNull())
    return known.withColumn("q_n", F.size(found)).where(F.col("q_n") == n_sources).drop("q_n")
