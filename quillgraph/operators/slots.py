"""Citation slots: raw contexts merged by what they say, and labels joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import INTENTS

SIGNATURE = ("section", "citation_sentence", "before_citation", "after_citation", "masked_paragraph")


def ordered_distinct(a: Column) -> Column:
    return F.filter(a, lambda x, i: F.array_position(a, x) == i + 1)


def merged(raw: DataFrame, paper: str = "paper", index: str = "raw_index", most: int | None = None, signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """One row per slot: raw contexts of a paper with equal signatures, in the order first seen.

    Keys keep their first places, a bibliography key keeps its first record, and a slot asks for as many citations as
    it has keys, one at least. `most` keeps the first slots of a paper.
    """
    sig = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in signature]
    fields = [c for c in ("cite_command", "cite_keys", "bib_entries") if c in raw.columns]
    one = raw.select(paper, F.col(index).alias("q_i"), *sig, *fields)
    rows = F.array_sort(F.collect_list(F.struct("q_i", *(c for c in fields if c != "bib_entries"))))
    made = [F.min("q_i").alias("q_first"), rows.alias("q_rows")]
    if "bib_entries" in fields:
        entries = F.collect_list(F.struct("q_i", F.map_entries(F.coalesce("bib_entries", F.create_map().cast(dict(raw.dtypes)["bib_entries"]))).alias("e")))
        made.append(entries.alias("q_bib"))
    at = one.groupBy(paper, *signature).agg(*made)
    place = F.row_number().over(Window.partitionBy(paper).orderBy("q_first")) - 1
    at = at.withColumn("context_index", place).withColumn("source_context_indices", F.transform("q_rows", lambda r: r["q_i"]))
    if "cite_command" in fields:
        at = at.withColumn("cite_commands", F.transform("q_rows", lambda r: r["cite_command"]))
    if "cite_keys" in fields:
        keys = F.flatten(F.transform("q_rows", lambda r: F.coalesce(r["cite_keys"], F.array().cast("array<string>"))))
        at = at.withColumn("cite_keys", ordered_distinct(keys)).withColumn("num_citations_required", F.greatest(F.lit(1), F.size("cite_keys")))
    if "bib_entries" in fields:
        # sorted by (raw index), so the first record of a key is the one that counts
        pairs = F.flatten(F.transform(F.sort_array(F.transform("q_bib", lambda b: F.struct(b["q_i"].alias("i"), F.transform(b["e"], lambda e: e["key"]).alias("k")))), lambda b: F.transform(b["k"], lambda k: F.struct(k.alias("key"), b["i"].alias("i")))))
        keys = F.transform(pairs, lambda p: p["key"])
        first = F.filter(pairs, lambda p, n: F.array_position(keys, p["key"]) == n + 1)
        value = lambda p: F.try_element_at(F.map_from_entries(F.try_element_at(F.filter(F.col("q_bib"), lambda b: b["q_i"] == p["i"]), F.lit(1))["e"]), p["key"])
        at = at.withColumn("bib_entries", F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], value(p)))))
    out = at.drop("q_first", "q_rows", "q_bib")
    return out.where(F.col("context_index") < most) if most is not None else out


def with_original_labels(filled: DataFrame, labelled: DataFrame, paper: str = "paper") -> DataFrame:
    """Filled slots with the label that their original sentence got; the last label of equal (section, sentence) counts.

    Without one, original_intent is null and original_error is missing_phase_a.
    """
    last = labelled.groupBy(paper, "section", "citation_sentence").agg(F.max_by("intent", "context_index").alias("original_intent"))
    at = filled.join(last.withColumn("q_found", F.lit(True)), [paper, "section", "citation_sentence"], "left")
    return at.withColumn("original_error", F.when(F.col("q_found").isNull(), "missing_phase_a")).drop("q_found")


def reused_labels(slots: DataFrame, done: DataFrame, paper: str = "paper") -> DataFrame:
    """Slots with the labels they have already, and whether they are still to be labelled."""
    at = slots.join(done.select(paper, "context_index", F.col("intent").alias("q_intent"), F.col("error").alias("q_error")), [paper, "context_index"], "left")
    ok = F.col("q_intent").isNotNull() & F.col("q_error").isNull()
    return at.withColumn("intent", F.when(ok, F.col("q_intent"))).withColumn("to_do", ~F.coalesce(ok, F.lit(False))).drop("q_intent", "q_error")


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Contexts, errors and those with a valid label."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("intent").isin(*INTENTS)).alias("labelled"))


def error_report(results: DataFrame, paper: str = "paper", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Errors by type, and the papers with most of them."""
    bad = results.where(F.col("error").isNotNull())
    by_type = bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(paper).alias("papers"))
    return by_type, bad.groupBy(paper).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), paper).limit(top)
