"""Intent, attribute gaps and social proximity over citation slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import INTENTS, TOP_SECTIONS, section_name

#: Attribute, condition that its rows meet.
ATTRIBUTES = {"recency": "recency between 0 and 30", "citations": "citations > 0", "teamsize": "teamsize > 0"}


def intent_order(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(INTENTS) for x in (k, i))), c)


def half_width(sd: Column, n: Column) -> Column:
    """Half of the 95 % confidence interval; null for fewer than two values."""
    return F.when(n >= 2, 1.96 * sd / F.sqrt(n.cast("double")))


def slot_intent(original: str, filled: str, is_original: str) -> Column:
    """Human rows count with the label of the original sentence, others with that of the filled one."""
    return F.when(F.col(is_original), F.col(original)).otherwise(F.col(filled))


# --- labels ----------------------------------------------------------------------------------------------------------


def label_preservation(slots: DataFrame) -> DataFrame:
    """By source and original intent: slots with two valid labels, equal ones, and the percentage."""
    ok = slots.where(F.col("intent_original").isin(*INTENTS) & F.col("intent_filled").isin(*INTENTS))
    at = ok.groupBy("source", "intent_original").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("intent_original") == F.col("intent_filled")).alias("same"))
    return at.withColumn("pct", F.round(100.0 * F.col("same") / F.col("total"), 6))


def confusion(slots: DataFrame) -> DataFrame:
    """By source and original intent, the slots of each filled intent."""
    ok = slots.where(F.col("intent_original").isin(*INTENTS) & F.col("intent_filled").isin(*INTENTS))
    return ok.groupBy("source", "intent_original").agg(*(F.count_if(F.col("intent_filled") == i).alias(i) for i in INTENTS))


def per_paper_rate(slots: DataFrame) -> DataFrame:
    """By source and paper: percentage of each intent among valid slots, 0 included."""
    ok = slots.where(F.col("intent").isin(*INTENTS))
    at = ok.groupBy("source", "paper").agg(*(F.avg(F.when(F.col("intent") == i, 100.0).otherwise(0.0)).alias(i) for i in INTENTS))
    return at.unpivot(["source", "paper"], list(INTENTS), "intent", "pct")


def mean_and_ci(rows: DataFrame, value: str, *by: str) -> DataFrame:
    at = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("q_sd"), F.count(value).alias("n"))
    return at.withColumn("ci", half_width(F.col("q_sd"), F.col("n"))).drop("q_sd")


def with_human_level(at: DataFrame, human: str) -> DataFrame:
    """Bars with the human level of their intent beside them."""
    h = at.where(F.col("source") == human).select("intent", F.col("mean").alias("human_mean"))
    return at.join(h, "intent", "left")


def section_rates(slots: DataFrame) -> DataFrame:
    """By source, canonical section and intent: slots, and the percentage of the intent, 0 where a section is empty."""
    ok = slots.where(F.col("intent").isin(*INTENTS)).withColumn("section", section_name(F.col("section")))
    counts = ok.where(F.col("section").isin(*TOP_SECTIONS)).groupBy("source", "section").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("intent") == i).alias(f"q_{i}") for i in INTENTS))
    grid = slots.select("source").distinct().withColumn("section", F.explode(F.array(*(F.lit(s) for s in TOP_SECTIONS))))
    at = grid.join(counts, ["source", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    x = F.explode(F.array(*(F.struct(F.lit(i).alias("intent"), F.coalesce(F.col(f"q_{i}"), F.lit(0)).alias("k")) for i in INTENTS))).alias("x")
    return at.select("source", "section", "n", x).select("source", "section", "x.intent", "n", F.coalesce(F.try_divide(100.0 * F.col("x.k"), F.col("n")), F.lit(0.0)).alias("pct"))


def section_curves(rates: DataFrame) -> DataFrame:
    """Rates over their mean across sections; null where that is 0."""
    mean = F.avg("pct").over(Window.partitionBy("source", "intent"))
    return rates.withColumn("norm", F.try_divide(F.col("pct"), mean))


# --- attributes ------------------------------------------------------------------------------------------------------


def attributes_long(slots: DataFrame) -> DataFrame:
    """Matched slots with a valid intent, one row for each attribute whose value counts."""
    ok = slots.where(F.col("cited_id").isNotNull() & F.col("intent").isin(*INTENTS))
    one = [F.when(F.expr(cond), F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("value"))) for a, cond in ATTRIBUTES.items()]
    return ok.select("source", "paper", "intent", F.explode(F.array_compact(F.array(*one))).alias("x")).select("source", "paper", "intent", "x.*")


def attribute_means(long: DataFrame) -> DataFrame:
    return mean_and_ci(long, "value", "source", "intent", "attr")


def ratio_of_means(means: DataFrame, human: str, attr: str = "teamsize") -> DataFrame:
    """Each source's mean over the human one's by intent, with the interval that both intervals give."""
    at = means.where(F.col("attr") == attr)
    h = at.where(F.col("source") == human).select("intent", F.col("mean").alias("q_m"), F.col("ci").alias("q_c"))
    both = at.where(F.col("source") != human).join(h, "intent")
    r = F.col("mean") / F.col("q_m")
    return both.select("source", "intent", r.alias("ratio"), (r * F.sqrt(F.pow(F.col("ci") / F.col("mean"), 2.0) + F.pow(F.col("q_c") / F.col("q_m"), 2.0))).alias("ci"), "n")


def paper_means(long: DataFrame) -> DataFrame:
    return long.groupBy("source", "paper", "intent", "attr").agg(F.avg("value").alias("value"))


def paired_gaps(means: DataFrame, human: str, attr: str, kind: str = "diff") -> DataFrame:
    """By paper and intent present on both sides: source minus human, or the difference of logarithms of positive values."""
    at = means.where(F.col("attr") == attr)
    h = at.where(F.col("source") == human).select("paper", "intent", F.col("value").alias("q_h"))
    both = at.where(F.col("source") != human).join(h, ["paper", "intent"])
    if kind == "diff":
        return both.select("source", "paper", "intent", (F.col("value") - F.col("q_h")).alias("gap"))
    return both.where("value > 0 and q_h > 0").select("source", "paper", "intent", (F.ln("value") - F.ln("q_h")).alias("gap"))


def gap_summary(gaps: DataFrame, kind: str = "diff") -> DataFrame:
    """Mean gap with its interval; of logarithms the geometric mean ratio with its bounds."""
    at = mean_and_ci(gaps, "gap", "source", "intent")
    lo, hi = F.col("mean") - F.col("ci"), F.col("mean") + F.col("ci")
    f = F.exp if kind == "log" else (lambda c: c)
    return at.select("source", "intent", f(F.col("mean")).alias("gap"), f(lo).alias("lo"), f(hi).alias("hi"), "n")


def extreme_intent(at: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """Each source's intent with the largest (or smallest) value; of equal ones the first intent."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    n = F.row_number().over(Window.partitionBy("source").orderBy(order, intent_order(F.col("intent"))))
    return at.withColumn("q_n", n).where("q_n = 1").drop("q_n")


def extreme_against_rest(gaps: DataFrame, extreme: DataFrame, reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Gaps of each source's extreme intent, and those of its other intents pooled (or of `reference` alone)."""
    e = extreme.select("source", F.col("intent").alias("q_e"))
    at = gaps.join(e, "source")
    rest = at.where("intent != q_e") if reference is None else at.where((F.col("intent") == reference) & (F.col("q_e") != reference))
    return at.where("intent = q_e").drop("q_e"), rest.drop("q_e")


# --- distances -------------------------------------------------------------------------------------------------------

ROLES = ("first_first", "first_last", "last_first", "last_last")


def pooled_distances(rows: DataFrame, keys: list[str], columns: dict[str, str], intent: str = "intent") -> DataFrame:
    """Long form of the four distance columns (role to column); nulls go, -1 stays; a missing intent is <missing>."""
    x = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("d")) for r, c in columns.items()))).alias("x")
    return rows.select(*keys, F.coalesce(F.col(intent), F.lit("<missing>")).alias("intent"), x).select(*keys, "intent", "x.*").where("d is not null")


def near_rate(pooled: DataFrame, most: int = 1) -> DataFrame:
    """By source, intent and paper: percentage of pairs within `most` hops; pairs without a path count below the line."""
    ok = pooled.where(F.col("intent").isin(*INTENTS))
    return ok.groupBy("source", "intent", "paper").agg(F.avg(F.when(F.col("d").between(0, most), 100.0).otherwise(0.0)).alias("pct"), F.count(F.lit(1)).alias("n"))


def mean_distances(pooled: DataFrame, mode: str = "mean_of_4", level: str = "per_context", intents: bool = True) -> DataFrame:
    """Mean hops of pairs with a path, by source and intent, one row for each context or citation.

    mode: ff_only takes the first authors' pair, mean_of_4 each citation's mean over its pairs, all_pooled every pair.
    """
    at = pooled.where("d >= 0")
    if intents:
        at = at.where(F.col("intent").isin(*INTENTS))
    if mode == "ff_only":
        at = at.where(F.col("role") == "first_first")
    by = ["source", "intent", "paper", "context"]
    one = at.select(*by, "position", F.col("d").cast("double").alias("value"))
    if mode != "all_pooled":
        one = one.groupBy(*by, "position").agg(F.avg("value").alias("value"))
    if level == "per_context":
        return one.groupBy(*by).agg(F.avg("value").alias("value"))
    return one.select(*by, *([] if mode == "all_pooled" else ["position"]), "value")


def pooled_mean_distance(pooled: DataFrame) -> DataFrame:
    """By source and context: mean over citations of their mean hops, whatever the intent."""
    by = ["source", "paper", "context"]
    return pooled.where("d >= 0").groupBy(*by, "position").agg(F.avg("d").alias("value")).groupBy(*by).agg(F.avg("value").alias("value"))


def medians(values: DataFrame) -> DataFrame:
    return values.groupBy("source").agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def density(values: DataFrame, points: int = 400, factor: float = 0.35, least: int = 5) -> DataFrame:
    """Gaussian kernel density of each source's values on one grid, from the 0.5th to the 99.5th percentile of all.

    The kernel's width is factor times the source's sample deviation. Values are counted first, so the work is points
    times distinct values. Sources with fewer than `least` values are left out.
    """
    ends = values.agg(F.percentile("value", [0.005, 0.995]).alias("e"))
    step = F.expr(f"explode(sequence(0, {points - 1}))").alias("i")
    grid = ends.select("e", step).select("i", (F.col("e")[0] + F.col("i") * (F.col("e")[1] - F.col("e")[0]) / (points - 1)).alias("x"))
    width = values.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (factor * F.stddev_samp("value")).alias("h")).where((F.col("n") >= least) & (F.col("h") > 0))
    counted = values.groupBy("source", "value").agg(F.count(F.lit(1)).alias("w")).join(width, "source")
    # `points` rows, however many values there are
    at = counted.join(F.broadcast(grid))
    z = (F.col("x") - F.col("value")) / F.col("h")
    return at.groupBy("source", "i", "x").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))
