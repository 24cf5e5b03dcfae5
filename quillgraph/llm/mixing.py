"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, cut, partitions, read

#: Weights of the sources in code point order, repeating; share of all sizes that the mix takes; most copies of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Sources in code point order, null last, get the repeating weights. target is the least of cap * source_size and
    weight * level, where the level makes the targets add up to share times all sizes: that is what resharing the
    excess by weight until no target is above its cap ends with. The windows below hold one row per source.
    """
    everything, by_level = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("q_level", F.col("source").asc_nulls_last())
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    at = sizes.select("source", "source_size", w.alias("q_w")).withColumn("q_cap", cap * F.col("source_size")).withColumn("q_level", F.col("q_cap") / F.col("q_w"))
    at = at.withColumn("q_all", F.lit(float(share)) * F.sum("source_size").over(everything))
    # level if all sources before this one in the order of q_level are at their caps
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("q_all") - F.coalesce(F.sum("q_cap").over(before), F.lit(0))
    weight = F.sum("q_w").over(everything) - F.coalesce(F.sum("q_w").over(before), F.lit(0))
    at = at.withColumn("q_try", left / weight)
    level = F.min(F.when(F.col("q_try") <= F.col("q_level"), F.struct("q_level", "q_try"))).over(everything)["q_try"]
    # no level fits only if share >= cap: then every source is at its cap
    return at.withColumn("q_at", level).select("source", "source_size", F.least(F.col("q_cap").cast("double"), F.coalesce(F.col("q_w") * F.col("q_at"), F.col("q_cap").cast("double"))).alias("target"))


def ranked(rows: DataFrame, group: str, order: list[Column], names: list[str]) -> DataFrame:
    """rows with q_rank: 1, 2, ... within `group` in the given order, by a distributed prefix sum.

    Rows are range-partitioned by group and order, so a group of any size spreads over the partitions; ranks within
    a partition are shifted by the number of the group's rows in the partitions before (one row for each partition
    and group). The ranged rows are written to the shared folder: both uses see the same partitions.
    """
    n = partitions(rows.sparkSession)
    ranged = rows.select(*names).repartitionByRange(n, F.col(group), *order).withColumn("q_part", F.spark_partition_id())
    ranged = cut(ranged.withColumn("q_local", F.row_number().over(Window.partitionBy("q_part", group).orderBy(*order))))
    counts = ranged.groupBy("q_part", group).agg(F.count(F.lit(1)).alias("q_n"))
    shift = counts.select(F.col("q_part").alias("q_p"), F.col(group).alias("q_g"), F.coalesce(F.sum("q_n").over(Window.partitionBy(group).orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("q_shift"))
    return ranged.join(shift, (F.col("q_part") == F.col("q_p")) & F.col(group).eqNullSafe(F.col("q_g"))).withColumn("q_rank", F.col("q_shift") + F.col("q_local")).drop("q_part", "q_local", "q_p", "q_g", "q_shift")


def offset(source: Column, seed: str) -> Column:
    """The one offset of a source, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (and the columns `keep`) for each row of docs.

    Within a source the documents stand by falling size, then doc_id, then a hash of the text; each has target/source_size expected copies,
    and gets as many as there are integers between the prefix sums before and after it, both moved by the source's
    offset. Neighbours are alike in size, so the words taken miss the target by about one document's size.
    Null text has size 0; a source of size 0 has target 0 and no copies; a null source is a source of its own;
    repeated rows count each by itself; an empty table gives an empty one; columns beside doc_id, text, source and
    `keep` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"), F.col("source").alias("source"), F.xxhash64("text").alias("q_tie"), *(F.col(c) for c in keep))
    at = ranked(rows, "source", [F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("q_tie")], ["doc_id", "size", "source", "q_tie", *keep])
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(total, weights, share, cap).withColumnRenamed("source", "q_s")
    at = at.join(goal, F.col("source").eqNullSafe(F.col("q_s"))).drop("q_s")
    rate, move = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), offset(F.col("source"), seed)
    crossed = F.floor(rate * F.col("q_rank") + move) - F.floor(rate * (F.col("q_rank") - 1) + move)
    return at.withColumn("copies", F.least(crossed, F.lit(cap)).cast("long")).select("doc_id", "size", "source", "source_size", "target", "copies", *keep)


def _names(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, of different seeds. Maps, which Spark doesn't hash, count as JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(*cols).alias("q_h"), F.xxhash64(F.lit("second"), *cols).alias("q_h2")]


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as plan() says, with the columns of docs, whatever their names.

    The plan works on ids, sizes and hashes of 128 bits that stand for a row; the texts are shuffled once, to meet
    their number of copies. Repeated rows are planned each by itself and come out as often as all of them together;
    nulls and empty tables are as in plan().
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"), *_names(docs))
    named = docs.select(*(F.col(c) for c in ("doc_id", "text", "source")), *_names(docs))
    copies = plan(named, keep=["q_h", "q_h2"], **options)
    copies = copies.where("copies > 0").groupBy("q_h", "q_h2").agg(F.sum("copies").alias("q_copies"))
    # equal rows are one row with the sum of their copies, counted before the shuffle
    once = whole.groupBy("q_h", "q_h2").agg(F.first("q_row").alias("q_row"))
    return once.join(copies, ["q_h", "q_h2"]).select("q_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("q_copies"))).alias("q_copy")).select("q_row.*")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, without its texts: see plan()."""
    return plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), l AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS level, {SHARE} * (sum(source_size) OVER ())::DOUBLE AS total FROM w
), t AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS try
  FROM l WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(w * (SELECT try FROM t WHERE try <= level ORDER BY level, try LIMIT 1), cap::DOUBLE)) AS target FROM t
), r AS (
  SELECT d.doc_id, d.size, d.source, g.source_size, g.target, coalesce(g.target / nullif(g.source_size, 0), 0) AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) AS n,
    ('0x' || substr(md5('{SEED}' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS move
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(floor(rate * n + move) - floor(rate * (n - 1) + move), {CAP}) * size)::BIGINT AS taken FROM r
"""
