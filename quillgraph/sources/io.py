"""Readers and writers: papers as folders of JSON, lookup tables as CSV, everything between as Parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import DISPLAY_NAMES, bare_arxiv_id, blank_to_null, to_int
from quillgraph.sources import schemas


@dataclass(frozen=True)
class Config:
    """What a run works on; `quillgraph.*` settings of the session come before the defaults."""

    year: int = 2025
    cutoff: str = "2024-12-31"
    contexts_per_paper: int = 100
    graph_years: tuple[int, int] = (2015, 2025)
    team: tuple[int, int] = (2, 25)
    models: tuple[str, ...] = field(default_factory=tuple)
    judge: str = "judge"

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        def get(name: str, kind: Callable = str):
            v = spark.conf.get(f"quillgraph.{name}", None)
            return None if v in (None, "") else kind(v)

        given = {"year": get("year", int), "cutoff": get("cutoff"), "contexts_per_paper": get("contexts_per_paper", int), "judge": get("judge"), "models": get("models", lambda v: tuple(m.strip() for m in v.split(",") if m.strip()))}
        return cls(**{k: v for k, v in given.items() if v is not None})


def _folder() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")


def papers(spark: SparkSession, root: str) -> DataFrame:
    """One row for each */metadata.json under root, with paper_dir, folder and has_bib (bib_entries.json of over 10 bytes)."""
    at = spark.read.schema(schemas.METADATA).json(f"{root}/*/metadata.json", multiLine=True).withColumn("paper_dir", _folder()).withColumn("folder", F.regexp_extract("paper_dir", "[^/]*$", 0))
    bib = spark.read.format("binaryFile").load(f"{root}/*/").where(F.col("path").endswith("/bib_entries.json") & (F.col("length") > 10)).select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder")).distinct()
    return at.join(bib.withColumn("has_bib", F.lit(True)), "folder", "left").withColumn("has_bib", F.coalesce("has_bib", F.lit(False)))


def contexts(spark: SparkSession, root: str) -> DataFrame:
    """One row for each raw context: folder, raw_index and its fields. Papers without contexts have no rows."""
    at = spark.read.schema(schemas.CONTEXT).json(f"{root}/*/contexts.json", multiLine=True)
    at = at.withColumn("folder", F.regexp_extract(_folder(), "[^/]*$", 0)).withColumn("q_at", F.monotonically_increasing_id())
    # a file is read by one task, so ids rise in the order of its records
    w = F.row_number().over(_by("folder", "q_at")) - 1
    return at.withColumn("raw_index", w).drop("q_at")


def _by(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table by its header's names; an empty one where the file or one of its columns is missing."""
    wanted = spark.createDataFrame([], schema)
    try:
        got = spark.read.csv(path, header=True)
    except AnalysisException:
        return wanted
    if not set(wanted.columns) <= set(got.columns):
        return wanted
    return got.select(*(F.col(c).cast(t) for c, t in wanted.dtypes))


def last_per_key(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last in the order of the file, or of a column."""
    at = rows.withColumn("q_at", F.col(order) if order else F.monotonically_increasing_id())
    return at.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), "q_at").alias("q")).select(key, "q.*")


def first_per_key(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    at = rows.withColumn("q_at", F.col(order) if order else F.monotonically_increasing_id())
    return at.groupBy(key).agg(F.min_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), "q_at").alias("q")).select(key, "q.*")


def preprint_dates(spark: SparkSession, path: str) -> DataFrame:
    return last_per_key(csv(spark, path, schemas.PREPRINT_DATES).withColumn("arxiv_id", bare_arxiv_id(F.col("arxiv_id"))), "arxiv_id")


def arxiv_dates(spark: SparkSession, path: str) -> DataFrame:
    return last_per_key(csv(spark, path, schemas.ARXIV_DATES), "arxiv_id_clean")


def focal(spark: SparkSession, main: str, extra: str) -> DataFrame:
    """Focal papers of two tables by bare id: the first row of each, ids that the main one lacks filled from the other."""
    a, b = (first_per_key(csv(spark, p, schemas.FOCAL).withColumn("paper", bare_arxiv_id(F.col("arxiv_id"))).drop("arxiv_id"), "paper") for p in (main, extra))
    return cross_filled(a, b)


def cross_filled(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("paper", F.col("venue_id").alias("q_v"), F.col("preprint_id").alias("q_p"))
    both = a.join(b, "paper", "full_outer")
    fill = lambda c, o: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(o))).alias(c)
    rest = [blank_to_null(F.col(c)).alias(c) for c in ("conference_name", "first_author_first", "first_author_last")]
    return both.select("paper", fill("venue_id", "q_v"), fill("preprint_id", "q_p"), *rest, to_int(F.col("citations_count")).alias("citations_count"), to_int(F.col("year")).alias("year"))


def with_dates(metadata: DataFrame, preprint: DataFrame, arxiv: DataFrame) -> DataFrame:
    """Metadata whose missing dates come from the lookup tables."""
    at = metadata.withColumn("q_id", bare_arxiv_id(F.col("arxiv_id")))
    at = at.join(preprint.select(F.col("arxiv_id").alias("q_id"), F.col("preprint_date").alias("q_d")), "q_id", "left")
    at = at.join(arxiv.select(F.col("arxiv_id_clean").alias("q_id"), F.col("first_arxiv_date").alias("q_f"), F.col("latest_arxiv_date").alias("q_l")), "q_id", "left")
    for c, o in (("preprint_date", "q_d"), ("first_arxiv_date", "q_f"), ("latest_arxiv_date", "q_l")):
        at = at.withColumn(c, F.coalesce(blank_to_null(F.col(c)), F.col(o)))
    return at.drop("q_id", "q_d", "q_f", "q_l")


def in_scope(papers: DataFrame, config: Config, need_bib: bool = True) -> DataFrame:
    """Papers of the year whose first date is after the cutoff, with a bibliography if asked for."""
    ok = (to_int(F.col("year")) == config.year) & (F.col("first_arxiv_date").try_cast("date") > F.lit(config.cutoff).cast("date"))
    return papers.where(ok & F.col("has_bib") if need_bib else ok)


def finished(results: DataFrame, key: str, label: str, error: str) -> DataFrame:
    """Keys all of whose records have a label and no error; keys with a null record only count as finished."""
    ok = F.col(label).isNotNull() & F.col(error).isNull()
    return results.groupBy(key).agg(F.bool_and(ok | F.col("context_index").isNull()).alias("ok")).where("ok").select(key)


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet with zstd; with `by`, only the partitions that df has are replaced."""
    out = df.write.mode("overwrite").option("compression", "zstd")
    if by:
        out = out.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write(make(), path)
        return spark.read.parquet(path)


def labelled_sources(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Rows of all CSV files under root that end in suffix, with the label in their names and its place in the fixed order (others 99)."""
    at = spark.read.csv(f"{root}/*{suffix}", header=True).withColumn("label", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\Q" + suffix + "\\E$", 1))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(DISPLAY_NAMES) for x in (k, i)))
    return at.withColumn("label_order", F.coalesce(F.try_element_at(place, F.col("label")), F.lit(99)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def write_nested(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN becomes null, and nulls are written."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    clean.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
