"""What the operators of this package share: shared storage, hold-out rule, bounded samples."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or where that is unset a temporary one of this machine.

    The latter is for a local master alone; on a cluster the setting is needed.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder; later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that cut() made unreachable.

    It does so when the driver's garbage is collected, which else happens rarely; until then they fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as decimal text, modulo m."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


#: Rows and bytes of the batches that go to Python workers; by Spark's own setting a batch of long texts takes hundreds of megabytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size. The session keeps the setting, unless it has one of its own."""
    conf = df.sparkSession.conf
    own = df.sparkSession.sparkContext.getConf()
    for k, v in BATCH.items():
        if own.get(k) is None:
            conf.set(k, v)
    return df.mapInArrow(run, schema)


#: Rows of one key that may meet in one task, and the share of all rows that makes a key hot beyond that.
HOT_ROWS, HOT_SHARE = 1000, 1000


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table, which has one row for each key, and in q_n how many of rows it has there.

    Rows whose key table lacks go. A key with over HOT_ROWS of rows and over a HOT_SHARE-th of them is hot: there are
    fewer than HOT_SHARE such keys whatever the tables hold. Their values are broadcast, and their rows are dealt
    over all tasks instead of meeting in one.
    """
    values = [c for c in table.columns if c not in (key, "q_n")]
    found = table.where(F.col("q_n") > HOT_ROWS).select(F.col(key).alias("q_h"), F.struct(*values).alias("q_hv"), "q_n")
    # at most HOT_SHARE rows: those beyond would hold more than all rows
    total = found.agg(F.sum("q_n")).first()[0] or 0
    if not total:
        return rows.join(table.drop("q_n"), key)
    hot = F.broadcast(found.where(F.col("q_n") * HOT_SHARE > total).drop("q_n"))
    mine = rows.join(hot, F.col(key) == F.col("q_h"), "left").withColumn("q_k", F.when(F.col("q_h").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    other = table.select(F.col(key).alias("q_t"), F.struct(*values).alias("q_tv"))
    out = mine.join(other, F.col("q_k") == F.col("q_t"), "left").withColumn("q_v", F.coalesce("q_hv", "q_tv"))
    return out.where("q_v is not null").select(*rows.columns, *(F.col(f"q_v.{c}").alias(c) for c in values))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(*cols: Column) -> Column:
    """A uniform double in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, key: str, by: list[str], size: int) -> DataFrame:
    """About `size` rows for each value of `key`, chosen by a hash of the columns `by`; repeated rows come all or not at all.

    One pass counts the rows of each value; a row stays if its hash falls under size/count. At most a value of
    `key` and its count per group reach the driver, and about size rows of each group pass the filter.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    if not counts:
        return rows.limit(0)
    pairs = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, size / n)))]
    return rows.where(spread(*(F.col(c) for c in by)) < F.try_element_at(F.create_map(*pairs), F.col(key)))


def memo(f):
    """f with its last results kept. Unlike functools.cache it travels to executors with the function it wraps."""
    kept: dict = {}

    def g(*args):
        if args not in kept:
            if len(kept) >= 256:
                kept.clear()
            kept[args] = f(*args)
        return kept[args]

    return g
