"""New files as a stream: each record is worked on once, whatever was there before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def incremental(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs over what is new under `source` and stops.

    Each micro-batch drops records whose key the target has already, does `work` on the rest and appends the result.
    A batch that failed half-way is run again by the checkpoint and finds its finished records in the target.
    """

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(key)
        try:
            fresh = fresh.join(spark.read.parquet(target).select(*key).distinct(), key, "left_anti")
        except AnalysisException as e:
            # the target isn't there before the first batch
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        work(fresh).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
