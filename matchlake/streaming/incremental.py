"""Incremental operators on Structured Streaming, and their batch equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchlake.operators.dedupe import versioned_merge


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New files once each: the checkpoint holds what was seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(path)


def upsert_sink(target: str, key: list[str], version: str, ordinal: str) -> Callable[[DataFrame, int], None]:
    """Merges each micro-batch by version. Snapshots are numbered by batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = f"{target}/batch={number}"
        stored = spark.read.schema(batch.schema).parquet(f"{target}/batch={number - 1}") if number else batch.limit(0)
        fresh = versioned_merge(batch.limit(0), batch, key, version, ordinal)
        versioned_merge(stored, fresh, key, version, ordinal).write.mode("overwrite").parquet(out)

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def gap_sessions(df: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions by gap between starts (the streaming form of sessions; batch and stream agree)."""
    timed = df.withWatermark(ts, late) if late else df
    got = timed.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("games"))
    return got.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "games")


def refresh_dirty(rollup: DataFrame, base: DataFrame, dirty: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recomputes the rollup for dirty keys only; the rest stays."""
    return rollup.join(dirty, key, "left_anti").unionByName(build(base.join(dirty, key, "left_semi")))
