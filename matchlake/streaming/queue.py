"""A queue of dirty keys as a stream: changes mark keys, a batch rewrites the buckets of marked keys alone.

The target is a table in buckets of its key.  A pointer file per bucket names its current version; a batch writes new versions
of the touched buckets, then moves their pointers, so disk and work grow with the changes and not with the batches.  A batch that
is run again writes the same versions, and one without changes writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.sources.shards import _fs, exists


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, target: str) -> dict[int, str]:
    """The version of each bucket that has one: files named bucket@version."""
    fs, at = _fs(spark, f"{target}/pointers")
    if not fs.exists(at):
        return {}
    out: dict[int, tuple[int, str]] = {}
    for f in fs.listStatus(at):
        bucket, _, version = f.getPath().getName().partition("@")
        if version:
            out[int(bucket)] = max(out.get(int(bucket), (-1, "")), (int(version), version))
    return {b: v for b, (_, v) in out.items()}


def read_table(spark: SparkSession, target: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The current rows, of some buckets or all."""
    paths = [f"{target}/data/{b}@{v}" for b, v in _versions(spark, target).items() if buckets is None or b in buckets]
    paths = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def dirty_sink(base: Callable[[], DataFrame], rebuild: Callable[[DataFrame], DataFrame], target: str, key: str, schema, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of changed keys: rebuilds the rows of those keys from the base table.

    rebuild gives the rows of the keys in the base rows it is given; a key without any goes.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(key).where(F.col(key).isNotNull()).distinct().persist()
        try:
            touched = sorted(r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())  # buckets at most
            if not touched:
                return
            kept = read_table(spark, target, schema, touched).join(keys, key, "left_anti")
            fresh = rebuild(base().join(keys, key, "left_semi"))
            rows = kept.unionByName(fresh.select(*kept.columns)).withColumn("_bucket", bucket_of(F.col(key), buckets))
            staged = f"{target}/staged/{number}"
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(staged)
            fs, _ = _fs(spark, target)
            path = spark._jvm.org.apache.hadoop.fs.Path
            for folder in ("data", "pointers"):
                fs.mkdirs(path(f"{target}/{folder}"))
            old = _versions(spark, target)
            for b in touched:
                at = path(f"{target}/data/{b}@{number}")
                fs.delete(at, True)
                if fs.exists(path(f"{staged}/_bucket={b}")):  # else the bucket is empty now
                    fs.rename(path(f"{staged}/_bucket={b}"), at)
                fs.create(path(f"{target}/pointers/{b}@{number}"), True).close()
                if b in old and old[b] != str(number):
                    fs.delete(path(f"{target}/pointers/{b}@{old[b]}"), False)
                    fs.delete(path(f"{target}/data/{b}@{old[b]}"), True)
            fs.delete(path(f"{target}/staged"), True)
        finally:
            keys.unpersist()

    return write
