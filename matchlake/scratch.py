"""Tables that cut the lineage of iterated jobs, in the folder that executors and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; in local mode below the warehouse where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/matchlake-{sc.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialized tables that nothing will read again; other tables stay."""
    for df in tables:
        if path := _PATHS.pop(id(df), (None, None))[1]:
            delete(df.sparkSession, path)


def materialize(df: DataFrame, name: str, observed: Observation | None = None, *aggs) -> DataFrame:
    """Written and read again; aggs are observed on the way, which saves a job."""
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.observe(observed, *aggs) if observed else df).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[id(out)] = (out, path)  # the table itself is kept, so that its id is not given away
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}
