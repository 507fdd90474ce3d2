"""Sources and sinks: columnar and line formats, shards with manifests, publication by staging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """parquet, orc, json (NDJSON), csv, text or binaryFile; a schema avoids an inference pass."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_shards(df: DataFrame, path: str, by: list[str], kind: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """One folder per shard key; a repartition by the key keeps files few, the row limit splits hot keys."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("maxRecordsPerFile", rows_per_file).format(kind).save(path)


def content_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """Row count and an order-free digest of whole rows (sums of two 60-bit parts of each row's SHA-256), as one row."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", part(1), part(16)), 256).alias("digest"))


def publish(df: DataFrame, target: str, checks: dict[str, str]) -> int:
    """Write a version of its own, assert the checks (name to SQL condition that no row may break), then point to it.

    The pointer is replaced in one rename, so readers see the old version or the new one whole, whenever a run dies.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{target}/{version}")
    staged = spark.read.parquet(f"{target}/{version}")
    row = staged.agg(F.count("*").alias("_n"), *(F.count(F.when(~F.coalesce(F.expr(c), F.lit(False)), 1)).alias(n) for n, c in checks.items())).first()
    fs_of, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = lambda name: fs_of.Path(f"{target}/{name}")
    fs = path(version).getFileSystem(conf)
    broken = {n: row[n] for n in checks if row[n]}
    if broken:
        fs.delete(path(version), True)
        raise ValueError(f"rows break {broken}")
    out = fs.create(path(f"{version}.pointer"), True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(fs_of, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    fs_of.FileContext.getFileContext(fs.makeQualified(path("current")).toUri(), conf).rename(fs.makeQualified(path(f"{version}.pointer")), fs.makeQualified(path("current")), overwrite)
    return row["_n"]


def published(spark: SparkSession, target: str) -> DataFrame:
    """The version that publish last pointed to."""
    return spark.read.parquet(f"{target}/{spark.read.text(f'{target}/current').first()[0]}")


def smallest_per_pair(manifest: DataFrame, keys: list[str], size: str, path: str) -> DataFrame:
    """The smallest archive of each pair, by path among equals."""
    best = F.min_by(F.struct(size, path), F.struct(size, path))
    return manifest.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{size}", f"b.{path}")
