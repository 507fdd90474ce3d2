"""Verified shards, resumable builds, and bundles whose schema is allowed field by field.

A shard table's manifest names every file with its bytes and SHA-256, taken where the files are read (binaryFile), never on the driver.  A
reader refuses a table of which a file is changed, missing or foreign.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from matchlake.sources.tables import content_digest

SCHEMA_VERSION = 1


class ShardError(ValueError):
    """A shard table that is not what its manifest says."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file (below path), bytes, sha256 of the data files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    root, at = _fs(spark, path)
    base = root.makeQualified(at).toString().rstrip("/")
    name = F.regexp_replace(F.col("path"), "^[a-z0-9+.-]+:/*", "/")
    start = F.length(F.regexp_replace(F.lit(base), "^[a-z0-9+.-]+:/*", "/")) + 2
    return files.select(F.substring(name, start, F.length(name)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_verified(df: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000) -> None:
    """Shards in path/data by the columns by, then path/manifest; a table without a manifest was never finished."""
    spark = df.sparkSession
    df.repartition(*by).write.mode("errorifexists").partitionBy(*by).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    file_digests(spark, f"{path}/data").withColumn("version", F.lit(SCHEMA_VERSION)).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def differences(spark: SparkSession, path: str) -> DataFrame:
    """file and problem (changed, missing, foreign, version) of a shard table."""
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ShardError(f"{path} has no finished manifest")
    said = spark.read.schema("file string, bytes long, sha256 string, version int").json(f"{path}/manifest")
    found = file_digests(spark, f"{path}/data").withColumnsRenamed({"bytes": "f_bytes", "sha256": "f_sha256"})
    both = said.join(found, "file", "full")
    problem = F.when(F.col("sha256").isNull(), "foreign").when(F.col("f_sha256").isNull(), "missing").when(F.col("version") != SCHEMA_VERSION, "version").when((F.col("sha256") != F.col("f_sha256")) | (F.col("bytes") != F.col("f_bytes")), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def read_verified(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The shards, once every file is what the manifest says."""
    broken = differences(spark, path).orderBy("file").limit(5).collect()
    if broken:
        raise ShardError("; ".join(f"{r['file']} is {r['problem']}" for r in broken))
    reader = spark.read.option("basePath", f"{path}/data")
    return (reader.schema(schema) if schema is not None else reader).parquet(f"{path}/data")


# --- resumable builds ------------------------------------------------------------------------------------------


def build(df: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, by: str, version: str) -> DataFrame:
    """stage of each partition of df (by its column by), written apart; finished partitions of the same input and version are kept.

    A partition's key is the digest of its rows and the version, so a changed input or code builds anew, and a run that was stopped goes on
    with what is missing.  stage must not mix partitions.  A partition counts as finished once its marker is there, which is
    written last; the digests are one row per partition.
    """
    spark = df.sparkSession
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    digests = df.groupBy(by).agg(F.sha2(F.concat_ws(":", F.lit(version), F.count("*").cast("string"), F.sum(row).cast("string")), 256).alias("digest"))
    paths = []
    for r in digests.orderBy(by).collect():
        at = f"{path}/{by}={r[by]}/{r['digest']}"
        if not exists(spark, f"{at}/_SUCCESS"):
            stage(df.where(F.col(by).eqNullSafe(F.lit(r[by])))).write.mode("overwrite").parquet(at)
        paths.append(at)
    return spark.read.parquet(*paths) if paths else stage(df)


# --- bundles that may be published -----------------------------------------------------------------------------


def leaves(schema: DataType, at: str = "") -> list[tuple[str, str]]:
    """Paths and types of all leaves; elements of arrays as [], keys and values of maps as {key} and {value}."""
    if isinstance(schema, StructType):
        return [x for f in schema.fields for x in leaves(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, ArrayType):
        return leaves(schema.elementType, f"{at}[]")
    if isinstance(schema, MapType):
        return [*leaves(schema.keyType, f"{at}{{key}}"), *leaves(schema.valueType, f"{at}{{value}}")]
    return [(at, schema.simpleString())]


def allowed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df if its leaves are exactly the allowed ones (path to type); whatever else it holds, however deep, is an error."""
    found = dict(leaves(df.schema))
    extra, short = sorted(found.keys() - fields.keys()), sorted(fields.keys() - found.keys())
    other = sorted(k for k in found.keys() & fields.keys() if found[k] != fields[k])
    if extra or short or other:
        raise ValueError(f"not allowed: {extra}; missing: {short}; of another type: {other}")
    return df


def snapshot(df: DataFrame, path: str, order: list[str], fields: dict[str, str]) -> str:
    """Writes an allowed table with the digest of its rows, which restore asks for; gives the digest."""
    digest = content_digest(allowed(df, fields), order).first()["digest"]
    df.write.mode("errorifexists").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/digest")
    return digest


def restore(spark: SparkSession, path: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """The snapshot, if its rows still have the digest that was written with them."""
    df = allowed(spark.read.parquet(f"{path}/data"), fields)
    said = spark.read.schema("digest string").json(f"{path}/digest").first()
    if said is None or content_digest(df, order).first()["digest"] != said["digest"]:
        raise ValueError(f"{path} is not what was written")
    return df


def sanity(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """rows per keys and, for each check, how many rows break it (an unknown answer breaks it)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
