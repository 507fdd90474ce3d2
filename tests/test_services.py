"""Shards that refuse what is not theirs, builds that resume, bundles, and the dirty queue."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from matchlake.sources import shards
from matchlake.streaming import incremental, queue


def _table(spark):
    return spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("k"), (F.col("id") * 1.5).alias("x"))


def test_verified_shards_refuse_changed_missing_and_foreign_files(spark, tmp_path):
    for name, harm, word in (("ok", None, None), ("changed", "changed", "changed"), ("missing", "missing", "missing"), ("foreign", "foreign", "foreign"), ("unfinished", "unfinished", "manifest")):
        path = str(tmp_path / name)
        shards.write_verified(_table(spark), path, ["k"])
        files = sorted(glob.glob(f"{path}/data/k=*/*.parquet"))
        if harm == "changed":
            with open(files[0], "r+b") as f:
                f.seek(8)
                f.write(b"\x00\x01\x02")
            os.remove(f"{os.path.dirname(files[0])}/.{os.path.basename(files[0])}.crc")  # else the file system itself refuses it
        elif harm == "missing":
            os.remove(files[0])
        elif harm == "foreign":
            _table(spark).where("k = 1").drop("k").coalesce(1).write.mode("append").parquet(f"{path}/data/k=1")
        elif harm == "unfinished":
            os.remove(f"{path}/manifest/_SUCCESS")
        if word is None:
            got = shards.read_verified(spark, path)
            assert sorted(map(tuple, got.select("id", "k", "x").collect())) == sorted(map(tuple, _table(spark).collect()))
        else:
            with pytest.raises(shards.ShardError, match=word):
                shards.read_verified(spark, path)


def test_a_stopped_build_goes_on_and_equals_an_unbroken_one(spark, tmp_path):
    df, done = _table(spark), []

    def stage(part):
        k = part.first()["k"]
        if k == stop:
            raise RuntimeError("stopped")
        done.append(k)
        return part.groupBy("k").agg(F.sum("x").alias("x"))

    stop = 1
    with pytest.raises(RuntimeError):
        shards.build(df, stage, str(tmp_path / "b"), "k", "v1")
    assert done == [0]
    stop = None
    rows = lambda d: sorted((r["k"], r["x"]) for r in d.select("k", "x").collect())
    got = rows(shards.build(df, stage, str(tmp_path / "b"), "k", "v1"))
    assert done == [0, 1, 2] and got == rows(shards.build(df, stage, str(tmp_path / "other"), "k", "v1"))
    done.clear()
    shards.build(df, stage, str(tmp_path / "b"), "k", "v1")
    assert done == []  # nothing changed
    changed = df.withColumn("x", F.when(F.col("id") == 5, 0.0).otherwise(F.col("x")))
    assert rows(shards.build(changed, stage, str(tmp_path / "b"), "k", "v1")) == rows(changed.groupBy("k").agg(F.sum("x").alias("x"))) and done == [2]
    done.clear()
    shards.build(df, stage, str(tmp_path / "b"), "k", "v2")
    assert sorted(done) == [0, 1, 2]


def test_bundles_hold_what_is_allowed_however_deep(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, array(struct(2 AS n, map('a', 'b') AS m)) AS list")
    fields = {"id": "int", "list[].n": "int", "list[].m{key}": "string", "list[].m{value}": "string"}
    assert dict(shards.leaves(df.schema)) == fields
    shards.snapshot(df, str(tmp_path / "s"), ["id"], fields)
    assert shards.restore(spark, str(tmp_path / "s"), ["id"], fields).count() == 1
    secret = spark.sql("SELECT 1 AS id, array(struct(2 AS n, map('a', 'b') AS m, 'x' AS email)) AS list")
    for bad in (secret, df.drop("list"), df.withColumn("id", F.lit("1"))):
        with pytest.raises(ValueError):
            shards.allowed(bad, fields)
    df.write.mode("append").parquet(str(tmp_path / "s" / "data"))
    with pytest.raises(ValueError):
        shards.restore(spark, str(tmp_path / "s"), ["id"], fields)


def test_queue_equals_batch_after_repeats_and_disorder(spark, tmp_path):
    target, schema = str(tmp_path / "t"), "k long, n long, x long"
    state = {"rows": [(1, 5), (2, 7)]}
    base = lambda: spark.createDataFrame(state["rows"], "k long, x long")
    build = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    write = queue.dirty_sink(base, build, target, "k", schema, 4)
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "k long")
    now = lambda: sorted(map(tuple, queue.read_table(spark, target, schema).collect()))
    batch = lambda: sorted(map(tuple, build(base()).collect()))
    write(keys(1, 2, 2, None), 0)
    assert now() == batch()
    files = lambda: sorted(glob.glob(f"{target}/data/*"))
    before = files()
    write(keys(), 1)  # nothing changed, nothing is written
    assert files() == before
    state["rows"] = [(1, 5), (1, 6), (3, 1)] + [(i, i) for i in range(10, 40)]
    write(keys(*range(10, 40), 3, 2, 1), 2)
    assert now() == batch()  # a key without rows is gone
    write(keys(*range(10, 40), 3, 2, 1), 2)  # the same batch again
    assert now() == batch() and len(files()) <= 4
    state["rows"] = []
    write(keys(1, 3, *range(10, 40)), 3)
    assert now() == [] == batch()


def test_queue_as_a_stream_of_files(spark, tmp_path):
    target, schema = str(tmp_path / "t"), "k long, n long"
    source = str(tmp_path / "in")
    base = lambda: spark.read.schema("k long, v long").parquet(source)
    build = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    for round_ in range(3):
        spark.createDataFrame([(k, round_) for k in range(round_, round_ + 5)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, "k long, v long", 1).select("k")
        incremental.run_available(stream, queue.dirty_sink(base, build, target, "k", schema, 4), str(tmp_path / "ck"))
        assert sorted(map(tuple, queue.read_table(spark, target, schema).collect())) == sorted(map(tuple, build(base()).collect()))
