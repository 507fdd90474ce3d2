"""Canonical exact document digests, in DataFrame functions only.

A text is folded (simple case mapping through upper and lower, canonical composition, runs of white space to one
space, ends trimmed) and hashed to 128 bits by two chained XXH64.  Inside equal digests the folded
bytes are compared; should two texts differ under one digest, the later ones (in byte order) carry
an ordinal, so equal fingerprints always mean equal folded texts.

Every text is folded once; what later steps need is a table of digests.  Only digests that occur twice are
compared, so texts that are alone never move for it, and a group of copies is reduced map-side to one row per
task before any shuffle.  The order of all documents comes from a range partitioning of (doc_id, text hash)
pairs; only the last pair of each range meets the others in one window.

Defined results: the empty text and blank ones share a fingerprint, and a null text is empty; likeness of exact
digests is 1 or 0; the order of documents is by doc_id, then by a hash of the text; rows equal in doc_id and text
have the same next document, one that differs from them; a document that is alone is its own next one; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.common import documents, materialize, read

#: White space of any kind; each becomes a space, and runs of spaces one.
WHITE = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PER_RANGE = 1_000_000  # pairs of one range
BROADCAST_DIGESTS = 1_000_000  # 32 hex digits each: under 100 MB


def canonical(text: Column) -> Column:
    folded = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.lower(F.upper(text)), F.lit(False))
    return F.trim(F.regexp_replace(F.translate(folded, WHITE, " " * len(WHITE)), "  +", " "))


def wide_hash(folded: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(folded))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("wide"), folded))), 16, "0"))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, h, n_chars and digest of (doc_id, text), written: the one folding of all texts."""
    # the folded text is a column of its own, so that the two halves of its hash do not fold it twice
    folded = df.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("folded"))
    return materialize(folded.select("doc_id", "h", "n_chars", wide_hash(F.col("folded")).alias("digest")), "hashes")


def collisions(df: DataFrame, hashes: DataFrame, digest: Column | None = None) -> DataFrame | None:
    """digest, folded, ordinal of texts that differ under one digest; None if there are none.

    digest: what to take for a digest of the column folded (wide_hash; tests force collisions with it).
    """
    many = materialize(hashes.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")
    many = F.broadcast(many) if many.count() <= BROADCAST_DIGESTS else many
    hashed = df.select(canonical(F.col("text")).alias("folded")).withColumn("digest", wide_hash(F.col("folded")) if digest is None else digest)
    variants = hashed.join(many, "digest").groupBy("digest", "folded").agg(F.count("*").alias("n"))
    apart = materialize(variants.groupBy("digest").agg(F.count("*").alias("v"), F.collect_list("folded").alias("folded")).where("v > 1"), "collisions")
    if apart.isEmpty():
        return None
    return apart.select("digest", F.posexplode(F.array_sort("folded")).alias("ordinal", "folded")).where("ordinal > 0")


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_chars and fingerprint of (doc_id, text)."""
    hashes = digests(df)
    apart = collisions(df, hashes)
    if apart is None:
        return hashes.withColumnRenamed("digest", "fingerprint")
    hashed = df.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("folded", canonical(F.col("text")))
    return named(hashed.withColumn("digest", wide_hash(F.col("folded"))), apart).drop("text")


def named(hashed: DataFrame, apart: DataFrame) -> DataFrame:
    """hashed (digest, folded and others) with fingerprint: the digest, and the ordinal of later texts under it."""
    both = hashed.join(apart, ["digest", "folded"], "left")
    return both.withColumn("fingerprint", F.concat_ws("-", "digest", F.col("ordinal").cast("string"))).drop("digest", "folded", "ordinal")


def exact_groups(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the smallest doc_id that shares it."""
    marked = fingerprints(documents(df)).select("doc_id", "fingerprint")
    first = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"))
    return marked.join(first, "fingerprint")


def with_next(marked: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Distinct (doc_id, h), with next_id, next_h and next_fingerprint: the one before it in ascending order.

    marked: doc_id, h, fingerprint.  The next one of the first is the last.
    """
    pairs = marked.select("doc_id", "h", "fingerprint").dropDuplicates(["doc_id", "h"])
    pairs = materialize(pairs, "pairs")
    ranges = max(1, -(-pairs.count() // per_range))
    dealt = materialize(pairs.repartitionByRange(ranges, "doc_id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    own = F.struct("doc_id", "h", "fingerprint")
    within = Window.partitionBy("part").orderBy("doc_id", "h")
    # one row per range of PER_RANGE documents
    lasts = dealt.groupBy("part").agg(F.max(own).alias("last"))
    over = Window.partitionBy(F.lit(0)).orderBy("part")
    before = lasts.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("border"))
    near = dealt.withColumn("inside", F.lag(own).over(within)).join(before, "part").withColumn("next", F.coalesce("inside", "border"))
    return near.select("doc_id", "h", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"), F.col("next.fingerprint").alias("next_fingerprint"))


def edited(df: DataFrame, marked: DataFrame) -> DataFrame:
    """df (doc_id, text) with h, n_chars, fingerprint, next_fingerprint and edited: the last third replaced.

    Only as many code points of the next text travel as its predecessor takes.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    once = marked.dropDuplicates(["doc_id", "h"])
    links = materialize(once.join(with_next(marked), ["doc_id", "h"]).withColumn("part", third), "links")
    texts = df.select("doc_id", F.xxhash64("text").alias("h"), "text")
    wanted = links.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), "part", "n_chars", "fingerprint", "next_fingerprint")
    repeated = not marked.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    heads = (texts.dropDuplicates(["doc_id", "h"]) if repeated else texts).join(wanted, ["doc_id", "h"])
    heads = heads.select(F.col("of_id").alias("doc_id"), F.col("of_h").alias("h"), "n_chars", "fingerprint", "next_fingerprint", "part", F.expr("left(text, part)").alias("head"))
    made = F.when(F.col("part") > 0, F.concat(F.expr("left(text, cast(n_chars - part as int))"), "head")).otherwise(F.col("text"))
    return texts.join(heads, ["doc_id", "h"]).withColumn("edited", made).drop("head", "part")


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(read(spark, sf_dir, "documents"))
    made = edited(docs, fingerprints(docs)).withColumn("folded", canonical(F.col("edited"))).withColumn("edited_fingerprint", wide_hash(F.col("folded")))
    same = F.substring("fingerprint", 1, 32) == F.col("edited_fingerprint")
    near = F.when(same, (canonical(F.col("text")) == F.col("folded")).cast("double")).otherwise(F.lit(0.0))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near.alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"))


QUERIES = {"op9_canonical_digest": op9_canonical_digest}
ORACLE_SQL: dict[str, str] = {}
