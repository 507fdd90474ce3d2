"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import discard, materialize

MOST_STEPS = 40


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of a link (a long, b long); root is the smallest node reachable.

    Both steps are aggregations and equi-joins; a hub's neighbours are pre-aggregated map-side.  In the first join
    they share one key and go to one task unless AQE splits that partition, which it did not do on the hub of
    the check tables.  Each round is written to the shared scratch folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = _state(edges)
    for _ in range(MOST_STEPS):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = large.where(a != b)
        down = large.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialize(small, "links")
        discard(old)
        now = _state(edges)
        if now == before:
            return edges.groupBy(a.alias("node")).agg(F.min(b).alias("root"))
        before = now
    raise RuntimeError("components did not settle")
