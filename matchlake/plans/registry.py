"""Named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views that the oracles below build on; the functions of the same names are their Spark forms.
VIEWS = {
    "games": """games AS (SELECT o_orderkey AS game, o_custkey AS player, o_orderdate AS ts, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS w,
  o_orderpriority AS mode, c_mktsegment AS segment, c_nationkey AS nation, o_totalprice AS amount FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "plays": """plays AS (SELECT event_id AS game, user_id AS player, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS w, event_type AS mode, value FROM events)""",
    "moves": """moves AS (SELECT l_orderkey AS game, o_custkey AS player, p_brand AS grp, p_type AS kind, l_quantity AS landed, l_extendedprice AS damage, CAST(l_suppkey AS BIGINT) AS supplier
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)""",
}


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: a game with a tri-state result."""
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    w = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("player"), F.col("o_orderdate").alias("ts"), w.alias("w"), F.col("o_orderpriority").alias("mode"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("o_totalprice").alias("amount")
    )


def plays(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event: a game in a user's sequence."""
    w = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0)
    return load(spark, sf, "events").select(F.col("event_id").alias("game"), F.col("user_id").alias("player"), "ts", w.alias("w"), F.col("event_type").alias("mode"), "value")


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: a move within a game."""
    items, orders, parts = (load(spark, sf, t) for t in ("lineitem", "orders", "part"))
    both = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    return both.select(F.col("l_orderkey").alias("game"), F.col("o_custkey").alias("player"), F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"), F.col("l_quantity").alias("landed"), F.col("l_extendedprice").alias("damage"), F.col("l_suppkey").alias("supplier"))


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query; sql may use the named views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head, rest = ", ".join(VIEWS[v] for v in views), sql.strip()
            for start in ("WITH RECURSIVE ", "WITH "):
                if head and rest.upper().startswith(start):
                    rest = f"{start}{head}, {rest[len(start):]}"
                    break
            else:
                rest = f"WITH {head} {rest}" if head else sql
            ORACLES[name] = rest
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (adding 0.0 turns a negative zero positive), so that the order of sums does not show."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
