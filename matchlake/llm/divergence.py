"""Divergence of sources: how far the words of each (lang, source) group lie from those of every other group and of the language.

Terms are counted per partition in Python, with bounded memory, then summed by Spark.  The terms that enough documents of a language
hold are dealt to shards by hash, so neither a large vocabulary nor a source with a third of all rows meets in
one task.  Within a shard the groups of a language sit in seats: a seat is one compressed block with the probabilities of its
groups.  The blocks stay where they are (a cached, hash-partitioned table whose lineage is a table in the shared
folder), while in each round of a round-robin tournament (the circle method) every other seat sends its block to the
opponent of that round.  A meeting evaluates both directions, from the nonzero counts of either side only, and keeps the sum of
every pair of groups; a round adds a bounded number of blocks to the shuffle and is written before the next.  The terms
that tell a group from its language are ranked by a heap per group and shard, and the heaps' leftovers by a window.

Rounds are one fewer than the seats of the widest language, which are its groups divided by SEAT.

Everything is integer arithmetic: counts and products in decimals of 38 digits, probabilities and their
divergences within longs.

Defined results: null text, lang and source count as ''; every row is a document, repeated ones too; a group without terms, or
a language without kept terms, still has its pairs; equal values go by the item's UTF-8 bytes; only text, lang and
source are read, so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.common import arrow_rows, discard, materialize, pack, parallelism, read, unpack

LEAST_DOCUMENTS = 10
UNIT = 1_000_000_000
TOP = 10
SHARD_TERMS = 4096
SEAT = 4
BLOCKS_A_TASK = 256
_ENTRIES = 400_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TO_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTERS else 32 for c in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"
_KEY = ["lang", "shard", "seat"]
_PAIR = "lang string, source string, item string, value long"


def terms(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII; only A to Z are lower-cased."""
    return text.encode().translate(_TO_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term; what is gathered goes out whenever it exceeds _ENTRIES terms."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            keys = list(n)
            for at in range(0, len(keys), 50_000):
                own = keys[at : at + 50_000]
                columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array([k.decode() for k in own], pa.string()), pa.array([n[k] for k in own], pa.int64()), pa.array([docs[k] for k in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for lang, source, text in arrow_rows(batch):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            own = Counter(terms(text))
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before + 1
            if held > _ENTRIES:
                yield from out()
                held = 0
    yield from out()


def term_counts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs), and every group that occurs (lang, source)."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts, rows.select("lang", "source").distinct()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most UNIT + 1, so squares stay within a long."""
    return (p - q) ** 2 // (p + q)


def opponents(seats: int) -> list[list[tuple[int, int]]]:
    """The rounds of the circle method: every pair of seats meets once, no seat twice in a round."""
    n = seats + seats % 2
    rounds = []
    for r in range(n - 1):
        pairs = [(n - 1, r)] + [((r + k) % (n - 1), (r - k) % (n - 1)) for k in range(1, n // 2)]
        rounds.append([(a, b) for a, b in pairs if max(a, b) < seats])
    return rounds


class Block:
    """Groups of a seat within a shard: their names, what an absent term has there, and the terms that occur."""

    def __init__(self, names: list[str], none: np.ndarray, cuts: np.ndarray, term: np.ndarray, p: np.ndarray):
        self.names, self.none, self.cuts, self.term, self.p = names, none, cuts, term, p

    def pieces(self) -> dict[str, object]:
        return {"names": self.names, "none": pack(self.none), "cuts": pack(self.cuts), "term": pack(self.term), "p": pack(self.p)}

    @classmethod
    def of(cls, names, none, cuts, term, p) -> Block:
        return cls(list(names), unpack(none), unpack(cuts), unpack(term), unpack(p))


def meet(home: Block, away: Block, width: int) -> np.ndarray:
    """Divergence of each group of home (rows) from each of away (columns), summed over the shard's width terms.

    From what an absent term of away has: the home group's own terms, and the rest of the shard.  Then away's own terms are put right.
    """
    out = np.empty((len(home.names), len(away.names)), np.int64)
    lengths = np.diff(away.cuts)
    none = np.repeat(away.none, lengths)
    full = np.flatnonzero(lengths)
    for g, zero in enumerate(home.none.tolist()):
        own = slice(home.cuts[g], home.cuts[g + 1])
        dense = np.full(width, zero, np.int64)
        dense[home.term[own]] = home.p[own]
        mine = home.p[own]
        row = (width - len(mine)) * divergence(np.int64(zero), away.none)
        for at in range(0, len(away.names), 64):
            row[at : at + 64] += divergence(mine[:, None], away.none[None, at : at + 64]).sum(0)
        met = dense[away.term]
        change = divergence(met, away.p) - divergence(met, none)
        if len(full):
            row[full] += np.add.reduceat(change, away.cuts[:-1][full])
        out[g] = row
    return out


def _seat(rows: pd.DataFrame) -> pd.DataFrame:
    """One block from the rows of a seat: a row for each group (term -1), and one for each term that it has."""
    rows = rows.sort_values(["source", "t"], kind="stable")
    head = rows[rows["t"] < 0]
    own = rows[rows["t"] >= 0]
    names = head["source"].tolist()
    counts = own.groupby("source").size()
    cuts = np.concatenate([[0], np.cumsum([int(counts.get(s, 0)) for s in names])]).astype(np.int64)
    block = Block(names, head["p"].to_numpy(np.int64), cuts, own["t"].to_numpy(np.int64), own["p"].to_numpy(np.int64))
    first = rows.iloc[0]
    return pd.DataFrame([{"lang": first["lang"], "shard": first["shard"], "seat": first["seat"], "width": first["width"], **block.pieces()}])


_BLOCK = "lang string, shard int, seat int, width int, names array<string>, none binary, cuts binary, term binary, p binary"


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            own = Block.of(r.names, r.none, r.cuts, r.term, r.p)
            values = meet(own, own, r.width)
            out += [(r.lang, a, b, int(values[i, j])) for i, a in enumerate(own.names) for j, b in enumerate(own.names) if i != j]
        yield pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            home, away = Block.of(r.names, r.none, r.cuts, r.term, r.p), Block.of(r.a_names, r.a_none, r.a_cuts, r.a_term, r.a_p)
            values = meet(home, away, r.width).tolist()  # the same either way: (p - q)^2 / (p + q)
            for a, row in zip(home.names, values, strict=True):
                for b, value in zip(away.names, row, strict=True):
                    out += [(r.lang, a, b, value), (r.lang, b, a, value)]
        yield pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The TOP terms of each group among the rows of this partition."""
    heaps: dict[tuple[str, str], list] = {}
    for pdf in batches:
        p, q = pdf["p"].to_numpy(np.int64), pdf["q"].to_numpy(np.int64)
        for lang, source, term, value in zip(pdf["lang"], pdf["source"], pdf["term"], divergence(p, q).tolist(), strict=True):
            entry = (value, _Later(term.encode()), term)
            heap = heaps.setdefault((lang, source), [])
            if len(heap) < TOP:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)
    rows = [(*group, term, value) for group, heap in heaps.items() for value, _, term in heap]
    yield pd.DataFrame(rows, columns=["lang", "source", "item", "value"])


class _Later:
    """Bytes that compare the other way round: of equal values the smaller term is the better one."""

    def __init__(self, b: bytes):
        self.b = b

    def __lt__(self, other: _Later) -> bool:
        return self.b > other.b

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.b == other.b


class Audit:
    """Counts, kept terms and probabilities of every group; least: documents that a kept term needs."""

    def __init__(self, df: DataFrame, least: int = LEAST_DOCUMENTS, shard_terms: int = SHARD_TERMS, seat: int = SEAT):
        self.spark = df.sparkSession
        found, groups = term_counts(df)
        counts = materialize(found, "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum(F.col("docs").cast("decimal(38,0)")).alias("docs"), F.sum(F.col("n").cast("decimal(38,0)")).alias("all_n")).where(F.col("docs") >= least)
        kept = materialize(kept.select("lang", "term", "all_n"), "kept")
        groups = materialize(groups, "groups")
        exact = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)").alias(c)
        totals = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
        langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(totals, "lang", "left")
        langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), exact("all_total"), F.ceil(F.col("g") / seat).cast("int").alias("seats"))
        self.langs = materialize(langs.withColumn("shards", F.greatest(F.ceil(F.col("v") / shard_terms), F.lit(1)).cast("int")), "langs")
        placed = kept.join(self.langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
        place = Window.partitionBy("lang", "shard").orderBy("term")
        q = _probability("all_n", "all_total")
        self.terms = materialize(placed.select("lang", "term", "shard", (F.row_number().over(place) - 1).alias("t"), q.alias("q")), "terms")
        own = counts.join(self.terms, ["lang", "term"])
        sizes = own.groupBy("lang", "source").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("total"))
        sized = groups.join(sizes, ["lang", "source"], "left").join(self.langs, "lang").select("lang", "source", "v", "shards", exact("total"), F.pmod(F.xxhash64("source"), F.col("seats")).cast("int").alias("seat"))
        self.groups = materialize(sized, "sized")
        cells = own.join(self.groups, ["lang", "source"]).select("lang", "source", "seat", "shard", "term", "t", "n", "q", _probability("n", "total").alias("p"))
        self.cells = materialize(cells, "cells")
        for gone in (counts, kept, groups):
            discard(gone)

    def blocks(self) -> DataFrame:
        """One compressed block for each seat of each shard."""
        widths = self.terms.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("width"))
        heads = self.groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        columns = ["lang", "shard", "seat", "source"]
        heads = heads.select(*columns, F.lit(-1).alias("t"), _probability(F.lit(0), "total").alias("p"))
        rows = heads.unionByName(self.cells.select(*columns, "t", "p")).join(widths, ["lang", "shard"], "left").fillna({"width": 0})
        return rows.groupBy(*_KEY).applyInPandas(_seat, _BLOCK)

    def pairs(self) -> DataFrame:
        """lang, source, item, value for each two groups of a language, both ways."""
        count, seats = self.langs.agg(F.sum(F.col("shards") * F.col("seats")), F.max("seats")).first()
        n = max(parallelism(self.spark), (count or 0) // BLOCKS_A_TASK)
        written = materialize(self.blocks(), "blocks")
        resident = written.repartition(n, *_KEY).persist()
        parts = [materialize(resident.mapInPandas(_within, _PAIR), "meetings")]
        for pairs in opponents(seats or 0):
            if not pairs:
                continue
            table = self.spark.createDataFrame(pairs, "seat int, to int")
            travelling = resident.join(F.broadcast(table), "seat").select("lang", "shard", F.col("to").alias("seat"), *(F.col(c).alias(f"a_{c}") for c in ("names", "none", "cuts", "term", "p")))
            parts.append(materialize(resident.join(travelling, _KEY).mapInPandas(_between, _PAIR), "meetings"))
        resident.unpersist()
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def telling_terms(self) -> DataFrame:
        """lang, source, item, value: the candidates among the terms that a group has more often than its language."""
        return self.cells.where("n > 0 AND p > q").select("lang", "source", "term", "p", "q").mapInPandas(_heaps, _PAIR)


def _probability(count, total: str):
    """1 + floor(UNIT * (count + 2) / (total + 2 * v)), exactly."""
    exact = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(25,0)")
    above, below = F.lit(UNIT).cast("decimal(10,0)") * (exact(count) + 2), exact(total) + 2 * F.col("v")
    whole = (above - F.pmod(above, below)) / below
    return (F.lit(1) + F.when(below > 0, whole).otherwise(0)).cast("long")


def audit(df: DataFrame, **options: int) -> DataFrame:
    own = Audit(df, **options)
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = own.pairs().withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(group))
    telling = own.telling_terms().withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= TOP)
    return pairs.unionByName(telling).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}

ORACLE_SQL = {
    "op12_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
  tokens AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
  kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 10),
  sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
  p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // CAST(t.total + 2 * v AS HUGEINT) AS BIGINT) AS p FROM cells JOIN totals t USING (lang, source) JOIN sizes s USING (lang)),
  q AS (SELECT lang, term, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // CAST(total + 2 * v AS HUGEINT) AS BIGINT) AS q FROM kept JOIN sizes USING (lang)),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
  met AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  telling AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  every AS (SELECT lang, source, part, item, coalesce(m.value, 0) AS value FROM pairs LEFT JOIN met m USING (lang, source, item) UNION ALL SELECT * FROM telling)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10"""
}
