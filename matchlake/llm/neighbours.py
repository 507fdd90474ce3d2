"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own k-means codebook; a vector's entry lies in the cell of its
two nearest centroids.  A query walks the cells in order of the summed distances of their two
centroids, with a heap, until it has met enough entries; these are reranked by exact distance.

Codebooks are fitted on a bounded sample (SAMPLE vectors, chosen by hash); every vector is indexed.  The
cell table has at most CODES ** 2 counts, so it is bounded.  Equal vectors are indexed once,
with their k + 1 smallest ids, which is all that a result can use.  Entries travel as blocks of one
row of the cell table (a first centroid), queries as lists per row with the columns their walk opened; a
task meets one block with one list and returns only the best k of each query, so no pair table exists and
no cell is gathered whole.

An entry's cell is met by cost, not by a bound, so recall is measured, not certain.  A table of no more vectors than
CODES has one centroid for each, and what a query meets is then exactly the nearest share of them.

Defined results: vectors that are null, zero, of another length than the table's most common one, or hold
null or non-finite components take no part; with fewer candidates than k all come back; equal distances
go by vec_id; rows that share a vec_id count as one (the first by content), so repeated rows come once; only vec_id and embedding
are read, so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.common import materialize, read

SAMPLE = 16_384
CODES = 256
BLOCK = 2000
SLICE = 256  # queries routed at a time: SLICE * CODES ** 2 bytes of opened cells at most
ROUNDS = 12
#: Entries met by a query, as a share of all.  Vectors without structure (all nearly equally far apart, like those
#: of the test tables) need so much for a recall of 0.9.
VISIT = 0.35


def usable(df: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part, one per vec_id."""
    vec = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["n"] if sizes else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spread sample points; an emptied centroid keeps its place."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _near(x, centroids)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[a : a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def walk(first: np.ndarray, second: np.ndarray, counts: dict[int, int], enough: int):
    """Cells in ascending summed distance until enough entries are met (a heap over the two sorted lists)."""
    one, two, k = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist(), len(second)
    a, b = first[one].tolist(), second[two].tolist()
    heap, met = [(a[0] + b[0], 0, 0)], 0
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        cell = one[i] * k + two[j]
        if cell in counts:
            met += counts[cell]
            yield cell


class MultiIndex:
    def __init__(self, vectors: DataFrame, k: int, visit: float = VISIT):
        """vectors: vec_id, vec. k: results per query. visit: share of the entries that a query meets."""
        self.k, self.spark = k, vectors.sparkSession
        key = F.sha2(F.array_join(F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("array<string>"), ","), 256)
        order = Window.partitionBy("key").orderBy("vec_id")
        kept = vectors.withColumn("key", key).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        self.entries = materialize(kept.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
        n = self.entries.count()
        self.codes = max(1, min(CODES, n))
        sample = [r[0] for r in self.entries.select("vec").orderBy("key").limit(SAMPLE).collect()]
        x = np.array(sample, float) if sample else np.zeros((1, 2))
        self.half = x.shape[1] // 2
        self.books = kmeans(x[:, : self.half], min(self.codes, len(x))), kmeans(x[:, self.half :], min(self.codes, len(x)))
        self.enough = max(k + 1, math.ceil(visit * n))
        books, half = self.books, self.half

        def place(batches):
            for pdf in batches:
                v = np.array(pdf["vec"].tolist(), float)
                cell = _near(v[:, :half], books[0]) * len(books[1]) + _near(v[:, half:], books[1]) if len(v) else np.empty(0, np.int64)
                yield pd.DataFrame({"row": cell // len(books[1]), "col": cell % len(books[1]), "vec": [x.tobytes() for x in v], "ids": [np.array(x, np.int64).tobytes() for x in pdf["ids"]]})

        placed = self.entries.select("vec", "ids").mapInPandas(place, "row long, col long, vec binary, ids binary")
        self.placed = materialize(placed, "placed")
        width = len(books[1])
        self.counts = {r[0] * width + r[1]: r[2] for r in self.placed.groupBy("row", "col").agg(F.count("*")).collect()}  # at most CODES ** 2

    def blocks(self) -> DataFrame:
        """row and its entries, BLOCK or so to a block."""
        width, totals = len(self.books[1]), {}
        for cell, n in self.counts.items():
            totals[cell // width] = totals.get(cell // width, 0) + n
        large = {r: -(-n // BLOCK) for r, n in totals.items() if n > BLOCK}
        parts = F.lit(1)
        if large:
            parts = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("row")], F.lit(1))
        dealt = self.placed.withColumn("part", F.pmod(F.xxhash64("ids"), parts))
        return dealt.groupBy("row", "part").agg(F.collect_list(F.struct("col", "vec", "ids")).alias("entries"))

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score for queries (vec_id, vec); a query never finds its own id."""
        books, half, counts, enough, k = self.books, self.half, self.counts, self.enough, self.k
        width = len(books[1])

        def route(batches):
            for pdf in batches:
                for at in range(0, len(pdf), SLICE):
                    yield slice_of(pdf[at : at + SLICE])

        def slice_of(pdf: pd.DataFrame) -> pd.DataFrame:
            v, ids = np.array(pdf["vec"].tolist(), float), pdf["vec_id"].to_numpy()
            lists: dict[int, dict[int, np.ndarray]] = {}
            for i, (a, b) in enumerate(zip(_squares(v[:, :half], books[0]), _squares(v[:, half:], books[1]), strict=True)):
                for c in walk(a, b, counts, enough):
                    opened = lists.setdefault(c // width, {})
                    if i not in opened:
                        opened[i] = np.zeros(width, bool)
                    opened[i][c % width] = True
            rows = [(r, ids[[*x]].tobytes(), v[[*x]].tobytes(), np.concatenate([*x.values()]).tobytes()) for r, x in lists.items()]
            return pd.DataFrame(rows, columns=["row", "ids", "queries", "opened"])

        def rerank(batches):
            for pdf in batches:
                out = []
                for names, qs, opened, entries in zip(pdf["ids"], pdf["queries"], pdf["opened"], pdf["entries"], strict=True):
                    v = np.frombuffer(b"".join(e["vec"] for e in entries)).reshape(len(entries), -1)
                    ids = [np.frombuffer(e["ids"], np.int64).tolist() for e in entries]
                    col, names = np.array([e["col"] for e in entries]), np.frombuffer(names, np.int64).tolist()
                    opened = np.frombuffer(opened, bool).reshape(len(names), -1)
                    for name, q, own in zip(names, np.frombuffer(qs).reshape(len(names), -1), opened, strict=True):
                        some = np.flatnonzero(own[col])
                        d = np.sqrt(((v[some] - q) ** 2).sum(1))
                        # ties at the border stay: their ids decide
                        bound = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
                        near = sorted((d[e], i) for e in np.flatnonzero(d <= bound) for i in ids[some[e]] if i != name)[:k]
                        out.append((name, np.array([i for _, i in near], np.int64).tobytes(), np.array([s for s, _ in near]).tobytes()))
                yield pd.DataFrame(out, columns=["query_id", "ids", "scores"])

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for name, own in pdf.groupby("query_id"):
                ids, scores = np.frombuffer(b"".join(own["ids"]), np.int64), np.frombuffer(b"".join(own["scores"]))
                order = np.lexsort((ids, scores))[:k]
                out += [(name, r + 1, int(ids[o]), float(scores[o])) for r, o in enumerate(order)]
            return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

        routed = queries.mapInPandas(route, "row long, ids binary, queries binary, opened binary")
        met = routed.join(self.blocks(), "row").select("ids", "queries", "opened", "entries").mapInPandas(rerank, "query_id long, ids binary, scores binary")
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // 64))))
        return met.groupBy(part.alias("part")).applyInPandas(best, "query_id long, rank int, vec_id long, score double")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(usable(read(spark, sf_dir, "embeddings")), "vectors")
    return MultiIndex(vectors, 10).search(vectors.where("vec_id % 100 = 0"))


QUERIES = {"op1_inverted_multi_index": op1_inverted_multi_index}
ORACLE_SQL: dict[str, str] = {}
