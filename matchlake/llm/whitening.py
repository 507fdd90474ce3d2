"""Whitening of embeddings from an exact scatter in residue numbers.

Entries become integers (floor(SCALE * c)), so the scatter of the centred vectors is an integer matrix.  Each
partition multiplies its rows n*x - S modulo several primes with floating-point matrix products small
enough to be exact; Spark adds the residues of all partitions per cell and prime; the driver puts every cell together
by the Chinese remainder theorem and takes the eigenvectors of a matrix that has been rounded once only.

Steps, each a pass over distributed rows: distinct integer vectors (written once to the shared scratch folder), their sums and
extremes per dimension, the residues of their scatter, the covariance of the whitened vectors, and the result
for every row.  What reaches the driver: a row per dimension, and one per cell of the upper
triangle and prime; MOST_DIMENSIONS bounds both.  The number of primes follows from n and the extremes.

Defined results: a vector that is null, empty, or holds null or non-finite entries takes no part, nor does one of another
length than the commonest one (among distinct vectors; the longer one of equally common lengths); rows that share
a vec_id, or have none, are rows of their own, and equal vectors count once in the fit; entries beyond a long are held at
its ends; vectors of fewer than four dimensions have as many components as dimensions; a component
whose eigenvalue is nothing but rounding (below d * 2^-52 of the greatest) has no whitened value (null) and stays out of
identity_error, which is null if none is left, as explained is without any variance; a deviation beyond a long is null;
eigenvectors point so that their entry of greatest size is positive; only vec_id and embedding are read,
so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import materialize, read

SCALE = 256
COMPONENTS = 4
MOST_DIMENSIONS = 4096
PRIME_BITS = 20
#: Residues lie within half a prime of zero, so a product of so many rows stays below 2^52.
ROWS = 1 << 14
_LONG = (1 << 63) - 1


def integers(df: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the vectors without null and non-finite entries."""
    vec = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fine).select("vec_id", F.transform("vec", lambda c: F.floor(c * SCALE)).alias("x"))


def primes(above: int) -> list[int]:
    """The greatest primes below 2^PRIME_BITS, as many as it takes for a product of more than above."""
    top = 1 << PRIME_BITS
    sieve = np.ones(top, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(top) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in reversed(np.flatnonzero(sieve).tolist()):
        if product > above:
            break
        out.append(p)
        product *= p
    return out


def centred(residues: np.ndarray, p: int) -> np.ndarray:
    """Residues as the numbers of least size, in double."""
    r = residues % p
    return np.where(r > p // 2, r - p, r).astype(float)


def scatter_residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """The scatter of n*x - sums modulo p (x: rows of longs)."""
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    shift = np.array([s % p for s in sums], np.int64)
    for at in range(0, len(x), ROWS):
        y = centred(x[at : at + ROWS] % p * (n % p) - shift, p)
        out = (out + (y.T @ y).astype(np.int64)) % p
    return out


def remainders_to_integer(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums, exactly: longs where they fit, else Python's integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < _LONG // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None beyond a long."""
    if y.dtype != object and len(y) and y.shape[1] * max(abs(int(y.max())), abs(int(y.min()))) ** 2 <= _LONG:
        return (y * y).sum(1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in y]
    return [v if v <= _LONG else None for v in found]


class Whitening:
    """Fitted on x (array<long>) of a DataFrame. n, sums, scatter (of n*x - sums), values and vectors (falling), explained, identity_error."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        fit = materialize(rows.select("x").distinct(), "vectors")
        lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.d, self.n = (lengths["d"], lengths["n"]) if lengths else (0, 0)
        if self.d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {self.d} dimensions; {MOST_DIMENSIONS} at most")
        if not self.n:
            return
        fit = fit.where(F.size("x") == self.d)
        self.sums, widest = self._sums(fit)
        self.scatter = self._scatter(fit, self.n * widest**2)
        self._components()
        self.identity_error = self._identity_error(fit)

    def _sums(self, fit: DataFrame) -> tuple[list[int], int]:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]):
            total, low, high = [0] * d, [_LONG] * d, [-_LONG - 1] * d
            for batch in batches:
                x = _matrix(batch.column(0), d)
                if len(x):
                    upper, lower = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()  # halves, whose sums stay within a long
                    total = [t + (u << 32) + v for t, u, v in zip(total, upper, lower, strict=True)]
                    low, high = (list(map(f, own, part)) for f, own, part in ((min, low, x.min(0).tolist()), (max, high, x.max(0).tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total), pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["i", "total", "low", "high"])

        parts = fit.mapInArrow(run, "i int, total string, low long, high long")
        found = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        sums = [int(r["total"]) for r in sorted(found, key=lambda r: r["i"])]
        return sums, max(max(self.n * r["high"] - int(r["total"]), int(r["total"]) - self.n * r["low"]) for r in found)

    def _scatter(self, fit: DataFrame, bound: int) -> list[list[int]]:
        d, n, sums, moduli = self.d, self.n, self.sums, primes(2 * bound + 1)
        upper = np.triu_indices(d)
        cells = (upper[0] * d + upper[1]).astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch]):
            totals = [np.zeros((d, d), np.int64) for _ in moduli]
            for batch in batches:
                x = _matrix(batch.column(0), d)
                totals = [(t + scatter_residues(x, n, sums, p)) % p for t, p in zip(totals, moduli, strict=True)]
            for k, t in enumerate(totals):
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), k, np.int32)), pa.array(t[upper])], ["cell", "k", "r"])

        parts = fit.mapInArrow(run, "cell int, k int, r long").groupBy("cell", "k").agg(F.sum("r").alias("r"))
        residues: dict[int, list[int]] = {}
        for r in parts.toLocalIterator():
            residues.setdefault(r["cell"], [0] * len(moduli))[r["k"]] = r["r"] % moduli[r["k"]]
        out = [[0] * d for _ in range(d)]
        for cell, rs in residues.items():
            out[cell // d][cell % d] = out[cell % d][cell // d] = remainders_to_integer(rs, moduli)
        return out

    def _components(self) -> None:
        v = np.array([[c / self.n**3 for c in row] for row in self.scatter])  # each quotient rounded once
        values, vectors = np.linalg.eigh(v)
        order = np.arange(self.d)[::-1][:COMPONENTS]
        self.values, self.vectors = values[order], vectors[:, order]
        signs = np.sign(self.vectors[np.abs(self.vectors).argmax(0), np.arange(len(order))])
        self.vectors = self.vectors * np.where(signs == 0, 1, signs)
        trace = sum(self.scatter[i][i] for i in range(self.d)) / self.n**3
        self.real = self.values > self.d * 2.0**-52 * max(values[-1], 0)
        self.explained = [float(e / trace) if trace > 0 else None for e in self.values]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows n*x - sums; columns whose eigenvalue is nothing but rounding hold NaN."""
        scale = np.where(self.real, np.sqrt(np.where(self.real, self.values, 1)), np.nan)
        return (y / self.n).astype(float) @ self.vectors / scale

    def _identity_error(self, fit: DataFrame) -> float | None:
        k, use = int(self.real.sum()), np.flatnonzero(self.real)
        if not k:
            return None
        d, n, sums, whitened = self.d, self.n, self.sums, self._plain().whitened

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                w = whitened(differences(_matrix(batch.column(0), d), n, sums))[:, use]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, j])) for j in range(k)], [f"w{j}" for j in range(k)])

        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = fit.mapInArrow(run, ", ".join(f"w{j} double" for j in range(k))).agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
        return max(abs(got[m] - (i == j)) for m, (i, j) in enumerate(pairs))

    def _plain(self) -> Whitening:
        """A copy that tasks may hold: no session and no scatter."""
        out = object.__new__(Whitening)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("spark", "scatter")}
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """A row for each row (vec_id, x) of the fitted length and component."""
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)))
        text = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not self.n:
            return self.spark.createDataFrame([], text)
        own = self._plain()

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                y = differences(_matrix(batch.column(1), own.d), own.n, own.sums)
                rows, k = len(y), len(own.values)
                w = own.whitened(y).reshape(-1)
                deviation = pa.array(squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, own.n), deviation]
                columns += [pa.array(w, mask=np.isnan(w)), pa.array(own.explained * rows, pa.float64()), pa.array([own.identity_error] * (rows * k), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

        return rows.where(F.size("x") == self.d).select("vec_id", "x").mapInArrow(run, text)


def whiten(df: DataFrame) -> DataFrame:
    rows = integers(df)
    return Whitening(rows).transform(rows)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
