"""Statistical layer: ridge logistic regression by IRLS, correlated pairs, coach detectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import z_two


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop))).first()
    return np.array(row[0::2], float), np.array(row[1::2], float)


def irls(df: DataFrame, columns: list[str], label: str, ridge: float = 0.01, rounds: int = 60, tolerance: float = 1e-8) -> dict[str, float] | None:
    """Coefficients per standard deviation and the intercept; None if singular or a class is missing.

    Each round is one aggregation of the (k + 1)-square normal equations in the JVM: only sums that do not
    grow with the rows reach the driver.
    """
    classes = df.agg(F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))).first()
    if min(classes) == 0:
        return None
    mean, sd = moments(df, columns)
    used = [i for i in range(len(columns)) if sd[i] > 1e-9]
    x = [F.lit(1.0), *((F.col(columns[i]) - float(mean[i])) / float(sd[i]) for i in used)]
    k, y = len(x), F.col(label).cast("double")
    beta, penalty = np.zeros(k), np.array([0.0] + [ridge] * (k - 1))
    for _ in range(rounds):
        eta = sum((float(b) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
        w = F.greatest(p * (1 - p), F.lit(1e-9))
        sums = df.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), w.alias("w"), (y - p).alias("r"))
        row = sums.agg(*(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)), *(F.sum(F.col("r") * F.col(f"x{i}")) for i in range(k))).first()
        h, values = np.zeros((k, k)), iter(row)
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = next(values)
        g = np.array([next(values) for _ in range(k)]) - penalty * beta
        h += np.diag(penalty)
        if np.linalg.cond(h) > 1e12:
            return None
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return {"intercept": float(beta[0]), **{columns[i]: float(b) for i, b in zip(used, beta[1:], strict=True)}}


def correlated_pairs(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("p"))
    return long.select("p.*").where(F.abs("r") >= least)


def standouts(df: DataFrame, keys: list[str], by: str, least: int, z: float, top: int) -> DataFrame:
    """Values whose win rate differs from the rest of their key's games; the strongest first."""
    cells = df.where("w IS NOT NULL").groupBy(*keys, by).agg(F.sum("w").alias("w1"), F.count("*").alias("n1"))
    total = df.where("w IS NOT NULL").groupBy(*keys).agg(F.sum("w").alias("wt"), F.count("*").alias("nt"))
    both = cells.join(total, keys).withColumns({"w2": F.col("wt") - F.col("w1"), "n2": F.col("nt") - F.col("n1")})
    scored = both.withColumn("z", z_two(F.col("w1"), F.col("n1"), F.col("w2"), F.col("n2"))).where((F.col("n1") >= least) & (F.abs("z") >= z))
    effect = F.col("w1") / F.col("n1") - F.col("w2") / F.col("n2")
    return scored.select(*keys, by, "n1", "z", effect.alias("effect"), (F.abs(effect) * F.sqrt("n1")).alias("score")).orderBy(F.desc("score"), by).limit(top)
