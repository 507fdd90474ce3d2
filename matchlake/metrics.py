"""Declarative ratio metrics: one definition serves grouped, rolling and cube contexts, as sums compose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchlake.functions.scalar import ratio


@dataclass(frozen=True)
class RatioMetric:
    """Sum of num over sum of den, times scale, less the ratio named by subtract; null rows stay out of both."""

    name: str
    num: Column
    den: Column
    scale: float = 1.0

    def _parts(self) -> tuple[Column, Column]:
        known = self.num.isNotNull() & self.den.isNotNull()
        return F.when(known, self.num.cast("double")), F.when(known, self.den.cast("double"))

    def grouped(self) -> Column:
        num, den = self._parts()
        return (ratio(F.sum(num), F.sum(den)) * self.scale).alias(self.name)

    def rolling(self, window: WindowSpec) -> Column:
        num, den = self._parts()
        return (ratio(F.sum(num).over(window), F.sum(den).over(window)) * self.scale).alias(self.name)


def record(w: Column | str = "w") -> list[Column]:
    """games, wins, losses, decided, win_rate of a tri-state result (1, 0, null)."""
    w = F.col(w) if isinstance(w, str) else w
    wins, losses = F.count(F.when(w == 1, 1)), F.count(F.when(w == 0, 1))
    return [F.count("*").alias("games"), wins.alias("wins"), losses.alias("losses"), (wins + losses).alias("decided"), ratio(wins, wins + losses).alias("win_rate")]


def group_rows(df: DataFrame, keys: list[str], metrics: list[RatioMetric] = (), w: str = "w") -> DataFrame:
    return df.groupBy(*keys).agg(*record(w), *(m.grouped() for m in metrics))


def trailing(keys: list[str], order: list[str], n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
