"""Identity resolution and filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_games(games: DataFrame, mine: list[str], stages: tuple[int, int], roster: tuple[int, int], include_cpu: bool = False) -> DataFrame:
    """Orient two-player games to the first player whose code is mine.

    games: players array<struct<code, character, is_cpu>>, stage, is_teams, error, winner_index, ts, seq.
    Games with an error, teams, other than two players, a known cpu, or an illegal stage or character go.
    A game of mine against mine has no result.
    """
    p = F.col("players")
    own = F.transform(p, lambda x: F.coalesce(x["code"].isin(mine), F.lit(False)))
    at = F.array_position(own, True)
    kept = games.where(F.col("error").isNull() & ~F.col("is_teams") & (F.size(p) == 2) & F.col("stage").between(*stages))
    kept = kept.where(F.forall(p, lambda x: x["character"].between(*roster)) & (at > 0))
    if not include_cpu:
        kept = kept.where(~F.exists(p, lambda x: F.coalesce(x["is_cpu"], F.lit(False))))
    kept = kept.withColumn("_at", at.cast("int")).withColumn("self_match", F.forall(own, lambda x: x))
    won = F.when(F.col("self_match") | F.col("winner_index").isNull(), None).otherwise((F.col("winner_index") + 1 == F.col("_at")).cast("int"))
    return kept.withColumns({"me": F.element_at(p, F.col("_at")), "opp": F.element_at(p, 3 - F.col("_at")), "w": won}).drop("_at")


def resolve_team_games(games: DataFrame, mine: list[str]) -> DataFrame:
    """Orient 2v2 games: four players, one ally, two opponents of another known team."""
    p = F.col("players")
    at = F.array_position(F.transform(p, lambda x: F.coalesce(x["code"].isin(mine), F.lit(False))), True)
    kept = games.where(F.col("error").isNull() & F.col("is_teams") & (F.size(p) == 4) & (at > 0)).withColumn("me", F.element_at(p, at.cast("int"))).withColumn("_at", at)
    me_team = F.col("me.team")
    other = F.filter(p, lambda x, i: i + 1 != F.col("_at"))
    kept = kept.withColumn("_ally", F.filter(other, lambda x: x["team"] == me_team)).withColumn("opps", F.filter(other, lambda x: x["team"] != me_team))
    kept = kept.where(me_team.isNotNull() & (F.size("_ally") == 1) & (F.size("opps") == 2)).withColumn("ally", F.col("_ally")[0])
    both = F.exists(F.concat("_ally", "opps"), lambda x: F.coalesce(x["code"].isin(mine), F.lit(False)))
    won = F.when(both | F.col("winner_team").isNull(), None).otherwise((F.col("winner_team") == me_team).cast("int"))
    return kept.withColumns({"self_match": both, "w": won}).drop("_at", "_ally")


def date_range_error(start: str | None, end: str | None) -> str | None:
    """What is wrong with a custom range, or None."""
    for x in (start, end):
        if x is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
            return "dates are written YYYY-MM-DD"
        try:
            date.fromisoformat(x)
        except ValueError:
            return "no such date"
    return "the range ends before it starts" if start > end else None


def range_error(start: Column, end: Column) -> Column:
    """date_range_error of columns."""
    written = lambda x: F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    is_day = lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    return F.when(~written(start) | ~written(end), "dates are written YYYY-MM-DD").when(~is_day(start) | ~is_day(end), "no such date").when(start > end, "the range ends before it starts")


@dataclass(frozen=True)
class Filters:
    """Declarative predicates; None means any. range: all, custom, or a number of days up to now."""

    day: str | None = None
    range: str | int = "all"
    start: str | None = None
    end: str | None = None
    now: datetime | None = None
    equal: tuple[tuple[str, object], ...] = ()
    modes: tuple[str, ...] = ()

    def dates(self, ts: str = "ts") -> Column:
        """A day beats a custom range (both ends in; an invalid one matches nothing), which beats a look-back."""
        when = F.col(ts)
        if self.day:
            return F.coalesce(F.to_date(when) == F.lit(self.day).cast("date"), F.lit(False))
        if self.range == "custom":
            if date_range_error(self.start, self.end):
                return F.lit(False)
            return F.coalesce(F.to_date(when).between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date")), F.lit(False))
        if self.range == "all":
            return F.lit(True)
        return F.coalesce(when >= F.lit((self.now - timedelta(days=int(self.range))).isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(False))

    def apply(self, df: DataFrame, ts: str = "ts", mode: str = "mode") -> DataFrame:
        out = df.where(self.dates(ts))
        for column, value in self.equal:
            out = out.where(F.col(column) == F.lit(value))
        return out.where(F.col(mode).isin(*self.modes)) if self.modes else out


def listwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose every named column is known and finite."""
    out = df.dropna(subset=columns)
    for c, kind in df.dtypes:
        if c in columns and kind in ("double", "float"):
            out = out.where(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return out
