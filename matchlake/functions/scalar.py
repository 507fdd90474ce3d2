"""Scalar building blocks as Columns."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # 95 % two-sided normal quantile


def ratio(n: Column, d: Column) -> Column:
    """n / d where d > 0, else null: an absent measurement is never zero."""
    return F.when(d > 0, n.cast("double") / d)


def week_start(ts: Column) -> Column:
    """The Sunday on or before."""
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)


def hour_bucket(ts: Column) -> Column:
    return F.floor(F.hour(ts) / 6).cast("int")


def sigmoid(x: Column) -> Column:
    """Overflow-safe."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def elo_probability(a: Column, b: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale))


def decay(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -days / half_life)


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval; null without trials."""
    p, n = wins / n, n.cast("double")
    mid, spread, scale = p + Z95**2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n)), 1 + Z95**2 / n
    low, high = F.greatest(F.lit(0.0), (mid - spread) / scale), F.least(F.lit(1.0), (mid + spread) / scale)
    return F.when(n > 0, low), F.when(n > 0, high)


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2)


def log_loss(p: Column, y: Column, edge: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.when(y == 1, -F.log(q)).otherwise(-F.log1p(-q))


def z_one(p: Column, p0: Column, n: Column) -> Column:
    return F.when((n > 0) & (p0 > 0) & (p0 < 1), (p - p0) / F.sqrt(p0 * (1 - p0) / n))


def z_two(w1: Column, n1: Column, w2: Column, n2: Column) -> Column:
    p = (w1 + w2) / (n1 + n2)
    return F.when((n1 > 0) & (n2 > 0) & (p > 0) & (p < 1), (w1 / n1 - w2 / n2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def coarsen(v: Column, bucket: int) -> Column:
    """Nearest multiple, halves away from zero; null stays null."""
    return F.round(v / bucket) * bucket


def best_of(p: Column, n: int) -> Column:
    """Chance to win a best-of-n match from that of one game."""
    return sum(comb(n, k) * F.pow(p, k) * F.pow(1 - p, n - k) for k in range(n // 2 + 1, n + 1))


def byte_bucket(text: Column) -> Column:
    """Low byte of the FNV-1a hash of the UTF-8 bytes: begins at 197, (h xor byte) * 147 mod 256."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.aggregate(codes, F.lit(197), lambda h, b: (h.bitwiseXOR(b) * 147) % 256)


def key_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def code(text: Column) -> Column:
    """Trimmed upper case; blank becomes null."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def name_key(text: Column) -> Column:
    """Lower case without white space, dots, underscores, hyphens and quotes; 0 as o, $ as s."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\s._\-'\"`]", ""), "0$", "os")


def html_text(html: Column, passes: int = 8) -> Column:
    """Tags gone until none is left, angle brackets dropped, hard spaces and white space folded.

    Removing a tag can splice another one together; a text that passes sweeps do not settle is an error.
    """
    out = html
    for _ in range(passes):
        out = F.regexp_replace(out, r"<[^>]*>", "")
    settled = F.when(out.rlike(r"<[^>]*>"), F.raise_error(F.lit("tags are nested too deeply"))).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(settled, "[<>]", ""), "&#160;|&nbsp;|\u00a0", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\u000b]+", " "))


#: A day, or a range of days within or across months, with an optional year.
DAYS = r"([A-Z][a-z]{2})\s+(\d{1,2})(?:\s*[-\u2013]\s*(?:([A-Z][a-z]{2})\s+)?(\d{1,2}))?,?\s*(\d{4})?"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def event_end(text: Column, year: Column) -> Column:
    """The last day that a text names (of its last range), as YYYY-MM-DD; January of year where it names none."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(DAYS), F.lit(0)), F.lit(-1))
    part = lambda k: F.nullif(F.regexp_extract(last, DAYS, k), F.lit(""))
    found = F.when(F.size(F.regexp_extract_all(text, F.lit(DAYS), F.lit(0))) > 0, last)
    number = lambda k: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(k)), F.lit(0).cast("long"))
    month = F.coalesce(number(3), number(1))
    day = F.concat_ws("-", F.coalesce(part(5), year.cast("string")), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.coalesce(part(4), part(2)), 2, "0"))
    return F.when(found.isNotNull() & month.isNotNull(), day).otherwise(F.concat(year.cast("string"), F.lit("-01")))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds; null if none."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def highlight(local: Column, field: Column, local_n: Column, field_n: Column, least: float) -> Column:
    """How far a value stands out from its field, 0.15 to 1; null on small samples."""
    bound = F.greatest(F.lit(least), 0.35 * F.abs(field))
    gap = F.abs(local - field) / bound
    return F.when((local_n >= 10) & (field_n >= 25), F.least(F.lit(1.0), 0.15 + F.greatest(F.lit(0.0), gap - 1) * 0.425))


def odds(coefficient: Column) -> Column:
    """Factor on the odds per standard deviation."""
    return F.exp(coefficient)


def probability_points(coefficient: Column) -> Column:
    """About how many points of probability a standard deviation is worth near one half."""
    return coefficient / 4 * 100


def optional_count(family: Column, key: str, most: int | None = None) -> Column:
    """A counter out of a map: null if the map is missing or the count invalid, 0 if the map lacks the key."""
    n = F.coalesce(family[key], F.lit(0))
    fine = (n >= 0) & (n <= most) if most is not None else n >= 0
    return F.when(family.isNotNull() & fine, n)


def interaction_rates(df: DataFrame, keys: list[str], option: list[str]) -> DataFrame:
    """Shares and rates of outcome counters (attempts, punished, hit, traded, incomplete); unfinished attempts are no base."""
    done = F.col("attempts") - F.col("incomplete")
    share = F.col("attempts") / F.sum("attempts").over(Window.partitionBy(*keys))
    none = done - F.col("punished") - F.col("hit") - F.col("traded")
    return df.select(*keys, *option, share.alias("usage_share"), ratio(F.col("punished") + F.col("traded"), done).alias("caught_rate"), ratio(F.col("hit") + F.col("traded"), done).alias("landed_rate"), ratio(none, done).alias("no_hit_rate"))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order and no blanks; null fields stay."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def reliability_bucket(p: Column) -> Column:
    """Confidence of the favoured side in fifths, the last one closed."""
    return F.least(F.lit(4), F.floor((F.greatest(p, 1 - p) - 0.5) * 10)).cast("int")


def tech_totals(in_place: Column, toward: Column, away: Column, missed: Column, wall: Column) -> list[Column]:
    """ground successes, ground attempts, and successes of all kinds."""
    ground = in_place + toward + away
    return [ground.alias("ground"), (ground + missed).alias("attempts"), (ground + wall).alias("every")]
