"""Names, codes and texts of the record world as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mode_of_match(match_id: Column) -> Column:
    """Game mode from a match id: none is an offline game."""
    has = lambda x: F.contains(match_id, F.lit(x))
    return F.when(match_id.isNull(), "offline").when(has("mode.ranked"), "ranked").when(has("mode.unranked"), "unranked").when(has("mode.direct"), "direct").otherwise("unknown")


# Suffixes of broadcast bundles, and what names brackets and friendlies in a path.
ARCHIVE = r"(?i)\.(?:7z|zip)$"
BROADCAST_SUFFIX = r"(?i)-(?:main-stream|streams?|top-8|r2-offstream)$"
BROADCAST_BUNDLE = r"(?i)-(?:main-stream|streams?|top-8|r2-offstream)\.(?:7z|zip)$"
BRACKET_PATH = r"(?i)(?:^|[/\\ _-])(?:bracket|pools?|top[-_ ]?\d+|stream|broadcast)(?:$|[/\\ _-])"
FRIENDLY_PATH = r"(?i)(?:^|[/\\ _-])(?:friendlies?|warm[-_ ]?ups?|hand[-_ ]?warmers?|casuals?)(?:$|[/\\ _-])"


def event_of_bundle(name: Column) -> Column:
    """Bundle name without its archive suffix and then its broadcast suffix."""
    return F.regexp_replace(F.regexp_replace(name, ARCHIVE, ""), BROADCAST_SUFFIX, "")


def path_evidence(bundle: Column, path: Column) -> dict[str, Column]:
    """What a bundle's name and a file's path tell: broadcast_bundle, bracket_path, broadcast (either) and friendly."""
    stream, bracket = bundle.rlike(BROADCAST_BUNDLE), path.rlike(BRACKET_PATH)
    return {"broadcast_bundle": stream, "bracket_path": bracket, "broadcast": stream | bracket, "friendly": path.rlike(FRIENDLY_PATH)}


def move_group(move: Column) -> Column:
    """Public category of a raw move number."""
    # Raw move numbers and their categories.
    single = {6: "dash", 7: "ftilt", 8: "utilt", 9: "dtilt", 10: "fsmash", 11: "usmash", 12: "dsmash", 13: "nair", 14: "fair", 15: "bair", 16: "uair", 17: "dair", 18: "neutral-b", 19: "side-b", 20: "up-b", 21: "down-b", 52: "pummel", 53: "fthrow", 54: "bthrow", 55: "uthrow", 56: "dthrow"}
    out = F.when(move.between(2, 5), "jab").when(move.isin(50, 51), "getup").when(move.isin(61, 62), "edge")
    for number, name in single.items():
        out = out.when(move == number, name)
    return F.when(move.isNotNull(), out.otherwise("other"))


def effective_day(start: Column, replay: Column, year: Column) -> Column:
    """The sourced start, else the replay's day if it is of the event's year, else the last day of that year."""
    return F.coalesce(F.to_date(start), F.when(F.year(replay) == year, F.to_date(replay)), F.make_date(year, F.lit(12), F.lit(31)))


def zoned(text: Column) -> Column:
    """The instant of a text that states its zone; null without one."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.to_timestamp(text))


def tier(labels: Column) -> Column:
    """The one tier that an array of labels agrees on; null on none or on conflict."""
    found = F.array_distinct(F.filter(F.transform(labels, lambda x: F.regexp_extract(F.lower(x), r"^(platinum|diamond|master) player$", 1)), lambda x: x != ""))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def template_fields(text: Column, name: str) -> Column:
    """The field texts of each {{name|a|b}} template of a wikitext, as an array of arrays."""
    bodies = F.regexp_extract_all(text, F.lit(r"\{\{" + name + r"\|([^{}]*)\}\}"), F.lit(1))
    return F.transform(bodies, lambda b: F.transform(F.split(b, r"\|"), lambda x: F.trim(x)))


def earnings(text: Column) -> Column:
    """The amount of the first $ figure with its commas taken out; null if there is none."""
    found = F.regexp_extract(text, r"\$([0-9][0-9,]*)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).cast("long"))


def clock(seconds: Column) -> Column:
    """m:ss."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((F.floor(seconds) % 60).cast("string"), 2, "0"))


def identity(code: Column, uid: Column, display: Column, event: Column, tag: Column) -> Column:
    """Private identity: code, else hashed uid, else display name, else a tag within its event."""
    return F.coalesce(code, F.concat(F.lit("u:"), F.substring(F.sha2(uid, 256), 1, 16)), F.concat(F.lit("d:"), display), F.concat(F.lit("n:"), event, F.lit(":"), tag))


def roster(sides: Column) -> Column:
    """Sorted members inside each side, sides sorted and joined by vs; null if any member is unknown."""
    unknown = F.exists(F.flatten(sides), lambda x: x.isNull())
    joined = F.array_join(F.array_sort(F.transform(sides, lambda s: F.array_join(F.array_sort(s), "+"))), " vs ")
    return F.when(~unknown, joined)


def major_key(name: Column, year: Column) -> Column:
    """Letters and digits of a title in lower case, with its year."""
    return F.concat_ws(":", F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), year.cast("string"))


def strict_alias(text: Column) -> Column:
    """Trimmed, compatibility-composed (NFKC) and lower-cased; Spark has no such function."""

    @F.pandas_udf("string")
    def compose(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFKC", x.strip()).lower(), na_action="ignore")

    return compose(text)


def normal_upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, by the usual five-term polynomial."""
    t = 1 / (1 + 0.2316419 * z)
    # Coefficients of the published approximation.
    terms = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153)
    sum_ = F.lit(0.0)
    for c in terms:
        sum_ = (sum_ + c) * t
    return 0.3989422804 * F.exp(-z * z / 2) * sum_


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_upper_tail(F.abs(z)))


def seed_hash(text: Column) -> Column:
    """FNV-1a over code points, 32 bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * 16777619 % 4294967296)


def _imul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, by halves, so that no 64-bit product overflows."""
    low, high = b % 65536, F.shiftrightunsigned(b, 16)
    return (a * low + (a * high % 65536) * 65536) % 4294967296


def counted_random(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) of the generator that adds 0x6D2B79F5 to its seed and mixes; no state is carried."""
    state = (seed + n.cast("long") * 1831565813) % 4294967296
    v = _imul(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    w = v.bitwiseXOR((v + _imul(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61)))) % 4294967296)
    return w.bitwiseXOR(F.shiftrightunsigned(w, 14)) / 4294967296.0


def box_muller(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * v)
