"""Secret scans, in DataFrame functions only.

Base kinds are found by pattern.  Beyond them, every long token takes a randomness battery in the
encoding inferred from its symbols, each test against the null hypothesis "structured text":

* chi-squared uniformity over the alphabet: under the null the statistic is noncentral, with a noncentrality
  that grows with the length (n times alphabet times the coincidence rate of such text, less n);
* runs: the number of word-like stretches (a capital and small letters, capitals, digits; separators go with what
  follows).  Structured tokens begin one every four symbols (five, with letters of one case), random ones of several classes nearly every two;
* order: a runs test about the alphabet's middle and lag-1 serial correlation against randomness, so that tokens
  such as counted alphabets, which are uniform but ordered, are no candidates.

Fisher's method combines the first two where the token has several classes of symbols.  Benjamini-Hochberg at RATE,
in each class of length and encoding, picks the discoveries.  The class thresholds come from a histogram of a
fixed number of cells over all documents.

Offsets of matches are running sums over the pieces between them, taken in chunks, so the work grows with the text.
Defined results: a null text is empty; tokens that overlap a base span add nothing; offsets are code points with an
exclusive end; columns named base or found are replaced, and all others stay; repeated rows are scanned each; an
empty table gives an empty result; a text's own U+FFFF may join the tokens beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import documents, read

# The base patterns with the group whose length counts and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")  # every assign match holds one, in lower case
_M = "\uffff"  # stands for each code point of an assign span while tokens are looked for
TOKEN = f"(?<![A-Za-z0-9+/_{_M}-])[A-Za-z0-9+/_{_M}-]{{20,}}"
STRETCH = "[+/_-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|$)"
STRETCHES, ONE_CASE = 0.25, 0.2  # of a structured token begin at this share of its symbols; letters of one case only
RATE, ORDER_LEVEL = 0.01, 0.001
LENGTHS = (20, 24, 32, 48, 64)
KINDS = 3  # of encodings: one class of symbols, several, several with separators
CELLS, PER_DECADE = 400, 20
CHUNK, PIECE = 256, 4096  # running sums and substrings work on so much at a time

# Encodings in the order tried: pattern, alphabet, coincidence rate of structured text in it.
_L, _U, _D = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("^[0-9]+$", _D, 0.16),
    ("^[0-9a-f]+$", _D + "abcdef", 0.10),
    ("^[0-9A-F]+$", _D + "ABCDEF", 0.10),
    ("^[a-z]+$", _L, 0.066),
    ("^[A-Z]+$", _U, 0.066),
    ("^[A-Z2-7]+$", _U + "234567", 0.06),
    ("^[a-z0-9]+$", _L + _D, 0.06),
    ("^[A-Z0-9]+$", _U + _D, 0.06),
    ("^[A-Za-z0-9]+$", _U + _L + _D, 0.045),
    ("^[A-Za-z0-9+/]+$", _U + _L + _D + "+/", 0.045),
    ("", _U + _L + _D + "-_+/", 0.045),
)

_SPAN = "struct<start: bigint, kind_no: int, stop: bigint, kind: string, value: string>"


def _running(values: Column, step) -> Column:
    """For each of the long values, what step makes of all before it (from 0), in chunks: no array grows long by steps."""
    n = F.size(values)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))
    zero = F.lit(0).cast("long")
    inner = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    each = F.transform(parts, lambda c: F.aggregate(c, inner, lambda a, x: F.struct(step(a["at"], x).cast("long").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))))
    outer = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    whole = F.aggregate(each, outer, lambda a, x: F.struct(step(a["at"], x["at"]).cast("long").alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda y: step(a["at"], y).cast("long")))).alias("out")))
    return F.when(n > 0, F.flatten(whole["out"])).otherwise(F.array().cast("array<bigint>"))


def find_all(text: Column, pattern: str, kind_no: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches: the pieces between them give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def spans(zipped: Column) -> Column:
        before = _running(F.transform(zipped, lambda x: (x["gap"] + F.char_length(x["m"])).cast("long")), lambda a, x: a + x)
        return F.zip_with(zipped, before, span)

    def span(x: Column, at: Column) -> Column:
        first = at + x["gap"]
        return F.struct(first.cast("long").alias("start"), F.lit(kind_no).alias("kind_no"), (first + F.char_length(x["m"])).cast("long").alias("stop"), F.lit(kind).alias("kind"), x["v"].alias("value"))

    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.char_length(x))
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("m"), value.alias("v")), lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), x["v"].alias("v")))
    return F.filter(_let(zipped, spans), lambda x: F.char_length(x["value"]) >= least)


def _masked(text: Column) -> Column:
    """The text with each code point of the assign spans replaced by _M."""
    found = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    shown = F.zip_with(found, value, lambda m, v: F.when(F.char_length(v) >= BASE[0][3], F.repeat(F.lit(_M), F.char_length(m))).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, ASSIGN, -1), shown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def _normal(z: Column) -> Column:
    """Normal distribution function, by the usual cubic logistic fit."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _let(value: Column, use) -> Column:
    """use(value), evaluating the value once."""
    return F.transform(F.array(value), use)[0]


def battery(token: Column) -> Column:
    """struct(kind, p, order_p): number of the encoding's kind, chance of such a token under structured text, Simes p of the order tests."""
    encoding = lambda e: F.struct(F.lit(e[1]).alias("alphabet"), F.lit(float(len(e[1]))).alias("k"), F.lit(e[2]).alias("rate"))
    chosen = reduce(lambda rest, e: F.when(token.rlike(e[0]), encoding(e)).otherwise(rest), reversed(ENCODINGS[:-1]), encoding(ENCODINGS[-1]))
    return _let(chosen, lambda e: _tests(token, e["alphabet"], F.char_length(token).cast("double"), e["k"], e["rate"]))


def _tests(token: Column, alphabet: Column, n: Column, k: Column, rate: Column) -> Column:
    counts = F.transform(F.split(alphabet, ""), lambda c: (n - F.char_length(F.replace(token, c, F.lit("")))))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    far = n * (k * rate - 1)
    even = _let((k / n * squares - n - (k - 1 + far)) / F.sqrt(2 * (k - 1 + 2 * far)), _normal)
    stretches = F.size(F.filter(F.regexp_extract_all(token, F.lit(STRETCH), F.lit(0)), lambda x: x != "")) - 1
    usual = F.when(token.rlike("[a-z]") & token.rlike("[A-Z]"), STRETCHES).otherwise(ONE_CASE)
    mixed = _let((stretches - usual * (n - 1)) / F.sqrt(usual * (1 - usual) * (n - 1)), lambda z: _normal(-z))
    classes = sum(token.rlike(x).cast("int") for x in ("[a-z]", "[A-Z]", "[0-9]"))
    kind = F.when(token.rlike("[^A-Za-z0-9]"), 2).when(classes > 1, 1).otherwise(0)
    both = _let(F.greatest(even * mixed, F.lit(1e-300)), lambda x: x * (1 - F.log(x)))  # Fisher, four degrees of freedom
    marks = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double") - 0.5)
    names = ("last", "runs", "cross", "high", "power")
    start = F.struct(*(F.lit(v).alias(x) for x, v in zip(names, (-1.0, 0.0, 0.0, 0.0, 0.0), strict=True)))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["last"] < 0) | ((a["last"] > k / 2) != (x > k / 2))
        cross = F.when(a["last"] < 0, 0.0).otherwise((a["last"] - k / 2) * (x - k / 2))
        new = (x, a["runs"] + F.when(fresh, 1.0).otherwise(0.0), a["cross"] + cross, a["high"] + F.when(x > k / 2, 1.0).otherwise(0.0), a["power"] + (x - k / 2) * (x - k / 2))
        return F.struct(*(c.alias(name) for name, c in zip(names, new, strict=True)))

    def order(w: Column) -> Column:
        two = 2 * w["high"] * (n - w["high"])
        spread = two * (two - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, F.abs(w["runs"] - two / n - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
        serial = F.when(w["power"] > 0, F.abs(w["cross"]) / w["power"] * F.sqrt(n)).otherwise(F.lit(99.0))
        worst, better = F.greatest(runs, serial), F.least(runs, serial)  # Simes: twice the smaller p, or the larger
        return F.least(4 * _let(-worst, _normal), 2 * _let(-better, _normal))

    return F.struct(kind.alias("kind"), F.when(classes > 1, both).otherwise(even).alias("p"), _let(F.aggregate(marks, start, step), order).alias("order_p"))


def _cell(p: Column) -> Column:
    return F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_DECADE))).cast("int")


def _class(length: Column, kind: Column) -> Column:
    return reduce(lambda rest, x: F.when(length >= x[1], F.lit(x[0])).otherwise(rest), enumerate(LENGTHS), F.lit(0)) * KINDS + kind


def thresholds(counted: list[tuple[int, int, int]], rate: float = RATE) -> list[int]:
    """Benjamini-Hochberg on (class, cell, tokens): per class the lowest cell whose members are discoveries."""
    least = []
    for c in range(len(LENGTHS) * KINDS):
        own, seen, lowest = {cell: n for k, cell, n in counted if k == c}, 0, CELLS
        for cell in sorted(own, reverse=True):
            seen += own[cell]
            if 10 ** (-cell / PER_DECADE) <= rate * seen / sum(own.values()):
                lowest = cell
        least.append(lowest)
    return least


def scan(df: DataFrame) -> DataFrame:
    """df with base (spans of the base kinds) and found (base and random ones), both sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Cheap signs decide which texts the patterns run over: keywords, and long pieces between spaces.
    small = F.lower(text)
    words = reduce(lambda a, b: a | b, (F.contains(small, F.lit(w)) for w in KEYWORDS))
    pieces = F.array_join(F.filter(F.split(text, " "), lambda x: F.char_length(x) >= 16), " ")
    df = df.drop("base", "found").withColumns({"_words": words, "_akia": F.contains(text, F.lit("AKIA")), "_long": pieces})
    signs = (F.col("_words"), F.col("_akia"), F.col("_long").rlike(BASE[2][1]))
    none = F.array().cast(f"array<{_SPAN}>")
    base = F.array_sort(F.concat(*(F.when(sign, find_all(text, p, i, kind, g, least)).otherwise(none) for i, (sign, (kind, p, g, least)) in enumerate(zip(signs, BASE, strict=True)))))
    masked = F.when(F.col("_words"), _masked(text)).otherwise(text)
    tokens = F.when(F.col("_long").rlike(TOKEN), _let(masked, lambda m: find_all(m, TOKEN, 3, "random", 0, LENGTHS[0]))).otherwise(none)
    # access and hex spans lie whole in one token
    free = F.filter(tokens, lambda t: ~(F.contains(t["value"], F.lit(_M)) | t["value"].rlike(BASE[1][1]) | t["value"].rlike(BASE[2][1])))
    judged = F.transform(free, lambda t: F.struct(t.alias("span"), battery(t["value"]).alias("test")))
    marked = df.withColumn("_scan", F.struct(base.alias("base"), judged.alias("tokens")))
    test = F.col("t.test")
    cells = marked.select(F.explode("_scan.tokens").alias("t")).where(test["order_p"] >= ORDER_LEVEL)
    counted = cells.groupBy(_class(F.char_length("t.span.value"), test["kind"]).alias("c"), _cell(test["p"]).alias("cell")).agg(F.count("*").alias("n")).collect()
    least = F.array(*map(F.lit, thresholds([tuple(r) for r in counted])))
    bound = lambda t: F.get(least, _class(F.char_length(t["span"]["value"]), t["test"]["kind"]))
    found = F.filter("_scan.tokens", lambda t: (t["test"]["order_p"] >= ORDER_LEVEL) & (_cell(t["test"]["p"]) >= bound(t)))
    return marked.withColumns({"base": F.col("_scan.base"), "found": F.array_sort(F.concat("_scan.base", F.transform(found, lambda t: t["span"])))}).drop("_scan", "_words", "_akia", "_long")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted; overlaps joined) replaced by the mark."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(p: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(p, first + 1, F.greatest(F.floor((b - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
        return F.substring(F.array_join(some, ""), (a % PIECE + 1).cast("int"), (b - a).cast("int"))

    def whole(p: Column) -> Column:
        reach = _running(F.transform(spans, lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
        shown = F.zip_with(spans, reach, lambda x, r: F.when((x["start"] >= r), F.concat(between(p, r, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda x: x["stop"]))
        return F.concat(F.array_join(shown, ""), between(p, end, F.char_length(text).cast("long")))

    return F.when(F.size(spans) > 0, _let(pieces, whole)).otherwise(text)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(read(spark, sf_dir, "documents")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLE_SQL: dict[str, str] = {}
