"""Quality classifier from weak labels.

Overlapping heuristic labellers vote keep, reject or abstain on each document.  Those for one defect only
reject or abstain: the absence of one defect says nothing of another.  Expectation-maximisation
over the table of vote patterns (counted over all documents) estimates each labeller's accuracies and every
pattern's posterior, per facet (symbols, shouting, repetition, abuse): four labellers judge each of them, and
a document is rejected for any.  No accuracy is given beforehand; each estimate begins with one vote of each kind.
Posteriors of a bounded sample (SAMPLE documents, chosen by hash) train a hashed linear scorer, which judges every
document.

The words of abuse are learnt from a bounded sample of labels (LABELLED, chosen by hash): words whose share of toxic
documents is SHARE or more and by a Chernoff bound, corrected for the number of words, no accident; no word is given beforehand, so
without labels nothing is judged abusive.  Four labellers judge the same texts by them: any such word, DENSE or more of
the text's words, TOGETHER or more different ones, and any of the surer half by the bound.  Nothing else uses a true
label.  Null labels and those of absent documents count for nothing, and of several labels of a document the toxic
one holds.

Copies are no evidence of their own: of the sampled texts of one label (for the words), and of the sampled documents
of one posterior (for the scorer), that are near copies of each other (by a min-hash sketch) one counts.

Features are presence bits of words, hashed to BITS bits, and bins of the text's shape.  The scorer weighs those
alone that LEAST_DOCS sample documents have and whose link with the posteriors is, corrected for their number, no
accident; without this screen the noise of rare words rejects clean documents.

Defined results: an empty text has no features and no votes; a null text is empty; an empty table gives an empty
result; every row is judged on its own, so copies get equal scores and repeated rows stay apart.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import Recent, arrow_rows, documents, forget, materialize, mix, pack, read, remembered, unpack
from matchlake.llm.simhash import shingle_hashes

SAMPLE = 20_000
LABELLED = 20_000
SHARE = 0.8
#: Near copies: least share of equal sketch values, of shingles and of features; bins of a sketch, values of a band.
ALIKE, ALIKE_FEATURES, BINS, BAND = 0.5, 0.7, 128, 3
BITS = 18
LEAST_DOCS = 20
THRESHOLD = 0.5
KEEP, REJECT, ABSTAIN = "k", "r", "-"

#: Least share of abusive words, and least number of different ones, for their labellers.
DENSE, TOGETHER = 0.01, 2
#: Labellers by what they judge; the first one, which votes keep on prose, has a say in every facet of form.
FACETS = ((0, 1, 2, 3), (0, 4, 5, 6), (0, 7, 8, 9), (10, 11, 12, 13))
_STRIP = b".,;:!?*%$&#|~\"'()[]{}<>=+-_/\\@^`"
_SYMBOLS = b"*%$&#|~^=<>{}\\"
_MASK = (1 << BITS) - 1


def shape(raw: bytes, words: list[bytes], counts: dict[bytes, int], known: list[tuple]) -> dict[str, float]:
    """known: _cleaned of each distinct word, in the order of counts."""
    n = max(len(words), 1)
    shouting = stops = marked = small = 0
    for (_, _, shout, stop, mark, low), c in zip(known, counts.values(), strict=True):
        shouting += c * shout
        stops += c * stop
        marked += c * mark
        small += c * low
    return {
        "symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) / max(len(raw), 1),
        "marked": marked / n,
        "bars": counts.get(b"|", 0) / n,
        "shouting": shouting / n,
        "small": small / n,
        "bangs": raw.count(b"!!") / n,
        "repeats": sum(map(operator.eq, words, words[1:])) / n,
        "variety": len(counts) / n,
        "top": max(counts.values(), default=0) / n,
        "stops": stops / n,
    }


def votes(s: dict[str, float], abuse: tuple[int, int, bool], n: int) -> str:
    """One letter per labeller. abuse: abusive words, different ones, and whether a sure one is among them; n: words."""
    said, different, sure = abuse
    over = lambda x, bad: REJECT if x > bad else ABSTAIN
    out = [
        KEEP if 0.02 < s["stops"] < 0.4 else ABSTAIN,
        over(s["symbols"], 0.05),
        over(s["marked"], 0.15),
        over(s["bars"], 0.1),
        over(s["shouting"], 0.25),
        REJECT if n >= 10 and s["small"] < 0.3 else ABSTAIN,
        over(s["bangs"], 0.15),
        over(s["repeats"], 0.2),
        REJECT if n >= 50 and s["variety"] < 0.2 else ABSTAIN,
        REJECT if n >= 50 and s["top"] > 0.2 else ABSTAIN,
        over(said, 0),
        REJECT if said and said >= DENSE * n else ABSTAIN,
        REJECT if different >= TOGETHER else ABSTAIN,
        REJECT if sure else ABSTAIN,
    ]
    return "".join(out) if n else ABSTAIN * len(out)


def _cleaned(word: bytes) -> tuple[str, int, bool, bool, bool, bool]:
    """Bare word, its hash, is it all capitals, does a full stop or comma end it, has it a symbol, or small letters?"""
    w, t = word.strip(_STRIP).lower(), word.decode(errors="replace")
    shout = len(word) > 2 and t.isupper() and t != t.lower()
    return w.decode(errors="replace"), zlib.crc32(w) & _MASK, shout, word.endswith((b".", b",")), len(word.translate(None, _SYMBOLS)) < len(word), t != t.upper()


def read_text(text: str, abusive: dict[str, bool] | None = None) -> tuple[str, dict[str, float], list[tuple]]:
    """Votes, shape and distinct words. abusive: words, and whether each is a sure one."""
    clean = remembered("words", lambda: Recent(_cleaned))
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    known = [clean[w] for w in counts]
    s = shape(raw, words, counts, known)
    said = Counter()
    if abusive:
        for k, c in zip(known, counts.values(), strict=True):
            if k[0] in abusive:
                said[k[0]] += c
    held = said.keys()
    s["abuse"] = min(len(held), 4) / 20  # one bin per word
    return votes(s, (said.total(), len(held), any(abusive[w] for w in held) if held else False), len(words)), s, known


def features(text: str, abusive: dict[str, bool] | None = None) -> tuple[str, np.ndarray]:
    """Votes, and the hashed features in ascending order."""
    pattern, s, known = read_text(text, abusive)
    bins = [zlib.crc32(f"\t{k}:{min(int(v * 20 + 1e-9), 20)}".encode()) & _MASK for k, v in s.items()] if known else []
    return pattern, np.unique(np.array([k[1] for k in known if k[0]] + bins, np.uint32))


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-12))


def combined(patterns: dict[str, int]) -> dict[str, float]:
    """Chance of reject for each vote pattern: for any facet."""
    keep = dict.fromkeys(patterns, 1.0)
    for facet in FACETS:
        own = {p: "".join(p[j] for j in facet) for p in patterns}
        part: dict[str, int] = {}
        for p, n in patterns.items():
            part[own[p]] = part.get(own[p], 0) + n
        post, _ = posteriors(part)
        keep = {p: k * (1 - post[own[p]]) for p, k in keep.items()}
    return {p: 1 - k for p, k in keep.items()}


def posteriors(patterns: dict[str, int], rounds: int = 500) -> tuple[dict[str, float], np.ndarray]:
    """Chance of reject for each vote pattern, and each labeller's table P(vote | class).

    Begins at patterns with any reject vote being rejects; votes are independent given the class.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    v = np.array([[(KEEP, REJECT, ABSTAIN).index(c) for c in p] for p in names])
    r = np.array([0.95 if REJECT in p else 0.001 for p in names])
    for _ in range(rounds):
        prior = float(np.clip((n * r).sum() / n.sum(), 1e-6, 1 - 1e-6))
        table = np.zeros((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            kinds = [(v[:, j] == 0).any(), True, True]  # a labeller's own kinds of votes
            for c, w in enumerate((n * (1 - r), n * r)):
                got = np.bincount(v[:, j], w, 3) + kinds
                table[j, c] = got / got.sum()
        each = [sum(_logs(table[j, c])[v[:, j]] for j in range(v.shape[1])) for c in (0, 1)]
        gap = np.clip(each[0] + np.log(1 - prior) - each[1] - np.log(prior), -60, 60)
        new = 1 / (1 + np.exp(gap))
        if np.abs(new - r).max() < 1e-9:
            break
        r = new
    return dict(zip(names, r.tolist(), strict=True)), table


def screened(rows: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Which features enough documents have, with a mean posterior that differs by more than chance allows."""
    n, y = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for x, posterior in rows:
        n[x] += 1
        y[x] += posterior
    mean = min(max(sum(p for _, p in rows) / max(len(rows), 1), 1e-6), 1 - 1e-6)
    enough = n >= min(LEAST_DOCS, max(2, len(rows) // 50))
    x = np.clip(y / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    gap = n * (x * np.log(x / mean) + (1 - x) * np.log((1 - x) / (1 - mean)))  # Chernoff: chance of it at most exp(-gap)
    return enough & (gap > math.log(max(enough.sum(), 2)) + 2)


def train(rows: list[tuple[np.ndarray, float]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad, documents in a fixed order."""
    usable = screened(rows)
    weight, power, bias, bias_power = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    rows = [(x[usable[x]], y) for x, y in rows]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weight[x].sum() + bias, -30, 30))) - y
            own = g + decay * weight[x]
            power[x] += own * own
            weight[x] -= rate * own / np.sqrt(power[x])
            bias_power += g * g
            bias -= rate * g / np.sqrt(bias_power)
    return weight.astype(np.float32), float(bias)


def typical(counts: list[tuple[str, int, int]], toxic: int, clean: int, words: int) -> dict[str, bool]:
    """Words of toxic documents from (word, toxic documents, clean ones that hold it); words: how many there are in all.

    With each word, whether its evidence is no less than the median of theirs.
    """
    if not toxic or not clean:
        return {}
    base, needed = toxic / (toxic + clean), math.log(max(words, 2))
    if base >= SHARE:
        return {}

    def gap(t: int, n: int) -> float:
        x = t / (t + n)
        return (t + n) * (x * math.log(x / base) + ((1 - x) * math.log((1 - x) / (1 - base)) if n else 0.0))

    found = {w: gap(t, n) for w, t, n in counts if w and t >= SHARE * (t + n) and gap(t, n) > needed}
    middle = float(np.median([*found.values()])) if found else 0.0
    return {w: g >= middle for w, g in found.items()}


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(text.encode().lower().split()))


def _sketch(h: np.ndarray) -> np.ndarray:
    """The least of ascending distinct hashes in each of BINS equal ranges; an empty range takes the next one's."""
    if not len(h):
        return np.zeros(BINS, np.uint64)
    held, first = np.unique(h >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    after = np.searchsorted(held, np.arange(BINS, dtype=np.uint64)) % len(held)
    steps = (held[after].astype(np.int64) - np.arange(BINS)) % BINS  # a value carried further is another value
    return h[first[after]] + steps.astype(np.uint64)


def sketch(text: str) -> np.ndarray:
    """Min-hash of the text's three-word shingles."""
    return _sketch(np.unique(shingle_hashes(text, 3)))


def one_of_copies(rows: list[tuple[int, np.ndarray, float]]) -> list[tuple[np.ndarray, float]]:
    """Features and posterior of the first of each group of near copies with posteriors on one side."""
    if not rows:
        return []
    sketches = np.stack([_sketch(np.unique(mix(x.astype(np.uint64)))) for _, x, _ in rows])
    first: dict[tuple[int, bool], int] = {}
    for i, c in enumerate(copy_classes(sketches, ALIKE_FEATURES).tolist()):
        first.setdefault((c, rows[i][2] > 0.5), i)
    return [rows[i][1:] for i in first.values()]


def copy_classes(sketches: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """A number for each sketch, equal for those chained by a share of alike or more of equal values."""
    root = np.arange(len(sketches))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, BINS - BAND + 1, BAND):
        keys = np.ascontiguousarray(sketches[:, at : at + BAND]).view(f"V{8 * BAND}").ravel()
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1 if len(order) else []
        for a, b in zip([0, *cuts], cuts, strict=False):
            rest = order[a:b]
            while len(rest) > 1:
                near = (sketches[rest[1:]] == sketches[rest[0]]).mean(axis=1) >= alike
                for i in rest[1:][near].tolist():
                    x, y = sorted((find(i), find(int(rest[0]))))
                    root[y] = x
                rest = rest[1:][~near]
    return np.array([find(i) for i in range(len(root))], np.int64)


def learn_words(df: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict[str, bool]:
    """typical of a sample of at most 2 * most labelled documents (labels: doc_id, toxic)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every = max(1, -(-own.count() // most))
    chosen = F.broadcast(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most))
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def draw(batches):
        out = pa.schema([("digest", pa.string()), ("toxic", pa.int32()), ("sketch", pa.binary())])
        for batch in batches:
            rows = list(dict.fromkeys((_digest(t), x, sketch(t).tobytes()) for _, t, x in arrow_rows(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, out, strict=True)], schema=out)

    labelled = documents(df).join(chosen, "doc_id").select("doc_id", "text", "toxic")
    drawn = labelled.mapInArrow(draw, "digest string, toxic int, sketch binary").groupBy("digest", "toxic").agg(F.first("sketch").alias("sketch"))
    texts = drawn.orderBy("digest", "toxic").limit(4 * most).collect()
    classes = copy_classes(np.frombuffer(b"".join(bytes(r["sketch"]) for r in texts), np.uint64).reshape(len(texts), BINS))
    first: dict[tuple[int, bool], tuple[str, int]] = {}
    for r, c in zip(texts, classes.tolist(), strict=True):
        first.setdefault((c, r["toxic"] != 0), (r["digest"], r["toxic"]))
    once = df.sparkSession.sparkContext.broadcast(frozenset(first.values()))

    def pick(batches):
        for batch in batches:
            rows = [(g, t, x) for _, t, x in arrow_rows(batch) if ((g := _digest(t)), x) in once.value]
            yield pa.RecordBatch.from_pydict({"digest": [r[0] for r in rows], "text": [r[1] for r in rows], "toxic": [r[2] for r in rows]}, pa.schema([("digest", pa.string()), ("text", pa.string()), ("toxic", pa.int32())]))

    def count(batches):
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in arrow_rows(batch):
                seen[not toxic].update({k[0] for k in read_text(text)[2]} - {""})
                seen[not toxic][""] += 1  # counts the documents
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"word": words, "toxic": [seen[0][w] for w in words], "clean": [seen[1][w] for w in words]}, schema)

    marked = labelled.mapInArrow(pick, "digest string, text string, toxic int").dropDuplicates(["digest", "toxic"]).select("text", "toxic")
    totals = marked.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = materialize(totals, "word_counts")
    n = totals.count()
    toxic, clean = (totals.where("word = ''").select("toxic", "clean").first() or (0, 0)) if n else (0, 0)
    # the rest cannot pass; what is left is bounded by the sample
    kept = totals.where((F.col("toxic") >= 2) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean"))) & (F.col("word") != ""))
    return typical([tuple(r) for r in kept.collect()], toxic, clean, n)


def read_documents(df: DataFrame, abusive: dict[str, bool]) -> DataFrame:
    """doc_id, votes and packed features of every document: the one pass over the texts."""
    listed = df.sparkSession.sparkContext.broadcast(abusive)
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = [(d, *features(t, listed.value)) for d, t in arrow_rows(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "votes": [r[1] for r in rows], "x": [pack(r[2], True) for r in rows]}, schema)

    return documents(df).mapInArrow(run, "doc_id long, votes string, x binary")


def fit(marked: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, dict[str, float]]:
    """Weights, bias and posterior per vote pattern, from read_documents."""
    patterns = {p: c for p, c in marked.groupBy("votes").agg(F.count("*")).collect()}  # at most 2 ** labellers
    post = combined(patterns)
    every, h = max(1, -(-sum(patterns.values()) // sample)), F.xxhash64("doc_id", "x")
    chosen = marked.where(F.pmod(h, F.lit(every)) == 0).orderBy(h, "doc_id").limit(2 * sample).collect()
    rows = sorted(((r["doc_id"], bytes(r["x"]), post[r["votes"]]) for r in chosen))
    weight, bias = train(one_of_copies([(d, unpack(x, True), y) for d, x, y in rows]))
    return weight, bias, post


def classify(df: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, votes, posterior and score (both: chance of reject), keep. labels: doc_id, toxic (optional)."""
    words = learn_words(df, labels) if labels is not None else {}
    marked = materialize(read_documents(df, words), "votes")
    shared = df.sparkSession.sparkContext.broadcast(fit(marked, sample))

    def judge(batches):
        forget()
        weight, bias, post = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])
        for batch in batches:
            out = []
            for doc_id, pattern, x in arrow_rows(batch):
                score = float(1 / (1 + np.exp(-np.clip(weight[unpack(x, True)].sum() + bias, -30, 30))))
                out.append((doc_id, pattern, post.get(pattern), score, score < threshold))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    return marked.mapInArrow(judge, "doc_id long, votes string, posterior double, score double, keep boolean")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), labels=read(spark, sf_dir, "labels"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
