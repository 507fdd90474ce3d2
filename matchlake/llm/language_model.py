"""Language-model scoring by deleted interpolation.

A bigram maximum-likelihood estimate is mixed with the additively smoothed unigram one:

    P(w | v) = L[b] * c(v, w) / c(v) + (1 - L[b]) * (c(w) + 0.5) / (N + 0.5 * (V + 1)),   b = floor(log2 c(v))

Counts come from the training documents, and so do the weights L (one per context-frequency bucket): expectation-maximisation
on the training tokens with each token's own occurrence deleted from the counts, c(v, w) - 1 over c(v) - 1, so that what it
learns from was not seen by the estimate.  Held-out documents have no part in the model: their scores do not depend
on each other.  Contexts never seen have L = 0, so for every context the probabilities sum to one.  All counts cover all
documents and are exact.

Spark's share: documents become blocks of word numbers (training and held-out apart), each block sends
its distinct words and bigrams with their counts to hash ranges, where a Spark join adds them up and
answers every block.  A word occurs once per block however frequent it is, which is the map-side
combine; no range holds more than PER_BUCKET entries or so, and nothing that grows goes to the driver:
EM runs on a histogram of (bucket, log2 of bigram over unigram estimate), of a fixed number of cells.

Defined results: the empty text scores its end token alone; a bucket without training tokens has the weight
START; without training documents every token is unseen and N = V = 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import BEGIN, BLOCK_BYTES, END, arrow_rows, block_ids, crc32_text, documents, forget, materialize, mix, pack, parallelism, read, slices, unpack, word_hashes

PER_BUCKET = 1_000_000
PER_SORT = 1 << 16
START = 0.5
STEPS_PER_OCTAVE, LOW, HIGH = 8, -40, 80  # cells of the ratio histogram

_BLOCK = "block_id long, held_out boolean, docs binary, lengths binary, words binary, tokens binary, n_words long, n_pairs long, n_tokens long"
_REPLY = "block_id long, bucket int, kind int, r binary, distinct long"
_END, _BEGIN = word_hashes([END, BEGIN])


def _pairs(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its document."""
    own = words[ids]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(lengths) - lengths] = _BEGIN
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + own)


def blocks(df: DataFrame, held: int, folds: int) -> DataFrame:
    """Blocks of tokens as numbers into the block's own word list, most frequent first."""
    schema = pa.schema([("block_id", pa.int64()), ("held_out", pa.bool_()), ("docs", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("n_tokens", pa.int64())])

    def build(batches):
        ids = block_ids()
        open_ = {False: ([], [], [0]), True: ([], [], [0])}

        def row(is_held):
            docs, arrays, size = open_[is_held]
            lengths = np.array([len(a) for a in arrays], np.uint64)
            words, inverse, n = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens, words = rank[inverse], words[order]
            pairs = len(np.unique(_pairs(tokens, lengths.astype(np.int64), words)))
            out = {"block_id": next(ids), "held_out": is_held, "docs": np.array(docs, np.int64).tobytes(), "lengths": pack(lengths), "words": pack(words), "tokens": pack(tokens), "n_words": len(words), "n_pairs": pairs, "n_tokens": len(tokens)}
            open_[is_held] = ([], [], [0])
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in batches:
            for doc_id, text in (row for i in range(0, batch.num_rows, 512) for row in arrow_rows(batch.slice(i, 512))):
                is_held = crc32_text(doc_id) % folds == held
                words = text.encode().lower().split()
                words.append(END)
                docs, arrays, size = open_[is_held]
                docs.append(doc_id)
                arrays.append(word_hashes(words))
                size[0] += len(text) + 16
                if size[0] >= BLOCK_BYTES:
                    yield row(is_held)
        for is_held in (False, True):
            if open_[is_held][0]:
                yield row(is_held)

    return documents(df).mapInArrow(build, _BLOCK)


def _entries(own, kind: int):
    """Ascending distinct hashes of a block's words (1) or bigrams (2), with counts and places."""
    words, tokens = unpack(own["words"]), unpack(own["tokens"])
    if kind == 1:
        order = np.argsort(words)
        n = np.bincount(tokens, minlength=len(words))
        inverse = np.empty(len(words), np.int64)
        inverse[order] = np.arange(len(words))
        return words[order], n[order], inverse[tokens]
    keys, inverse, n = np.unique(_pairs(tokens, unpack(own["lengths"]).astype(np.int64), words), return_inverse=True, return_counts=True)
    return keys, n, inverse


def _adder(kind: int):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """Totals of a bucket's entries, in the order of its messages. The sort runs PER_SORT entries or so at a time."""
        forget()
        keys = [unpack(x, True) for x in pdf["keys"]]
        sizes = np.array([len(x) for x in keys])
        every = np.concatenate(keys)
        del keys
        total = np.empty(len(every), np.uint64)
        for x, end, size in zip(pdf["n"], np.cumsum(sizes), sizes, strict=True):
            total[end - size : end] = unpack(x)
        low, high, distinct = int(every.min()), int(every.max()), 0
        step = (high - low) // (len(every) // PER_SORT + 1) + 1
        for a in range(low, high + 1, step):
            at = np.flatnonzero((every >= np.uint64(a)) & (every <= np.uint64(min(a + step - 1, high))))
            at = at[np.argsort(every[at])]
            if len(at):
                s = every[at]
                first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                sums = np.add.reduceat(total[at], first)
                total[at] = np.repeat(sums, np.diff(np.append(first, len(s))))
                distinct += int((sums > 0).sum())
        return pd.DataFrame({"block_id": pdf["block_id"], "bucket": pdf["bucket"], "kind": kind, "r": [pack(x) for x in np.split(total, np.cumsum(sizes)[:-1])], "distinct": [distinct] + [0] * (len(sizes) - 1)})

    return add


def _totals(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    def send(batches):
        forget()
        schema = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for own in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                keys, n, _ = _entries(own, kind)
                n = np.zeros_like(n) if own["held_out"] else n
                yield pa.RecordBatch.from_pylist([{"bucket": b, "block_id": own["block_id"], "keys": pack(keys[i:j], True), "n": pack(n[i:j].astype(np.uint64))} for b, i, j in slices(keys, buckets)], schema)

    sent = table.select("block_id", "held_out", "lengths", "words", "tokens").mapInArrow(send, "bucket int, block_id long, keys binary, n binary")
    return sent.groupBy("bucket").applyInPandas(_adder(kind), _REPLY)


def _counts(pdf: pd.DataFrame):
    """Per token of the block: its count, that of its bigram and of its context, and the context's bucket."""
    own = pdf[pdf["kind"] == 0].iloc[0]

    def total(kind):
        got = pdf[pdf["kind"] == kind].sort_values("bucket")
        keys, _, inverse = _entries(own, kind)
        return np.concatenate([unpack(x) for x in got["r"]]).astype(np.int64)[inverse]

    lengths = unpack(own["lengths"]).astype(np.int64)
    c, cc = total(1), total(2)
    starts = np.cumsum(lengths) - lengths
    context = np.empty_like(c)
    context[1:] = c[:-1]
    context[starts] = c[starts + lengths - 1]  # as many beginnings as ends: the end token's count
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int8) + 1, 0).astype(np.int8)
    return own, lengths, starts, c, cc, context, bucket


def fit_weights(cells: list[tuple[int, int | None, int]], rounds: int = 200) -> dict[int, float]:
    """EM of each bucket's weight on its histogram of log2(bigram / unigram estimate)."""
    by: dict[int, list[tuple[float, int]]] = {}
    for bucket, cell, n in cells:
        by.setdefault(bucket, []).append((0.0 if cell is None else 2.0 ** ((cell + 0.5) / STEPS_PER_OCTAVE), n))
    out = {}
    for bucket, rows in by.items():
        ratio, n, weight = np.array([r for r, _ in rows]), np.array([x for _, x in rows], float), START
        for _ in range(rounds):
            new = float((n * weight * ratio / (weight * ratio + 1 - weight)).sum() / n.sum())
            if abs(new - weight) < 1e-9:
                break
            weight = min(max(new, 1e-6), 1 - 1e-6)
        out[bucket] = weight
    return out


def score(df: DataFrame, held: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = df.sparkSession
    table = materialize(blocks(df, held, folds), "tokens")
    size = table.agg(F.sum("n_words"), F.sum("n_pairs"), F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0))).first()
    few = max(parallelism(spark), 1)
    buckets = {kind: max(few, math.ceil((size[kind - 1] or 0) / PER_BUCKET)) for kind in (1, 2)}
    n_all = int(size[2])
    totals = materialize(_totals(table, 1, buckets[1]).unionByName(_totals(table, 2, buckets[2])), "totals")
    distinct = int(totals.where("kind = 1").agg(F.sum("distinct")).first()[0] or 0)
    own = table.withColumn("kind", F.lit(0)).drop("n_words", "n_pairs", "n_tokens")
    joined = own.unionByName(totals.select("block_id", "bucket", "kind", "r"), allowMissingColumns=True)

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        _, _, _, c, cc, context, bucket = _counts(pdf)
        uni = (c - 0.5) / (n_all - 1 + 0.5 * (distinct + 1))
        bi = np.divide(cc - 1, context - 1, out=np.zeros(len(c)), where=context > 1)
        with np.errstate(divide="ignore"):
            at = np.clip(np.floor(np.log2(bi / uni) * STEPS_PER_OCTAVE), LOW * STEPS_PER_OCTAVE, HIGH * STEPS_PER_OCTAVE).astype(np.int64)
        at[bi == 0] = LOW * STEPS_PER_OCTAVE - 1
        width = (HIGH - LOW) * STEPS_PER_OCTAVE + 2
        flat = bucket.astype(np.int64) * width + at - (LOW * STEPS_PER_OCTAVE - 1)
        n = np.bincount(flat[bucket > 0], minlength=1)
        which = np.flatnonzero(n)
        return pd.DataFrame({"bucket": which // width, "cell": which % width + LOW * STEPS_PER_OCTAVE - 1, "n": n[which]})

    training = table.where("NOT held_out").select("block_id")
    part = joined.join(training, "block_id", "left_semi")
    found = part.groupBy("block_id").applyInPandas(cells, "bucket long, cell long, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights([(r["bucket"], None if r["cell"] < LOW * STEPS_PER_OCTAVE else r["cell"], r["n"]) for r in sorted(found)])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        row, lengths, starts, c, cc, context, bucket = _counts(pdf)
        uni = (c + 0.5) / (n_all + 0.5 * (distinct + 1))
        bi = np.divide(cc, context, out=np.zeros(len(c)), where=context > 0)
        weight = np.array([0.0, *(weights.get(b, START) for b in range(1, 65))])[bucket]
        base, mixed = np.log10(uni), np.log10(weight * bi + (1 - weight) * uni)
        return pd.DataFrame({"doc_id": np.frombuffer(row["docs"], np.int64), "held_out": bool(row["held_out"]), "n_tokens": lengths, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": n_all, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(mixed, starts)})

    return joined.groupBy("block_id").applyInPandas(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
