"""Substring dedup on a compacted word de Bruijn graph.

The edges of the graph are the windows of ``k`` consecutive words, its nodes the ``k - 1`` words between two of
them.  An edge is *repeated* when its words occur in more than one document.  A node branches where the edge
before it has several successors or the edge after it several predecessors, counted over all documents, the
ends of documents being neighbours of their own.  Repeated edges that meet in nodes without branches are one
*path*; it occurs in all documents that hold any edge of it, whole each time.  A path's source is the smallest
``doc_id`` that holds it, and the words of all its later occurrences go.

1. *anchors*: each window elects the smallest hash among its sub-windows of ``k // 2 + 1`` words.
   Equal windows elect equal anchors, about a quarter of the positions are elected; an exchange by hash
   ranges finds those that occur in two or more documents.  No other window can be repeated.
2. *junctions*: windows with such an anchor travel as 64-bit keys with the word before and after and the
   smallest document of the block; the answer is whether the edge is repeated, has an older document, several
   successors, several predecessors.
3. *compaction*: a document is walked along its repeated edges and cut at branching nodes.  Equal paths are put
   together by their words, byte for byte: an aggregation gives each path its source coordinates and a Spark join
   carries them to all occurrences.  So every span that goes has been verified against the words at its source.
4. Should hashes collide, edges look repeated or paths unbroken that are not.  Then a path is found without the
   older document that one of its edges has; the single windows of such paths are joined by their words once more,
   so no collision removes a word or keeps one.

A hash or a path occurs once per block of documents, however often it occurs in the block, so a passage that a
third of all documents hold costs one entry per block and never a pair per occurrence.  A block sends one message
to each hash range that it has entries for, so there are never more messages than entries; short ones are sent
uncompressed.

Defined results: texts of fewer than ``k`` words lose nothing; null texts have no words; of identical documents
the one with the smallest ``doc_id`` stays whole; documents that share a ``doc_id`` never delete each other's
words; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import (
    BLOCK_BYTES,
    arrow_rows,
    block_ids,
    documents,
    forget,
    materialize,
    pack,
    parallelism,
    read,
    rolling,
    slices,
    unpack,
    word_hashes,
)

WINDOW = 13
PER_BUCKET = 2_000_000
BYTES_PER_ANCHOR = 24  # four words of six bytes: how many hash ranges to deal to is all that this decides
MANY = 0  # several successors or predecessors; the ends of documents are 1

_BLOCK = "block_id long, docs binary, sizes binary, blob binary, bytes long"
_SENT = "bucket int, block_id long, keys binary, before binary, after binary, doc binary, several binary, docs binary"
_REPLY = "block_id long, bucket int, kind int, r binary"
_PATH = "block_id long, words string, n long, doc_id long, start long, older long, docs binary, places binary, starts binary"


def _runs(texts: list[bytes], k: int, anchor: int):
    """Per document with a window: index, word hashes, and the anchor hash of each window."""
    for i, text in enumerate(texts):
        words = text.split()
        if len(words) >= k:
            h = word_hashes(words)
            a = rolling(h, anchor)
            least = a[: len(h) - k + 1].copy()
            for j in range(1, k - anchor + 1):
                np.minimum(least, a[j : j + len(least)], out=least)
            yield i, h, least


def _texts(sizes: bytes, blob: bytes) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(blob) if blob else b"", np.cumsum(unpack(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def blocks(df: DataFrame) -> DataFrame:
    """Documents in blocks of about 4 MB, in the order they are read."""

    def build(batches):
        ids, block = block_ids(), []

        def row(part):
            part.sort(key=lambda x: x[0])
            texts = [x[1] for x in part]
            return {
                "block_id": next(ids),
                "docs": np.array([x[0] for x in part], np.int64).tobytes(),
                "sizes": pack(np.array([len(t) for t in texts], np.uint64)),
                "blob": zstandard.ZstdCompressor(3).compress(b"".join(texts)),
                "bytes": sum(map(len, texts)),
            }

        schema = pa.schema([("block_id", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary()), ("bytes", pa.int64())])
        size = 0
        for batch in batches:
            for doc_id, text in arrow_rows(batch):
                block.append((doc_id, text.encode()))
                size += len(block[-1][1]) + 16
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([row(block)], schema)
                    block, size = [], 0
        if block:
            yield pa.RecordBatch.from_pylist([row(block)], schema)

    return documents(df).mapInArrow(build, _BLOCK)


def _shared_anchors(table: DataFrame, k: int, buckets: int) -> DataFrame:
    """Per block and bucket, a bit for each of its distinct anchors: does it occur in two documents?"""
    anchor = k // 2 + 1

    def send(batches):
        for batch in batches:
            for block_id, _, sizes, blob in arrow_rows(batch.select(["block_id", "docs", "sizes", "blob"])):
                out = []
                own = [np.unique(least) for _, _, least in _runs(_texts(sizes, blob), k, anchor)]
                if own:
                    keys, n = np.unique(np.concatenate(own), return_counts=True)
                    out = [{"bucket": b, "block_id": block_id, "keys": pack(keys[i:j], True), "a": pack((n[i:j] > 1).astype(np.uint8))} for b, i, j in slices(keys, buckets)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("a", pa.binary())]))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, many = [unpack(x, True) for x in pdf["keys"]], [unpack(x) for x in pdf["a"]]
        _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[inverse[np.concatenate(many) > 0]] = True
        bits = np.split(shared[inverse], np.cumsum([len(x) for x in keys])[:-1])
        return pd.DataFrame({"block_id": pdf["block_id"], "bucket": pdf["bucket"], "kind": 1, "r": [np.packbits(x).tobytes() for x in bits]})

    sent = table.mapInArrow(send, "bucket int, block_id long, keys binary, a binary")
    return sent.groupBy("bucket").applyInPandas(match, _REPLY)


def _bits(rows: pd.DataFrame, keys: np.ndarray, buckets: int, width: int = 1) -> np.ndarray:
    """The replies of all buckets, in line with the block's ascending keys: width bits for each."""
    got = dict(zip(rows["bucket"], rows["r"], strict=True))
    out = np.zeros((len(keys), width), bool)
    for b, i, j in slices(keys, buckets):
        out[i:j] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=(j - i) * width).reshape(j - i, width)
    return out


def _candidates(texts: list[bytes], k: int, shared_rows: pd.DataFrame, buckets: int, key_bits: int):
    """Windows whose anchor is shared, in order: document index, position, key, and the words before and after."""
    anchor = k // 2 + 1
    runs = list(_runs(texts, k, anchor))
    empty = tuple(np.empty(0, t) for t in (np.uint32, np.uint32, np.uint64, np.uint32, np.uint32))
    if not runs:
        return empty
    keys = np.unique(np.concatenate([np.unique(x[2]) for x in runs]))
    flags = _bits(shared_rows, keys, buckets)[:, 0]
    found = []
    for i, h, least in runs:
        at = np.flatnonzero(flags[np.searchsorted(keys, least)])
        if len(at):
            near = np.ones(len(h) + 2, np.uint32)
            near[1:-1] = np.maximum((h >> np.uint64(32)).astype(np.uint32), 2)
            key = rolling(h, k)[at] >> np.uint64(64 - key_bits) << np.uint64(64 - key_bits)
            found.append((np.full(len(at), i, np.uint32), at.astype(np.uint32), key, near[at], near[at + k + 1]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else empty


def _junctions(key: np.ndarray, doc: np.ndarray, *neighbours: np.ndarray):
    """By ascending distinct key: the least document, whether there are several, and the neighbours or MANY."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    low = lambda x: np.minimum.reduceat(x[order], first) if len(first) else x[:0]
    high = lambda x: np.maximum.reduceat(x[order], first) if len(first) else x[:0]
    least = low(doc)
    return s[first], least, high(doc) > least, *(np.where(low(x) == high(x), low(x), x.dtype.type(MANY)) for x in neighbours)


def _walk(raw: list[bytes], ids: np.ndarray, k: int, doc, pos, flags) -> dict[bytes, list]:
    """The paths of a block: words, and the occurrences (document index, start, has an older document)."""
    repeated, older, after, before = flags
    at = np.flatnonzero(repeated)
    out: dict[bytes, list] = {}
    if not len(at):
        return out
    d, p = doc[at], pos[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (np.diff(p) != 1) | after[at][:-1] | before[at][1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    has_older = np.logical_or.reduceat(older[at], first)
    now, words = -1, []
    for i, a, b, o in zip(d[first].tolist(), p[first].tolist(), (p[last] + k).tolist(), has_older.tolist(), strict=True):
        if i != now:
            now, words = i, raw[i].split()
        out.setdefault(b" ".join(words[a:b]), []).append((i, a, o))
    return out


def _path_rows(block_id: int, found: dict[bytes, list], ids: np.ndarray, k: int):
    for words, places in found.items():
        docs = ids[[i for i, _, _ in places]]
        first = min(range(len(places)), key=lambda x: (docs[x], places[x][1]))
        older = [int(d) for d, (_, _, o) in zip(docs, places, strict=True) if o]
        yield (block_id, words.decode(errors="surrogateescape"), words.count(b" ") + 1, int(docs[first]), places[first][1], min(older, default=None), docs.tobytes(), np.array([i for i, _, _ in places], np.uint32).tobytes(), np.array([a for _, a, _ in places], np.int64).tobytes())


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"older": "Int64"}) if "older" in names else out


def _sources(paths: DataFrame) -> DataFrame:
    """Occurrences with the coordinates of their path's source: the words are compared, not their hash."""
    hashed = paths.withColumn("h", F.xxhash64("words"))
    source = hashed.groupBy("h", "words").agg(F.min("doc_id").alias("source_doc"), F.min_by("start", "doc_id").alias("source_start"))
    return hashed.join(source, ["h", "words"]).drop("h")


def _single_windows(paths: DataFrame, k: int) -> DataFrame:
    """Every window of the paths as a path of its own."""
    schema = pa.schema([("block_id", pa.int64()), ("words", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("older", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("starts", pa.binary())])

    def cut(batches):
        for batch in batches:
            for block_id, text, _, doc_id, start, older, docs, places, starts in arrow_rows(batch):
                words, starts = text.split(" "), np.frombuffer(starts, np.int64)
                rows = [(block_id, " ".join(words[i : i + k]), k, doc_id, start + i, older, docs, places, (starts + i).tobytes()) for i in range(len(words) - k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return paths.mapInArrow(cut, _PATH)


def repeated_spans(df: DataFrame, k: int = WINDOW, texts: bool = False, key_bits: int = 64, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans and, on demand, text and the kept text.

    spans: the compacted paths that go, array<struct<start, length, source_doc, source_start>> in words.  kept: the
    kept words joined by one space.  key_bits: how much of the edges' hashes is used (the result does not depend on it).
    """
    spark = df.sparkSession
    table = materialize(blocks(df), "blocks")
    total = (table.agg(F.sum("bytes")).first()[0] or 0) // BYTES_PER_ANCHOR
    buckets = max(parallelism(spark), 1, math.ceil(total / per_bucket))
    stored = table.select("block_id", F.lit(None).cast("int").alias("bucket"), F.lit(0).alias("kind"), F.col("docs").alias("r"), "sizes", "blob")
    shared = materialize(_shared_anchors(table, k, buckets), "anchors")
    joined = stored.unionByName(shared, allowMissingColumns=True)

    def candidates(pdf: pd.DataFrame):
        own = pdf[pdf["kind"] == 0].iloc[0]
        raw, ids = _texts(own["sizes"], own["blob"]), np.frombuffer(own["r"], np.int64)
        doc, pos, key, before, after = _candidates(raw, k, pdf[pdf["kind"] == 1], buckets, key_bits)
        return int(own["block_id"]), raw, ids, doc, pos, key, _junctions(key, ids[doc], before, after)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        block_id, _, _, _, _, _, (keys, least, several, before, after) = candidates(pdf)
        out = []
        for b, i, j in slices(keys, buckets):
            docs, local = np.unique(least[i:j], return_inverse=True)
            out.append((b, block_id, pack(keys[i:j], True), pack(before[i:j]), pack(after[i:j]), pack(local.astype(np.uint32)), np.packbits(several[i:j]).tobytes(), docs.tobytes()))
        return _frame(out, _SENT)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, True) for x in pdf["keys"]]
        n = [len(x) for x in keys]
        key = np.concatenate(keys)
        doc = np.concatenate([np.frombuffer(d, np.int64)[unpack(x)] for d, x in zip(pdf["docs"], pdf["doc"], strict=True)])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(pdf["several"], n, strict=True)]).astype(bool)
        near = [np.concatenate([unpack(x) for x in pdf[c]]) for c in ("before", "after")]
        every, least, many, before, after = _junctions(key, doc, *near)
        at = np.searchsorted(every, key)
        many[at[several]] = True
        bits = np.stack([many[at], least[at] < doc, after[at] == MANY, before[at] == MANY], axis=1)
        return pd.DataFrame({"block_id": pdf["block_id"], "bucket": pdf["bucket"], "kind": 2, "r": [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(n)[:-1])]})

    edges = joined.groupBy("block_id").applyInPandas(send, _SENT)
    replies = materialize(edges.groupBy("bucket").applyInPandas(match, _REPLY), "edges")

    def compact(pdf: pd.DataFrame) -> pd.DataFrame:
        block_id, raw, ids, doc, pos, key, (keys, least, *_) = candidates(pdf)
        rows = []
        if len(keys):
            at = np.searchsorted(keys, key)
            repeated, older, after, before = _bits(pdf[pdf["kind"] == 2], keys, buckets, 4)[at].T
            found = _walk(raw, ids, k, doc, pos, (repeated, older | (ids[doc] > least[at]), after, before))
            rows = list(_path_rows(block_id, found, ids, k))
        return _frame(rows, _PATH)

    paths = materialize(joined.unionByName(replies, allowMissingColumns=True).groupBy("block_id").applyInPandas(compact, _PATH), "paths")
    spans = materialize(_sources(paths), "spans")
    doubtful = spans.where("older IS NOT NULL AND source_doc >= older").select(*paths.columns)
    if not doubtful.isEmpty():  # hashes collided
        wanted = _single_windows(doubtful, k).select("words").distinct()
        spans = spans.unionByName(_sources(_single_windows(paths, k).join(wanted, "words", "left_semi").select(*paths.columns)))
    own = stored.select("block_id", "r", "sizes", "blob")
    gone = spans.select("block_id", "n", "docs", "places", "starts", "source_doc", "source_start")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        row = pdf[pdf["blob"].notna()].iloc[0]
        ids, raw = np.frombuffer(row["r"], np.int64), _texts(row["sizes"], row["blob"])
        found: dict[int, set] = {}
        some = pdf[pdf["docs"].notna()]
        for n, docs, places, starts, source, begin in zip(some["n"], some["docs"], some["places"], some["starts"], some["source_doc"], some["source_start"], strict=True):
            later = np.flatnonzero(np.frombuffer(docs, np.int64) > int(source))
            for i, a in zip(np.frombuffer(places, np.uint32)[later].tolist(), np.frombuffer(starts, np.int64)[later].tolist(), strict=True):
                found.setdefault(i, set()).add((a, int(n), int(source), int(begin)))
        out = []
        for i, text in enumerate(raw):
            words, own_ = text.split(), sorted(found.get(i, ()))
            lost, kept = 0, b" ".join(words)
            if own_:
                change = np.zeros(len(words) + 1, np.int64)
                for a, n, _, _ in own_:
                    change[a] += 1
                    change[a + n] -= 1
                keep = np.cumsum(change[:-1]) == 0
                lost, kept = len(words) - int(keep.sum()), b" ".join([w for w, y in zip(words, keep.tolist(), strict=True) if y])
            line = [int(ids[i]), len(words), lost, hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "source_doc", "source_start"), x, strict=True)) for x in own_]]
            out.append([*line, text.decode(), kept.decode()] if texts else line)
        return pd.DataFrame(out, columns=names)

    schema = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, length: long, source_doc: long, source_start: long>>" + (", text string, kept string" if texts else ""))
    names = schema.names
    return own.unionByName(gone, allowMissingColumns=True).groupBy("block_id").applyInPandas(apply, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table: words, removed words and the digest of the kept text."""
    return repeated_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

ORACLE_SQL = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), p AS (
  SELECT doc_id, w[i] AS word, i, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), f AS (
  SELECT doc_id, word, i, CASE WHEN gram IS NOT NULL AND min(doc_id) OVER (PARTITION BY gram) < doc_id THEN 1 ELSE 0 END AS hit FROM p
), g AS (
  SELECT doc_id, word, i, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f
), a AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
}
