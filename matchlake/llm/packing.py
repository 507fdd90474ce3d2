"""Best-fit packing with certified bin counts.

Every document's token ids, closed by the end id, are cut into pieces of at most ``capacity``; pieces
are packed whole into sequences.  The pieces with their ids are written once; the rounds move only their
keys and lengths.  Then the ids are joined to their places, and `sequences` puts them together.

A round packs each partition by best-fit decreasing and certifies it: the largest of a family of
dual-feasible-function bounds is a lower bound on the bins of any packing of those pieces.  A partition
whose bins equal its bound is optimal; its bins are final but for those that lack more than 1 / SLACK, which could
still take in another partition's pieces.  Where a gap remains, only full bins are final.
The documents of all other bins are exchanged: they are dealt into fewer partitions (so that small and
large pieces from different gaps meet) and packed again.  Rounds end when nothing is left, when the
exchanged pieces fit one partition, or after ``rounds``.  A partition holds PER_PARTITION pieces or so (the last
round eight times as many), whatever the input; nothing is gathered on the driver but counts.  `certificate` sets the
sequences of a result against the bound of the whole table.

Defined results: the empty text is one piece holding the end id; ties go to the fullest bin, then the
oldest; equal documents are packed separately.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import Recent, documents, forget, materialize, read, remembered

CAPACITY = 2048
PER_PARTITION = 50_000
ROUNDS = 3
SLACK = 256
PER_CACHE = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: White space outside ASCII and separators take the slow exact way, as strings of special tokens do.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and then punctuation, all of one byte's code points: two tokens at most, case folds one to one.
_CHUNK = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)")
# Fixed value: the punctuation of _CHUNK.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _odd(text: str) -> bool:
    return "<|" in text or any(map(text.__contains__, _ODD))  # much faster than a regular expression


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or 256 upwards in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


# Fixed value: how the tokenizer files that the short way serves split their texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_as_known(model: str) -> bool:
    """Are the normaliser and the pre-tokeniser those that the short way of the encoder takes for granted?"""
    found = json.loads(model)
    normal = [x.get("type") for x in (found.get("normalizer") or {}).get("normalizers", [])]
    pre = (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [x.get("pattern", {}).get("Regex") for x in pre if x.get("type") == "Split"]
    byte_level = [x for x in pre if x.get("type") == "ByteLevel" and not x.get("add_prefix_space")]
    return normal == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT] and len(byte_level) == 1 and len(pre) == 2 and found["model"].get("type") == "BPE" and not found.get("post_processor")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Little-endian uint32 ids of the chunks between white space, which encode independently here.

    Chunks of letters and punctuation take their parts' ids from the library's model; all other chunks
    go through the whole tokenizer.  Parts are chunks themselves; all are remembered within a bound.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.fast = _splits_as_known(model)
        self.letters = _byte_letters()
        self.part = self.tokenizer.model.tokenize
        self.chunks = Recent(self._chunk, 2 * PER_CACHE)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.part(shown)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            letters = chunk.rstrip(_MARKS)
            if letters and not letters.isalpha():
                return self._whole(chunk)
        elif m := _CHUNK.fullmatch(chunk):
            letters = m[1]
        else:
            return self._whole(chunk)
        word = letters.lower()
        if word == chunk or not letters:
            return self._word(chunk)
        marks = chunk[len(letters) :]
        return self.chunks[word] + self.chunks[marks] if marks else self.chunks[word]

    def encode(self, text: str) -> bytes:
        return self._whole(text) if not self.fast or _odd(text) else b"".join(map(self.chunks.__getitem__, text.split()))


def _encoder(model: str) -> Encoder:
    return remembered(("encoder", zlib.crc32(model.encode())), lambda: Encoder(model))


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document with their ids (little-endian uint32); tokenizer is the path of a file of the tokenizers library (bounded, under 16 MB)."""
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    if len(model) > 16 << 20:
        raise ValueError("the tokenizer file is too large to send to every executor")
    shared = df.sparkSession.sparkContext.broadcast(model)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        ids = _encoder(shared.value)
        for batch in batches:
            for small in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                docs, texts = (c.to_pylist() for c in small.columns)
                out = []
                for doc_id, text in zip(docs, texts, strict=True):
                    raw = ids.encode(text) + end
                    for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        out.append((doc_id, p, a // 4, len(part) // 4, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return documents(df).mapInArrow(cut, PIECES)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible-function lower bounds on the number of bins."""
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def _bound(n: np.ndarray, capacity: int) -> int:
    """n: how many pieces have each length from 0 to capacity."""
    size = np.arange(capacity + 1)
    total = int((n * size).sum())
    best = -(-total // capacity)
    above = np.cumsum(n[::-1])[::-1]
    weight = np.cumsum(n * size)
    for t in range(1, capacity // 2 + 1):  # items over capacity - t count whole, those under t not at all
        big = int(above[capacity - t + 1]) if t else 0
        best = max(best, big + -(-int(weight[capacity - t] - weight[t - 1]) // capacity))
    for k in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20):  # u(k): x (k + 1) / capacity rounded down over k, whole multiples as they are
        y = size * (k + 1)
        u = np.where(y % capacity == 0, y // capacity * k, y // capacity * (k + 1))
        best = max(best, -(-int((n * u).sum()) // (k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int):
    """Best-fit decreasing. Bin and offset of each piece, and the fill of each bin.

    Open bins wait by free space; a bitmap over the free spaces finds the tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit s is set if a bin with s free places waits
    where, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    size = lengths.tolist()
    for i in order:
        x = size[i]
        fits = free >> x
        if fits:
            s = x + (fits & -fits).bit_length() - 1
            b = waiting[s].pop()
            if not waiting[s]:
                free ^= 1 << s
        else:
            b, s = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += x
        if s > x:
            waiting[s - x].append(b)
            free |= 1 << (s - x)
    return where, offset, np.array(fill, np.int64)


_KEYS = ("piece_id", "doc_id", "piece", "length", "ids_crc32")
_PACKED = "piece_id long, doc_id long, piece int, length long, ids_crc32 long, sequence_id long, offset long, final boolean, bins long, bound long"


def _packer(capacity: int, r: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offset, fill = best_fit(lengths, capacity)
        bound = bin_bound(lengths, capacity)
        ok = np.full(len(fill), True) if last else fill >= capacity - capacity // SLACK if len(fill) == bound else fill == capacity
        base = ((r + 1) << 59) + (int(key[0]) << 32)
        return pdf.drop(columns="part").assign(sequence_id=base + where, offset=offset, final=ok[where], bins=len(fill), bound=bound)

    return run


def _places(df: DataFrame, capacity: int, rounds: int, per_partition: int) -> DataFrame:
    """_KEYS with sequence_id and offset. sequence_id: round, partition and bin in one number, or the piece_id of a full piece."""
    whole = df.where(F.col("length") == capacity).select("*", F.col("piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ids = F.xxhash64("doc_id", "piece", "ids_crc32")
    done = [whole]
    left, packed = df.where(F.col("length") < capacity), None
    open_count = left.count()
    for r in range(rounds):
        if not open_count:
            break
        # the last round gathers up to eight times as much in a partition, so that few bins stay open
        parts = max(1, -(-open_count // (per_partition * (8 if r == rounds - 1 else 1))))
        last = r == rounds - 1 or parts == 1

        salt = F.pmod(F.xxhash64(ids, F.lit(r)), F.lit(parts)).cast("int")
        packed = materialize(left.withColumn("part", salt).groupBy("part").applyInPandas(_packer(capacity, r, last), _PACKED), f"packed{r}")
        done.append(packed.where("final").drop("final", "bins", "bound"))
        left = packed.where(~F.col("final")).select(*df.columns)
        open_count = 0 if last else left.count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_pieces(df: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pieces, ids included, with their ids_crc32, sequence_id and offset."""
    cut = materialize(df.withColumn("ids_crc32", F.crc32("ids")).withColumn("piece_id", F.monotonically_increasing_id()), "pieces", **{"parquet.enable.dictionary": "false"})
    places = _places(cut.select(*_KEYS), capacity, rounds, per_partition).select("piece_id", "sequence_id", "offset")
    return cut.join(places, "piece_id").select(*df.columns, "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and how few any packing of the same pieces could have at least."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in packed.groupBy("length").count().collect():  # at most capacity rows
        n[length] = count
    return packed.select("sequence_id").distinct().count(), _bound(n, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and the members (offset, doc_id, piece, start, length) in order."""
    member = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda done, m: F.concat(done, m["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("all", lambda m: m.dropFields("ids")).alias("members"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_pieces(pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    # the checksums were taken when the ids were written; the ids themselves need not move for them
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
