"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's state and its output links give every piece that ends there; each relaxes
the best score of its end from that of its start.  Higher sums of piece scores win, then longer last pieces.
A character that is no piece itself costs the least score less UNKNOWN and is written as its bytes
where the vocabulary has byte pieces, else as the unknown id.  Spaces become the marker, and one is put
in front.  Where no piece has a marker behind another character (checked), chunks that begin with
markers segment independently and are remembered within a bound.

Decoding joins pieces and bytes, turns markers to spaces and takes the first away.  Defined results:
the empty text has no ids; a text that itself holds the marker decodes it as a space.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import Recent, arrow_rows, documents, read

MARK = "▁"
UNKNOWN = 10.0
MOST_PIECES = 1_000_000
Vocabulary = list[tuple[str, float, str]]  # piece, score, kind: piece, byte, unknown or none


def load_vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if p.get_piece_size() > MOST_PIECES:
        raise ValueError("the vocabulary is too large to send to every executor")
    kind = lambda i: "byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "none" if p.is_control(i) or p.is_unused(i) else "piece"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.unknown, self.out, singles, least = 0, [], set(), 0.0
        for i, (piece, score, kind) in enumerate(vocabulary):
            self.out.append(bytes([int(piece[3:5], 16)]) if kind == "byte" else piece.encode() if kind == "piece" else b"")
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = i
            elif kind == "unknown":
                self.unknown = i
            elif kind == "piece":
                self.automaton.add_word(piece, (len(piece), score, i))
                least = min(least, score)
                if len(piece) == 1:
                    singles.add(piece)
        self.automaton.make_automaton()
        self.singles, self.penalty = singles, least - UNKNOWN
        apart = not any(kind == "piece" and MARK in piece.lstrip(MARK) for piece, _, kind in vocabulary)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s).+")
        self.known = Recent(self._segment)

    def _segment(self, chunk: str) -> bytes:
        n = len(chunk)
        best, back, ids = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0  # ends up to here have their unknown character weighed

        def unknowns(to: int) -> None:
            nonlocal done
            while done < to:
                if chunk[done] not in self.singles and best[done] + self.penalty > best[done + 1]:
                    best[done + 1], back[done + 1], ids[done + 1] = best[done] + self.penalty, done, -1
                done += 1

        for last, (size, score, i) in self.automaton.iter(chunk):
            unknowns(last)  # all earlier ends are final now
            start, end = last + 1 - size, last + 1
            if best[start] + score > best[end]:
                best[end], back[end], ids[end] = best[start] + score, start, i
        unknowns(n)
        out: list[int] = []
        at = n
        while at:
            i, start = ids[at], back[at]
            if i < 0:
                raw = chunk[start:at].encode(errors="surrogatepass")
                out.extend(reversed([self.bytes[b] for b in raw] if self.bytes else [self.unknown]))
            else:
                out.append(i)
            at = start
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.chunks.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").replace(MARK, " ")[1:]


_codecs: dict[int, Codec] = {}


def _codec(key: int, vocabulary: Vocabulary) -> Codec:
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode_documents(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (little-endian uint32), the text decoded from them, and whether it is the document's."""
    vocabulary = load_vocabulary(model_file)
    key = zlib.crc32(repr(vocabulary).encode())
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("round_trip", pa.bool_())])

    def run(batches):
        codec = _codec(key, shared.value)
        for batch in batches:
            for small in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for doc_id, text in arrow_rows(small):
                    ids = codec.encode(text)
                    back = codec.decode(ids)
                    rows.append((doc_id, ids, back, back == text))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents(df).mapInArrow(run, "doc_id long, ids binary, decoded string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    n_ids = F.octet_length("ids").cast("long") / 4
    return coded.select("doc_id", n_ids.cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
