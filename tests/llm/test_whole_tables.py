"""Queries over whole given tables against brute force."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from matchlake.llm import pieces
from matchlake.llm.registry import QUERIES


def _texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: x or "" for i, x in zip(t["doc_id"], t["text"], strict=True)}


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_neighbours_against_every_distance(spark, sf, table):
    folder = f"{sf.rpartition('/')[0]}/{table}"
    t = pq.read_table(f"{folder}/embeddings.parquet").to_pandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    got: dict = {}
    for r in QUERIES["op1_inverted_multi_index"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = np.flatnonzero(ids % 100 == 0)
    assert sorted(got) == sorted(ids[queries].tolist())
    found = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = sorted((d[i], ids[i]) for i in range(len(ids)) if i != q)[:10]
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        at = {v: i for i, v in enumerate(ids)}
        assert all(math.isclose(s, d[at[v]], rel_tol=1e-12) for _, v, s in mine)
        found += len({v for _, v in near} & {v for _, v, _ in mine})
    assert found >= 0.9 * 10 * len(queries)


def test_simhash_against_all_pairs(spark, sf):
    texts = _texts(sf)
    prints = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
        ones = [(int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h)) for b in range(64)]
        prints[i] = sum(1 << b for b, on in enumerate(ones) if on)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    expected = sorted((i, f"{prints[i]:016x}", find(i)) for i in texts)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, sf).collect())
    assert got == expected and len({c for _, _, c in got}) < len(got)


def test_packing_against_the_tokenizer(spark, sf):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = []
    for i, t in _texts(sf).items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        expected += [(i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048)) for part in [ids[a : a + 2048]]]
    rows = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    large = sum(2 * r["length"] > 2048 for r in rows)
    assert max(least, large) <= len(places) <= max(least, large) + 1


def test_pieces_against_plain_viterbi_over_the_table(spark, sf):
    """Every text's best sum of scores, by a plain dynamic programme over its characters."""
    P = pytest.importorskip("public_tokenizers")
    vocabulary = pieces.load_vocabulary(P.path("piece_bpe_32k.model"))
    codec = pieces.Codec(vocabulary)
    scores = {p: s for p, s, k in vocabulary if k == "piece"}
    longest = max(map(len, scores))
    for t in _texts(sf).values():
        if not t or len(t) > 6000:
            continue
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        if any(vocabulary[i][2] == "byte" for i in ids):
            continue
        chunk = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(chunk)
        for e in range(1, len(chunk) + 1):
            best[e] = max((best[s] + scores[chunk[s:e]] for s in range(max(0, e - longest), e) if chunk[s:e] in scores), default=-math.inf)
        assert math.isclose(sum(vocabulary[i][1] for i in ids), best[-1], rel_tol=1e-9)


@pytest.mark.parametrize("text", ["", None, "x", "word " * 200_000, "z" * 400_000, "日本" * 50_000])
def test_pieces_and_packing_of_odd_texts(spark, text):
    P = pytest.importorskip("public_tokenizers")
    from matchlake.llm import packing

    df = spark.createDataFrame([(1, text, "a", 5), (1, text, "a", 5), (None, "gone", "a", 5)], "doc_id long, text string, ids string, length int")
    coded = pieces.encode_documents(df, P.path("piece_bpe_32k.model")).collect()
    assert len(coded) == 2 and all(r["round_trip"] and r["decoded"] == (text or "") for r in coded)
    packed = packing.pack_pieces(packing.pieces(df, P.path("word_bpe_49k.json"))).collect()
    assert {r["doc_id"] for r in packed} == {1} and all(r["length"] <= 2048 for r in packed)
    assert pieces.encode_documents(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack_pieces(packing.pieces(df.limit(0), P.path("word_bpe_49k.json"))).count() == 0
