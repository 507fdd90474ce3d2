"""The pipeline's rows against a plain Python version, and its stages on awkward tables."""

import gc
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from matchlake.llm import packing, quality, secrets
from matchlake.llm.common import Recent, WordHashes, clear_scratch, word_hashes

P = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = np.random.default_rng(21)
    some = lambda n: ["".join(x) for x in zip(*(rng.choice(["na", "ti", "re", "so", "mu", "ka", "lo", "ver", "den", "sil", "tor", "pan", "wes"], n) for _ in range(3)))]
    prose = lambda n: " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(some(n)))
    texts = [prose(int(rng.integers(30, 200))) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1]]  # exact copies
    words = texts[2].split()
    texts += [" ".join([*words[:10], "changed", *words[11:]])]  # a near copy
    passage = prose(70)
    texts += [f"{prose(40)} {passage} {prose(40)}" for _ in range(3)]  # a repeated passage
    texts += [f"{prose(40)} token: Ab3dEf6hIj9kLmN {prose(20)}", f"{prose(40)} 0123456789abcdef0123 {prose(20)}"]
    texts += [" ".join(f"{w.upper()}!!" for w in some(80)) for _ in range(6)] + [" ".join(f"{w}%%%" for w in some(80)) for _ in range(6)] + [" ".join(some(1) * 90) for _ in range(6)]
    texts += [f"{prose(30)} idiot {prose(10)} scum trash moron {prose(10)}" for _ in range(8)]
    texts += [None, "", "   ", "two words", prose(6000)]
    rows = [(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id", "en", "s", 5)]


def _find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def _quality(rows):
    """The classifier in one process: the same votes, posteriors and scorer, no Spark; the words are those that the toxic texts alone hold."""
    listed = dict.fromkeys(("idiot", "scum", "trash", "moron"), True)
    marked = [(r, *quality.features(r[1] or "", listed)) for r in rows if r[0] is not None]
    post = quality.combined(dict(Counter(p for _, p, _ in marked)))
    fitted = sorted((r[0], quality.pack(x, True), post[p]) for r, p, x in marked)
    weight, bias = quality.train(quality.one_of_copies([(d, quality.unpack(x, True), y) for d, x, y in fitted]))
    return [r for r, _, x in marked if 1 / (1 + np.exp(-np.clip(weight[x].sum() + bias, -30, 30))) < quality.THRESHOLD]


def _near_dups(rows):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((_find(root, a), _find(root, b)))
                root[y] = x
    return list({r[0]: r for r in rows if _find(root, r[0]) == r[0]}.values())


def _substrings(rows):
    first, out = {}, []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t, *rest in rows:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((d, kept, *rest))
    return out


def _secrets(rows):
    out = []
    for d, t, *rest in rows:
        spans = sorted((m.start(), m.end()) for p, g, n in ((secrets.ASSIGN, 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)) for m in re.finditer(p, t) if len(m[g]) >= n)
        done, at = "", 0
        for a, b in spans:
            if a >= at:
                done += t[at:a] + "[SECRET]"
            at = max(at, b)
        out.append((d, done + t[at:], *rest))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = _corpus()
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = _quality(rows)
    assert 55 <= len(kept) < len(rows) - 20  # junk and abuse went, prose stayed
    final = _secrets(_substrings(_near_dups(kept)))
    whole, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for d, t, *_ in final:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        expected.update((d, i, a, tuple(ids[a : a + 2048])) for i, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got) == expected
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
    clear_scratch(spark)


def test_every_stage_on_awkward_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "x", "y", 0), (None, "text", None, None, None), (3, "a " * 50_000, None, "z", 9)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, base string, found string, ids binary, h long, keep boolean, component_id long, node long, votes string"
    for rows in (odd, []):
        docs = spark.createDataFrame([(*r, *[None] * 8) for r in rows], extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS), name
            ids = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert ids <= {r[0] for r in rows if r[0] is not None}, name
            if name in ("secrets", "substrings", "packing"):
                assert ids == {r[0] for r in rows if r[0] is not None}, name
    clear_scratch(spark)


def test_packing_in_many_partitions(spark):
    """Small partitions: the rounds exchange what is left, and no token is lost."""
    rng = np.random.default_rng(31)
    lengths = rng.integers(1, 2049, 1500).tolist()
    rows = [(i, 0, 0, n, rng.integers(0, 2**32, n, dtype=np.uint32).tobytes()) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, packing.PIECES)
    used = {}
    for rounds in (1, 3):
        packed = packing.pack_pieces(df, rounds=rounds, per_partition=100)
        got = packed.collect()
        assert sorted((r["doc_id"], hashlib.md5(bytes(r["ids"])).hexdigest()) for r in got) == sorted((r[0], hashlib.md5(r[4]).hexdigest()) for r in rows)
        fill = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(fill.values()) <= 2048
        used[rounds] = len(fill)
        assert packing.certificate(packed) == (len(fill), packing.bin_bound(np.array(lengths), 2048))
    bound = packing.bin_bound(np.array(lengths), 2048)
    print("bins", used, "bound", bound)
    assert used[3] <= 1.01 * bound


def test_a_worker_remembers_for_one_operator_only():
    """Workers outlive the stages, and what each stage's operator remembered would add up in their memory."""
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    held = lambda mark: [x for x in gc.get_objects() if isinstance(x, (Recent, WordHashes)) and mark in x]
    steps = [(b"oneseenbyquality", lambda: quality.read_text("oneseenbyquality")), (b"twoseenbyhashes", lambda: word_hashes([b"twoseenbyhashes"])), ("threeseenbyids", lambda: packing._encoder(model).encode("threeseenbyids"))]
    for k, (mark, use) in enumerate([*steps, steps[0]]):
        first = use()
        assert held(mark) and not any(held(other) for other, _ in steps if other != mark), k
        assert str(use()) == str(first)
