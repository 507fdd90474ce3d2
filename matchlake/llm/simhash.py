"""SimHash near-dedup by vantage-point trees.

Fingerprints are 64-bit words, a bit being set if it is set in over half of the shingles' hashes.
A vantage-point tree over a bounded sample (SAMPLE fingerprints) parts all fingerprints: each inner
node has a vantage point and a median distance, inside goes left, outside right.  Below the DEPTH levels that the
sample can fit, vantage points are drawn from the node's number and the bound is the middle distance of random words,
so the tree is as deep as the table asks for and needs no more memory; the triangle bounds hold for any of them.  A fingerprint lives
in one leaf and visits every other leaf that the triangle bounds cannot exclude within the radius, so
that every pair within it meets in a leaf; a pair is compared in the later of its two leaves only.
A leaf is one shard; shards and their visitors are split into chunks of CHUNK, and every task compares one
chunk of residents with one of visitors and returns a spanning forest of the links it found, never all
pairs.  Components of the forests are the components of all links.

`near_duplicates` judges word-shingle sets by Jaccard similarity: wider fingerprints propose, sizes
bound (sets of similarity s differ in size by 1/s at most: bands), and the exact similarity of the
shingle sets decides.  At such radii the triangle bounds exclude next to nothing; the size bands do.

Defined results: a text without words has fingerprint zero and is linked like any other; documents of
one fingerprint are one component; documents that share a doc_id are linked, whatever their texts; a null text is
empty; repeated rows come back each; only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import SEED, arrow_rows, documents, materialize, mix, read
from matchlake.llm.components import components

SAMPLE = 8192
LEAF = 2000
CHUNK = 4096
DEPTH = 9
TILE = 64


def shingle_hashes(text: str, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of k words (A-Z lower-cased, joined by spaces), repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: 1 - k].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[a : a + (1 << 16)])
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint of its k-word shingles as 16 hexadecimal digits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [(d, f"{fingerprint(shingle_hashes(t, k)):016x}") for d, t in arrow_rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], schema=schema)

    return documents(df).mapInArrow(run, "doc_id long, fp string")


def _words(fps: list[str]) -> np.ndarray:
    raw = bytes.fromhex("".join(fps))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(fps), -1) if fps else np.empty((0, 1), np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for w in range(1, a.shape[1]):
        d += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return d


class VantageTree:
    """Inner nodes 1.. in heap order; the leaves of depth d are the nodes from 2**d. fitted: levels from the sample."""

    def __init__(self, sample: np.ndarray, depth: int, fitted: int = DEPTH):
        self.depth, self.whole = depth, depth
        self.depth = depth = min(depth, fitted)
        self.vantage = np.zeros((1 << depth, sample.shape[1] if len(sample) else 1), np.uint64)
        self.bound = np.zeros(1 << depth, np.int64)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            if len(own):
                tried = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
                d = distances(tried, own)
                best = int(np.argmax(d.var(axis=1)))
                self.vantage[node], self.bound[node] = tried[best], int(np.median(d[best]))
                inside = d[best] <= self.bound[node]
            else:
                inside = np.zeros(0, bool)
            if 2 * node < 1 << depth:
                parts[2 * node], parts[2 * node + 1] = own[inside], own[~inside]

        self.depth = self.whole

    def _split(self, fps: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each point to its node's vantage point, and the node's bound."""
        fitted = node < len(self.bound)
        own = np.where(fitted, node, 0)
        drawn = mix(node.astype(np.uint64)[:, None] * np.uint64(fps.shape[1]) + np.arange(fps.shape[1], dtype=np.uint64))
        vantage = np.where(fitted[:, None], self.vantage[own], drawn)
        middle = 32 * fps.shape[1] - 1 + (drawn[:, 0] & np.uint64(1)).astype(np.int64)
        return np.bitwise_count(fps ^ vantage).astype(np.int64).sum(axis=1), np.where(fitted, self.bound[own], middle)

    def home(self, fps: np.ndarray, depth: np.ndarray) -> np.ndarray:
        node = np.ones(len(fps), np.int64)
        for level in range(self.depth):
            go = np.flatnonzero(depth > level)
            d, m = self._split(fps[go], node[go])
            node[go] = 2 * node[go] + (d > m)
        return node

    def overlapping(self, fps: np.ndarray, depth: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, leaf) that the triangle bounds leave open."""
        at, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for level in range(self.depth):
            go = depth[at] > level
            stay_at, stay = at[~go], node[~go]
            at, node = at[go], node[go]
            d, m = self._split(fps[at], node)
            left, right = d - radius <= m, d + radius > m
            at, node = np.concatenate([stay_at, at[left], at[right]]), np.concatenate([stay, 2 * node[left], 2 * node[right] + 1])
        return at, node


def _band(size: np.ndarray, ratio: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / -math.log(ratio) + 1e-9).astype(np.int64) if ratio else np.zeros(len(size), np.int64)


class _Forest:
    """Components of a few thousand points, by labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, points: np.ndarray) -> None:
        labels = np.unique(self.label[points])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = nodes[self.label]
        apart = root != nodes
        return nodes[apart], root[apart]


_DEALT = "shard long, i int, j int, resident boolean, nodes binary, fps binary, sizes binary"
_LINKS = "a long, b long"


def links(nodes: DataFrame, radius: int, ratio: float = 0.0) -> DataFrame:
    """Spanning links (a, b) among nodes (node long, fp string, size long) within the radius.

    ratio: the least quotient of two sizes (0: any).  Nodes are distinct; fingerprints may repeat.
    """
    sample = [r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / -math.log(ratio) + 1e-9) if ratio else F.lit(0)
    counts = {int(b): n for b, n in nodes.groupBy(band.cast("long").alias("band")).agg(F.count("*")).collect()}
    depths = {b: max(0, math.ceil(math.log2(n / LEAF))) for b, n in counts.items()}
    tree = VantageTree(_words(sample), max(depths.values(), default=0))

    def places(pdf: pd.DataFrame):
        """Resident shards, and (point, shard) visits; a resident visits its own shard too."""
        fps, sizes = _words(pdf["fp"].tolist()), pdf["size"].to_numpy()
        own = _band(sizes, ratio)
        at = lambda b: np.array([depths.get(int(x), -1) for x in b], np.int64)
        depth = at(own)
        home = (own << 40) + tree.home(fps, depth)
        point, node = tree.overlapping(fps, depth, radius)
        shard = (own[point] << 40) + node
        point, shard = point[shard >= home[point]], shard[shard >= home[point]]
        if ratio:
            up = at(own + 1)
            some = np.flatnonzero(up >= 0)
            p, n = tree.overlapping(fps[some], up[some], radius)
            point, shard = np.concatenate([point, some[p]]), np.concatenate([shard, (own[some[p]] + 1 << 40) + n])
        return fps, sizes, home, point, shard

    def count(batches):
        for pdf in batches:
            _, _, home, _, shard = places(pdf)
            for kind, x in ((True, home), (False, shard)):
                values, n = np.unique(x, return_counts=True)
                yield pd.DataFrame({"shard": values, "resident": kind, "n": n})

    amounts = nodes.mapInPandas(count, "shard long, resident boolean, n long").groupBy("shard", "resident").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK)
    pieces = {(r["shard"], r["resident"]): -(-r["n"] // CHUNK) for r in amounts.collect()}  # the overfull shards only

    def deal(batches):
        for pdf in batches:
            fps, sizes, home, point, shard = places(pdf)
            ids = pdf["node"].to_numpy()
            out = []
            for resident, who, where in ((True, np.arange(len(home)), home), (False, point, shard)):
                order = np.argsort(where, kind="stable")
                who, where = who[order], where[order]
                cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
                for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                    s = int(where[a])
                    mine, other = pieces.get((s, resident), 1), pieces.get((s, not resident), 1)
                    chunk = ids[who[a:b]] % mine if mine > 1 else np.zeros(b - a, np.int64)
                    for c in np.unique(chunk):
                        x = who[a:b][chunk == c]
                        for o in range(other):
                            out.append((s, int(c) if resident else o, o if resident else int(c), resident, ids[x].tobytes(), fps[x].tobytes(), sizes[x].tobytes()))
            yield pd.DataFrame(out, columns=["shard", "i", "j", "resident", "nodes", "fps", "sizes"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(resident):
            own = pdf[pdf["resident"] == resident]
            n = np.frombuffer(b"".join(own["nodes"]), np.int64)
            return n, np.frombuffer(b"".join(own["fps"]), np.uint64).reshape(len(n), -1), np.frombuffer(b"".join(own["sizes"]), np.int64)

        if pdf["resident"].nunique() < 2:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        h, hf, hs = side(True)
        v, vf, vs = side(False)
        nodes_ = np.unique(np.concatenate([h, v]))
        forest, hi, vi = _Forest(len(nodes_)), np.searchsorted(nodes_, h), np.searchsorted(nodes_, v)
        for a in range(0, len(v), TILE):
            near = distances(vf[a : a + TILE], hf) <= radius
            if ratio:
                x, y = vs[a : a + TILE, None], hs[None, :]
                near &= np.minimum(x, y) >= ratio * np.maximum(x, y) - 1e-9
            rows = np.flatnonzero(near.sum(axis=1) > 0)
            for r in rows:
                hit = np.flatnonzero(near[r])
                if len(hit) > 1 or h[hit[0]] != v[a + r]:
                    forest.union(np.append(hi[hit], vi[a + r]))
        one, two = forest.edges(nodes_)
        return pd.DataFrame({"a": one, "b": two})

    return nodes.mapInPandas(deal, _DEALT).groupBy("shard", "i", "j").applyInPandas(compare, _LINKS)


def _shared_ids(marked: DataFrame) -> DataFrame:
    """Links among the nodes of each doc_id that has several. marked: doc_id, node."""
    pairs = marked.select("doc_id", "node").distinct()
    least = pairs.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("doc_id", "b")
    return pairs.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def simhash_components(df: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id and the links by SimHash alone."""
    docs = materialize(fingerprints(df, k), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("node"), F.lit(1).cast("long").alias("size")), "nodes")
    shared = _shared_ids(docs.join(nodes, "fp"))
    roots = components(links(nodes, radius).unionByName(shared))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return docs.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


# --- near duplicates by similarity of shingle sets -----------------------------------------------

#: 256 bits, of which two sets of similarity 0.8 differ in 39 on average (standard deviation 5.8; sets of four and five
#: shingles, whose bits tie, in about 64) and unrelated ones in 128 (8).
WIDE_WORDS, WIDE_RADIUS = 4, 84
_SETS = "part string, component long, node long, hashes binary, i int, j int, side int"
_PER_TASK = 1000


def _signatures(df: DataFrame, k: int) -> DataFrame:
    """doc_id, wide fingerprint of the distinct shingles, their number, and the exact digest of the words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.string()), ("size", pa.int64()), ("digest", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in arrow_rows(batch):
                h = np.unique(shingle_hashes(text, k))
                words = [fingerprint(mix(h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) if i else h) for i in range(WIDE_WORDS)]
                out.append((doc_id, "".join(f"{w:016x}" for w in words), len(h), xxhash.xxh3_128_hexdigest(b" ".join(text.encode().lower().split()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return documents(df).mapInArrow(run, "doc_id long, fp string, size long, digest string")


def _verified(members: DataFrame, df: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links of similarity or more among the members (component, node) of each candidate component: all pairs, exactly."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= _PER_TASK).agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(small) // (2 * _PER_TASK)))
    placed = members.join(sizes, "component").withColumn("chunks", F.ceil(F.col("n") / _PER_TASK).cast("int"))
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def sets(batches):
        for batch in batches:
            rows = [(d, np.unique(shingle_hashes(t, k)).tobytes()) for d, t in arrow_rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    wanted = documents(df).join(placed.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    own = placed.join(wanted.mapInArrow(sets, "node long, hashes binary"), "node")
    few = own.where("chunks = 1").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(parts))).alias("part"), "component", "node", "hashes", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    many = own.where("chunks > 1").withColumn("c", chunk).withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
    i, j = F.least("c", "o"), F.greatest("c", "o")
    many = many.select(F.concat_ws(":", "component", i, j).alias("part"), "component", "node", "hashes", i.alias("i"), j.alias("j"), F.when(F.col("c") == j, 1).otherwise(0).alias("side"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in pdf.groupby("component", sort=False):
            nodes = group["node"].to_numpy()
            sets_ = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
            size, side, across = np.array([len(x) for x in sets_]), group["side"].to_numpy(), group["i"].iloc[0] != group["j"].iloc[0]
            forest = _Forest(len(nodes))
            ends = np.cumsum(size)
            starts = ends - size
            _, ids = np.unique(np.concatenate(sets_), return_inverse=True)
            held = np.zeros(ids.max(initial=0) + 1, np.int64)
            for a in range(1, len(nodes)):
                ok = (np.minimum(size[a], size[:a]) >= similarity * np.maximum(size[a], size[:a]) - 1e-9)
                ok &= forest.label[:a] != forest.label[a]
                if across:
                    ok &= side[:a] != side[a]
                if not ok.any():
                    continue
                own = ids[starts[a] : ends[a]]
                held[own] = 1
                both = np.array([held[ids[starts[b] : ends[b]]].sum() for b in np.flatnonzero(ok)]) if ok.sum() < 8 else np.diff(np.concatenate([[0], np.cumsum(held[ids[: ends[a - 1]]])])[np.append(starts[:a], ends[a - 1])])[ok]
                held[own] = 0
                near = np.flatnonzero(ok)[both >= similarity * (size[a] + size[:a][ok] - both) - 1e-9]
                if len(near):
                    forest.union(np.append(near, a))
            found.append(np.stack(forest.edges(nodes)))
        one, two = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": one, "b": two})

    return few.unionByName(many).groupBy("part").applyInPandas(judge, _LINKS)


def near_duplicates(df: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, component_id: documents chained by k-word shingle sets of the similarity or more, or by a shared doc_id."""
    docs = materialize(_signatures(df, k), "signatures")
    nodes = materialize(docs.groupBy("fp", "size", "digest").agg(F.min("doc_id").alias("node")), "classes")
    proposed = components(links(nodes.select("node", "fp", "size"), radius, similarity))
    roots = proposed.select(F.col("root").alias("component")).distinct()
    members = proposed.select("node", F.col("root").alias("component")).unionByName(roots.select(F.col("component").alias("node"), "component"))
    shared = _shared_ids(docs.join(nodes, ["fp", "size", "digest"]))
    root = components(_verified(materialize(members, "members"), df, k, similarity).unionByName(shared))
    named = nodes.join(root, "node", "left").select("fp", "size", "digest", F.coalesce("root", "node").alias("component_id"))
    return docs.join(named, ["fp", "size", "digest"]).select("doc_id", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
