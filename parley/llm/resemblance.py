"""Near-dedup of texts by SimHash and BK-trees at a Jaccard similarity of 0.8 and more.

First the SimHash step of op1: BK-trees over shards of the fingerprints of five-word shingles find
what lies within three bits. Sets of similarity 0.8 have fingerprints that differ in about ten of
64 bits, more than the bands of a fingerprint can find. The rest therefore meets in shards of
MinHash bands, which sets of that similarity share. In the buckets of both a BK-tree of the
fingerprints is asked with a wide radius, following only edges within it, and what it finds is
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, tidy, without_rows
from .simhash import BKTree, link_fingerprints, majority

BANDS, BAND_ROWS = 32, 6
FILTER_BITS = 22
# fixed values: odd factors, which permute the 64-bit words
FACTORS = np.random.default_rng(42).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles: ASCII lower case, words split at ASCII
    white space; fewer words than a shingle form one shingle; no words give none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h(join(w), seed)], dtype=np.uint64)
    return np.unique(np.fromiter((h(join(t), seed) for t in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of least permuted hashes. Sets of similarity j share a band with
    probability 1 - (1 - j ** BAND_ROWS) ** BANDS: 0.99994 at 0.8, the lowest that counts."""
    least = np.full(len(FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, np.multiply.outer(FACTORS, s[at : at + 1024]).min(axis=1), out=least)
    least = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)], dtype=np.uint64).view(np.int64)


def compact(s: np.ndarray) -> bytes:
    """The set for comparison: the upper halves of its hashes, sorted. Two sets of n shingles
    count n * n / 2**32 shared ones too many on average."""
    return np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes()


def sketches(docs: DataFrame, words: int, seed: int, whole: bool) -> DataFrame:
    """doc_id, tie (a hash of the text) and node (a hash of the shingle set) of every row, with
    fp and the bands' keys, or with the compact set (whole). Null text counts as empty."""
    kinds = "doc_id long, tie long, node long, " + ("members binary" if whole else "fp long, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                sets = [shingles(t.as_py() or b"", words, seed) for t in part.column(2).cast(pa.large_binary())]
                node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64))
                if whole:
                    more = {"members": pa.array([compact(s) for s in sets], pa.binary())}
                else:
                    fp = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
                    more = {"fp": pa.array(fp), "bands": pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "tie": part.column(1), "node": node, **more})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, kinds)


def print_buckets(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """key, node: buckets of the SimHash step. BK-trees over shards of the fingerprints (node, fp)
    connect those within the radius; a bucket is a fingerprint with all that a tree led to it, and
    all nodes of these fingerprints. Four shards hold a fingerprint, so its buckets are few."""
    near = materialize(link_fingerprints(nodes.select("fp").distinct(), radius).distinct(), "print_links")
    shared = nodes.groupBy("fp").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("fp", F.col("fp").alias("led"))
    led = near.select(F.col("a").alias("fp"), F.col("b").alias("led")).unionByName(near.select(F.col("b").alias("fp"), F.col("b").alias("led"))).unionByName(shared)
    led = materialize(led.distinct(), "print_groups")
    return led.join(nodes, "fp").select(F.xxhash64(F.lit("print"), "led").alias("key"), "node")


class Shard:
    """A part of a bucket's members: fingerprints in a BK-tree, sets end to end."""

    def __init__(self, nodes: list[int], fps: list[int], sets: list[np.ndarray], radius: int, least: float):
        self.nodes, self.radius, self.least = nodes, radius, least
        self.fps, self.sets = np.array(fps, dtype=np.int64).view(np.uint64), sets
        self.sizes = np.array([len(s) for s in sets])
        self.tree: BKTree | None = None

    def alike(self, s: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Those of the places whose set has the least similarity to s, by exact comparison."""
        if not len(places) or not len(s):
            return places[:0]
        sizes = self.sizes[places]
        fit = (sizes >= self.least * len(s) - 1e-9) & (len(s) >= self.least * sizes - 1e-9)
        out = []
        for p in places[fit].tolist():
            mine = self.sets[p]
            at = np.searchsorted(s, mine)
            both = int((s[np.minimum(at, len(s) - 1)] == mine).sum())
            if both >= self.least * (len(s) + len(mine) - both) - 1e-9:
                out.append(p)
        return np.array(out, dtype=np.int64)

    def of_first(self) -> np.ndarray:
        """Places linked to the first member."""
        near = np.bitwise_count(self.fps ^ self.fps[0]) <= self.radius
        return self.alike(self.sets[0], np.flatnonzero(near[1:]) + 1)

    def of(self, fp: int, s: np.ndarray) -> np.ndarray:
        """Places linked to a set, found by the tree."""
        if self.tree is None:
            self.tree = BKTree(self.fps.tolist())
        return self.alike(s, np.array(sorted(self.tree.near(fp & (2**64 - 1), self.radius)), dtype=np.int64))


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[list], list[list]]]:
    """((key, part), members, asking) of each shard in sorted rows (key, part, kind, node, fp,
    members, parts). Members are at most a shard's; those that ask follow in blocks, with the members
    again."""
    now, held, asking = None, [], []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            at = row[:2]
            if at != now:
                if now is not None:
                    yield now, held, asking
                now, held, asking = at, [], []
            (asking if row[2] == 2 else held).append([row[3], row[4], np.frombuffer(row[5], dtype=np.uint32), row[6]])
            if len(asking) >= 500:
                yield now, held, asking
                asking = []
    if now is not None:
        yield now, held, asking


class Forest:
    """Components that grow by links."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, i: int) -> int:
        p = self.parent
        while (up := p.setdefault(i, i)) != i:
            p[i] = p.setdefault(up, up)
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the link joins two components."""
        a, b = self.find(i), self.find(j)
        self.parent[a] = b
        return a != b


def link_shards(rows: DataFrame, radius: int, least: float, asked: bool) -> DataFrame:
    """Links within shards: a, b, key (null), and, unless others ask, members of buckets of
    several parts that no links of their shard connect with the bucket's first one: a, null, key.

    Every member is compared with the first; those not connected with it ask the shard's tree. A
    pair passed over has both ends connected with the first, so a dense group costs little more
    than its size, and no link between components is missed. A shard gives a spanning forest of
    its links, also where others ask: fewer rows than it reads."""
    names = ["a", "b", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, forest = None, Forest()
        for at, held, asking in shard_rows(batches):
            if not held:
                continue
            if at != now:
                now, forest = at, Forest()
                nodes, fps, sets, parts = (list(c) for c in zip(*held))
                shard = Shard(nodes, fps, sets, radius, least)
            if asked:
                for node, fp, s, _ in asking:
                    out += [(node, nodes[p], None) for p in shard.of(fp, s).tolist() if forest.join(node, nodes[p])]
            else:
                out += [(nodes[p], nodes[0], None) for p in shard.of_first().tolist() if forest.join(nodes[p], nodes[0])]
                for p in range(1, len(nodes)):
                    if forest.find(nodes[p]) != forest.find(nodes[0]):
                        out += [(nodes[p], nodes[q], None) for q in shard.of(fps[p], sets[p]).tolist() if forest.join(nodes[p], nodes[q])]
                if parts[0] > 1:
                    first = forest.find(nodes[0])
                    out += [(n, None, at[0]) for n in nodes if forest.find(n) != first]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=names)

    ordered = rows.select("key", "part", "kind", "node", "fp", "members", "parts").repartition("key", "part").sortWithinPartitions("key", "part", "kind", "node")
    return ordered.mapInArrow(run, "a long, b long, key long")


def in_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """Slots of the keys as rows (word, mask): at most 2**FILTER_BITS / 64, whatever the input."""
    slot = F.pmod(key, F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    return keys.select(F.shiftright(slot, 6).alias("_word"), bit.alias("mask")).groupBy("_word").agg(F.bit_or("mask").alias("_mask"))


@tidy
def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42, radius: int = 24, shard: int = 1024) -> DataFrame:
    """doc_id, tie (XXH64 of the text) and component_id of every row: the smallest doc_id
    reachable over links, null where no row of the component has one.

    Rows are linked where the Jaccard similarity of their sets of word shingles is at least
    `least` (the bands are made for 0.8 and more); texts without words are alike, null counts as
    empty; an empty table gives an empty result. At 0.8 a pair's fingerprints differ in over 24
    bits with probability 1e-7. Buckets of the same members are compared once. A bucket of more
    than `shard` members is dealt to several tasks, each with the bucket's first member; what no
    links of its part connect with that one is then compared with the other parts too."""
    assert least >= 0.8, "the bands find sets of a similarity of 0.8 or more"
    rows = materialize(sketches(docs, words, seed, False), "sketches")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    prints = materialize(print_buckets(nodes.where(F.size("bands") > 0).select("node", "fp")), "prints")
    keys = prints.unionByName(nodes.select(F.explode("bands").alias("key"), "node"))
    kinds = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("x")).where("n > 1")
    once = materialize(kinds.groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "n", "lo"), "kinds")
    asked = keys.join(once, "key").withColumn("parts", F.ceil(F.col("n") / shard).cast("int"))
    asked = materialize(asked.select("key", "node", (F.col("node") == F.col("lo")).alias("head"), "parts"), "asked")
    # only rows of nodes that share a bucket are read again; ids reach the scan as a bitmap
    members_of = materialize(asked.select("node").distinct().join(nodes.select("node", "fp"), "node"), "asked_nodes")
    ids = rows.join(members_of, "node", "left_semi")
    bitmap = materialize(in_bitmap(ids, F.xxhash64("doc_id")), "bitmap")
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << FILTER_BITS))
    again = docs.select("doc_id", "text").withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "_word")
    again = again.where(F.expr(f"shiftright(_mask, cast(pmod(xxhash64(cast(doc_id as long)), {1 << FILTER_BITS}) & 63 as int)) & 1L = 1L"))
    sets = sketches(again.select("doc_id", "text"), words, seed, True).join(members_of, "node")
    sets = materialize(sets.groupBy("node").agg(F.first("fp").alias("fp"), F.first("members").alias("members")), "sets")
    own = F.when(F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    dealt = asked.join(sets, "node").select("key", F.explode(own).alias("part"), F.when(F.col("head"), 0).otherwise(1).alias("kind"), "node", "fp", "members", "parts")
    found = materialize(link_shards(dealt, radius, least, False), "shard_links")
    links = found.where("b is not null").select("a", "b")
    large = materialize(asked.where("parts > 1").select("key", "parts").distinct(), "large")
    if not large.isEmpty():
        open_ = found.where("b is null").select(F.col("a").alias("node"), "key").join(large, "key")
        asking = open_.join(sets, "node").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("kind"), "node", "fp", "members", "parts")
        links = links.unionByName(link_shards(dealt.join(large.select("key"), "key", "left_semi").unionByName(asking), radius, least, True).select("a", "b"))
    return name_components(rows, nodes, connected_components(links), ["doc_id", "tie"])


def name_components(rows: DataFrame, nodes: DataFrame, roots: DataFrame, keep: list[str]) -> DataFrame:
    """rows with component_id, the least id of their node's component. What is joined is stored
    first, so a giant component or node can be split."""
    linked = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "linked")
    ids = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = materialize(linked.join(ids, "root").select("node", "component_id"), "named")
    return rows.join(named, "node").select(*keep, "component_id")


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component (see near_copies)
    the rows with the smallest doc_id.

    Rows without a doc_id stay only where no row of their component has one; rows that repeat a
    kept doc_id stay. Null and empty texts are alike, very long ones are compared whole; an
    empty table gives an empty result."""
    found = near_copies(docs, **params)
    lost = materialize(found.where("not doc_id <=> component_id").select("doc_id", "tie").distinct(), "lost")
    return without_rows(docs, lost)
