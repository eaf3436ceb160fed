"""SimHash near-dedup: BK-trees over shards of fingerprints, then components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, tidy

BANDS = 4


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of word shingles (repeats count): ASCII lower case, words split at ASCII white
    space; fewer words than a shingle form one shingle; no words give 0. A bit is set if it is
    set in over half of the shingle hashes (XXH64 with the seed)."""
    w = text.lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [h(b" ".join(w), seed)]
    else:
        join = b" ".join
        hashes = [h(join(t), seed) for t in zip(*(w[i:] for i in range(words)))]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word of the bits that are set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"", words, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree over 64-bit words: children keyed by their Hamming distance to
    the parent. link() joins words within the radius into one component and skips subtrees
    that already lie wholly in the component of the word asked for."""

    def __init__(self, words: list[int]):
        self.words, self.children = words, [None] * len(words)
        self.parent = list(range(len(words)))
        self.whole = [-1] * len(words)
        for i in range(1, len(words)):
            x, at = words[i], 0
            while True:
                d = (words[at] ^ x).bit_count()
                kids = self.children[at]
                if kids is None:
                    self.children[at] = {d: i}
                    break
                nxt = kids.get(d)
                if nxt is None:
                    kids[d] = i
                    break
                at = nxt

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def near(self, x: int, radius: int) -> list[int]:
        """All positions within the radius of x."""
        out, stack = [], [0] if self.words else []
        while stack:
            i = stack.pop()
            d = (self.words[i] ^ x).bit_count()
            if d <= radius:
                out.append(i)
            for e, c in (self.children[i] or {}).items():
                if d - radius <= e <= d + radius:
                    stack.append(c)
        return out

    def settle(self) -> None:
        """Mark the subtrees that lie wholly in one component."""
        for i in range(len(self.words) - 1, -1, -1):
            root = self.find(i)
            same = all(self.whole[c] >= 0 and self.find(self.whole[c]) == root for c in (self.children[i] or {}).values())
            self.whole[i] = root if same else -1

    def link(self, radius: int) -> None:
        words, children, whole, find, n = self.words, self.children, self.whole, self.find, len(self.words)
        every = max(256, n // 32)
        for q in range(n):
            if n > 64 and (q & (q - 1) == 0 or q % every == 0):
                self.settle()
            x, stack = words[q], [0]
            while stack:
                i = stack.pop()
                if whole[i] >= 0 and find(whole[i]) == find(q) and i != q:
                    continue
                d = (words[i] ^ x).bit_count()
                if d <= radius and i != q:
                    a, b = find(i), find(q)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                kids = children[i]
                if kids:
                    for e, c in kids.items():
                        if d - radius <= e <= d + radius:
                            stack.append(c)


def shard_links(members: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(member, representative) of every component with several members in one shard."""
    if len(members) < 2:
        return
    mask = (1 << 64) - 1
    tree = BKTree([m & mask for m in members])
    tree.link(radius)
    for i in range(len(members)):
        r = tree.find(i)
        if r != i:
            yield members[i], members[r]


def split_shards(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (key, rest, fp) of shards that are too large, dealt anew by a band of the `bits` bits
    in which their words can still differ: equal key, and all but those bits agree."""
    width = bits // BANDS
    out = []
    for b in range(BANDS):
        at, n = b * width, width if b < BANDS - 1 else bits - (BANDS - 1) * width
        value = F.expr(f"shiftrightunsigned(rest, {at}) & {(1 << n) - 1}L")
        low = F.expr(f"rest & {(1 << at) - 1}L")
        high = F.expr(f"shiftleft(shiftrightunsigned(rest, {at + n}), {at})") if at + n < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.xxhash64("key", F.lit(b), value).alias("key"), high.bitwiseOR(low).alias("rest")))
    return rows.select("fp", F.explode(F.array(*out)).alias("x")).select("x.key", "x.rest", "fp")


def shards_of(distinct: DataFrame, most: int, levels: int = 3) -> DataFrame:
    """(key, fp) of the shards that hold several words. A shard of more than `most` words is
    dealt again by four bands of its remaining bits, which words in reach cannot all differ in."""
    rows, bits = split_shards(distinct.select(F.lit(0).alias("key"), F.col("fp").alias("rest"), "fp"), 64), 64
    done = None
    for level in range(levels):
        bits -= bits // BANDS
        if level == levels - 1:
            break
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
        hot = materialize(sizes.select("key"), "hot_shards")
        if hot.isEmpty():
            break
        rows = materialize(rows, "shards")
        cold = rows.join(hot, "key", "left_anti").select("key", "fp")
        done = cold if done is None else done.unionByName(cold)
        rows = split_shards(rows.join(hot, "key", "left_semi"), bits)
    rows = rows.select("key", "fp")
    return rows if done is None else done.unionByName(rows)


def link_fingerprints(distinct: DataFrame, radius: int = 3, most: int = 20_000) -> DataFrame:
    """Links a, b that connect all fingerprints (column fp, distinct) within the radius.

    Words at most 3 bits apart agree in one of 4 bands of 16 bits, so a shard is a band and
    its value; shards of over `most` words are split by bands of their other bits, up to two
    times. Each shard's tree goes only to the task that asks it, by the shuffle: the trees
    together hold every fingerprint, which no broadcast bounds. A shard yields a spanning
    forest, not its pairs.
    """
    assert radius < BANDS, "the bands find words that differ in fewer bits than there are bands"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, a, b = None, [], [], []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if keys[lo] != key:
                    for m, r in shard_links(held, radius):
                        a.append(m)
                        b.append(r)
                    key, held = keys[lo], []
                held += fps[lo:hi].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        for m, r in shard_links(held, radius):
            a.append(m)
            b.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return shards_of(distinct, most).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


@tidy
def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` differing
    bits, the row's own included. Rows with a null doc_id take part and get the smallest
    non-null id of their component, or null if there is none. Rows with a repeated doc_id keep
    one fingerprint each. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), radius))
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # what is joined is stored first, so that a giant component or a print of very many rows can be split
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(linked.join(least, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
