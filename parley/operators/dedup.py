"""Exact and near duplicates, their groups, and the leakage-safe split."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..functions import hashing
from ..storage import materialize
from .graph import connected_components

TOKEN = re.compile(r"[\w\[\]]+")


def first_of_equals(df: DataFrame, key: Column, ident: str) -> DataFrame:
    """df with duplicate_of: the smallest id of rows with an equal key, or null for that row.

    The groups are aggregated before the shuffle, and only groups of several rows are joined."""
    keyed = df.withColumn("_key", key)
    groups = keyed.groupBy("_key").agg(F.min(ident).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = materialize(groups, "copies")  # so that the join deals both sides anew and a hot group can be split
    return keyed.join(groups, "_key", "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col(ident), F.col("_first"))).drop("_key", "_first")


@lru_cache(maxsize=1 << 17)
def token_digest(token: str) -> bytes:
    """The first eight digest bytes, most significant first. The cache holds single tokens, of
    which texts repeat many, at most 131,072 of them in a worker; pairs are not kept."""
    return sha256(token.encode()).digest()[:8]


@pandas_udf(LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """SimHash of tokens and token pairs weighted by their counts; a bit is set where the
    weighted votes are not negative."""

    def one(text: str | None) -> int:
        tokens = TOKEN.findall((text or "").lower())
        if not tokens:
            return -1
        words, pairs = Counter(tokens), Counter(map(" ".join, zip(tokens, tokens[1:])))
        digests = b"".join([token_digest(w) if len(w) <= 40 else sha256(w.encode()).digest()[:8] for w in words])
        digests += b"".join([sha256(p.encode()).digest()[:8] for p in pairs])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little")
        weight = np.array([*words.values(), *pairs.values()], dtype=np.float64)
        votes = 2 * (weight @ bits.astype(np.float64)) - weight.sum()
        return int(np.packbits(votes >= 0, bitorder="little").view("<i8")[0])

    return texts.map(one)


def representatives(df: DataFrame, block: list[str], ident: str, fp: str) -> DataFrame:
    """The smallest id of each block and fingerprint."""
    return materialize(df.groupBy(*block, fp).agg(F.min(ident).alias("id")), "representatives")


def meeting_keys(fp: str, radius: int, bands: int) -> Column:
    """Array of keys of which two fingerprints within the radius share one: with `bands` bands
    and at most `radius` flipped bits, bands - radius bands stay whole."""
    assert bands > radius
    width = 64 // bands
    keys = []
    for n, chosen in enumerate(combinations(range(bands), bands - radius)):
        value = F.lit(n)
        for b in chosen:
            value = value * F.lit(1 << width) + hashing.band(F.col(fp), b, width)
        keys.append(value.cast("long"))
    return F.array(*keys)


def near_pairs(df: DataFrame, block: list[str], ident: str = "id", fp: str = "fp", radius: int = 6, bands: int = 8) -> DataFrame:
    """(a, b, distance) of representatives, a < b, within the radius in the same block.

    A representative is the smallest id of a block and fingerprint, so equal fingerprints make
    no pairs. With eight bands of eight bits and at most six flipped bits two bands stay whole,
    so candidates meet on pairs of bands (16 bits) and none is missed; blocks compare nulls as
    equal. The distance is checked before the pairs are made distinct. All pairs of a dense
    block come out; for components near_links does less."""
    spread = representatives(df, block, ident, fp).withColumn("key", F.explode(meeting_keys(fp, radius, bands)))
    # the keys multiply the rows, of which the planner knows only the size before that: no side is broadcast
    left, right = spread.alias("l"), spread.alias("r").hint("merge")
    same = F.expr(" and ".join([*(f"l.{c} <=> r.{c}" for c in block), "l.key = r.key", "l.id < r.id"]))
    distance = hashing.hamming(F.col(f"l.{fp}"), F.col(f"r.{fp}"))
    return left.join(right, same).where(distance <= radius).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), distance.alias("distance")).distinct()


def forest(ids: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: all are compared with the first, and
    those it does not reach with all others, so a dense group costs little more than its size."""
    root = np.arange(len(ids))
    near = np.bitwise_count(fps ^ fps[0]) <= radius
    root[near] = 0
    out = [(int(ids[i]), int(ids[0])) for i in np.flatnonzero(near)[1:]]
    for i in np.flatnonzero(~near):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_links(df: DataFrame, block: list[str], ident: str = "id", fp: str = "fp", radius: int = 6, bands: int = 8) -> DataFrame:
    """(a, b) links that connect the same representatives as all near_pairs do: a spanning
    forest for each block and key, whose number grows with the rows and not with the pairs."""
    reps = representatives(df, block, ident, fp)
    blocked = F.to_json(F.struct(*block)) if block else F.lit("")
    spread = reps.withColumn("key", F.explode(meeting_keys(fp, radius, bands))).select(blocked.alias("block"), "key", "id", F.col(fp).alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, fps, out = None, [], [], []

        def links() -> list[tuple[int, int]]:
            return forest(np.array(ids), np.array(fps, dtype=np.int64).view(np.uint64), radius) if len(ids) > 1 else []

        for b in batches:
            for block_, key, i, f in zip(*(c.to_pylist() for c in b.columns)):
                if (block_, key) != now:
                    out += links()
                    now, ids, fps = (block_, key), [], []
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                        out = []
                ids.append(i)
                fps.append(f)
        out += links()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2, names=["a", "b"])

    return spread.repartition("block", "key").sortWithinPartitions("block", "key").mapInArrow(run, "a long, b long")


def groups_of(df: DataFrame, pairs: DataFrame, block: list[str], ident: str = "id", fp: str = "fp") -> DataFrame:
    """(id, root) for every row: the smallest id reachable over pairs and equal fingerprints."""
    reps = df.groupBy(*block, fp).agg(F.min(ident).alias("rep"))
    roots = connected_components(pairs.select("a", "b"))
    named = reps.join(roots, F.col("rep") == F.col("node"), "left").select(*(F.col(c).alias(f"_{c}") for c in [*block, fp]), F.coalesce("root", "rep").alias("root"))
    same = F.expr(" and ".join(f"{c} <=> _{c}" for c in [*block, fp]))
    return df.join(named, same).select(F.col(ident).alias("id"), "root")


def group_hash(groups: DataFrame) -> DataFrame:
    """(root, n, group_id): the id is the hash of the sorted members, one per line. Members
    come sorted as a stream and feed the digest, so no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, digest, out = None, 0, None, []
        for b in batches:
            for root, member in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if root != now or digest is None:
                    if digest is not None:
                        out.append((now, n, digest.hexdigest()))
                    now, n, digest = root, 0, sha256()
                digest.update((member if n == 0 else "\n" + member).encode())
                n += 1
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["root", "n", "group_id"])
                out = []
        if digest is not None:
            out.append((now, n, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["root", "n", "group_id"])

    members = groups.select(F.col("root").cast("long").alias("root"), F.col("id").cast("string").alias("member"))
    return members.repartition("root").sortWithinPartitions("root", "member").mapInArrow(run, "root long, n long, group_id string")


def split_breakdown(df: DataFrame) -> DataFrame:
    """Rows by split and source, and by split and label."""
    return df.groupingSets([["split", "source"], ["split", "label"]], "split", "source", "label").agg(F.count("*").alias("n"))


def leaking_groups(df: DataFrame) -> DataFrame:
    """Groups seen in more than one split; there should be none."""
    seen = df.groupBy("group_id", "split").count().groupBy("group_id").agg(F.count("*").alias("splits"))
    return seen.where("splits > 1")
