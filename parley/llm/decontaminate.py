"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, without_rows

HITS = "doc_id long, tie long, item_id long, distance int, budget int, first_char long, end_char long"


def normalize(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their places: a text
    within `budget` edits of the item holds one of them unchanged."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to a part of the text and the end of the first such
    part, or None if it exceeds `most`. One Python integer holds a column's bits."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = (m, 0) if m <= most else (most + 1, -1)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(h | up))
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(x | plus))
        down = plus & x
        if score < best:
            best, at = score, j + 1
            if not score:
                break
    return (best, at) if best <= most else None


def match_start(pattern: str, text: str, end: int, distance: int) -> int:
    """Where the part that ends at `end` begins: the longest-to-shortest choice that gives the
    distance, found by matching backwards."""
    lo = max(0, end - len(pattern) - distance)
    back = myers(pattern[::-1], text[lo:end][::-1], distance)
    return end - back[1] if back else lo


class Matcher:
    """Finds items of one block in texts. Items of fewer than `short` characters are looked for
    verbatim and as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= short else 0) for i, t in items]
        self.short = short
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                places.setdefault(piece, []).append((k, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, first, end) of the best place of each item found."""
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end + 1 - n - at)
        out = []
        for k, places in starts.items():
            item, t, budget = self.items[k]
            if len(t) < self.short:
                whole = [s for s in sorted(places) if not text[max(0, s - 1) : s].isalnum() and not text[s + len(t) : s + len(t) + 1].isalnum()]
                out += [(item, 0, 0, s, s + len(t)) for s in whole[:1]]
                continue
            best = None
            spans: list[list[int]] = []
            for s in sorted(places):
                lo, hi = max(0, s - budget), min(len(text), s + len(t) + 2 * budget)
                if spans and lo <= spans[-1][0] + budget:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                exact = text.find(t, lo, hi)
                found = (0, exact - lo + len(t)) if exact >= 0 else myers(t, text[lo:hi], budget if best is None else best[0] - 1)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
                    if not found[0]:
                        break
            if best:
                out.append((item, best[0], budget, match_start(t, text, best[1], best[0]), best[1]))
        return out


def packed_blocks(benchmark: DataFrame, block_chars: int) -> list[bytes]:
    """The normalised items in compressed blocks of at most `block_chars` characters (or one
    longer item). Items without a word are left out."""
    blocks, held, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        t = normalize(r["text"] or "")
        if held and size + len(t) > block_chars:
            blocks.append(zlib.compress(json.dumps(held).encode()))
            held, size = [], 0
        if t:
            held.append((r["item_id"], t))
            size += len(t)
    if held:
        blocks.append(zlib.compress(json.dumps(held).encode()))
    return blocks


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, short: int = 40, block_chars: int = 1 << 20, chunk_chars: int = 16 << 20) -> DataFrame:
    """doc_id, tie (XXH64 of the text), item_id, distance, budget, first_char, end_char: one row
    for each document and item it holds within int(rate * length) edits, at the place of least
    distance (the first of equals, in characters of the lower-cased text with single spaces).
    Items of fewer than `short` characters count where they stand verbatim as whole words, at
    the first such place.

    Items are a stated query set. It is packed in compressed blocks of at most `block_chars`
    characters that go to the workers as one broadcast, about a third of the benchmark's size;
    a task reads and normalises each document once and holds one block's automaton at a time,
    which several blocks build for every `chunk_chars` of text. Documents never move. Null and
    empty items name nothing; null texts hold nothing; very long texts are searched whole; rows
    without a doc_id are reported with a null; repeated rows are reported each; repeated items
    likewise; empty tables give an empty result.
    """
    blocks = packed_blocks(benchmark, block_chars)
    spark = docs.sparkSession
    if not blocks:
        return spark.createDataFrame([], HITS)
    shared = spark.sparkContext.broadcast(blocks)
    names, kinds = [x.split()[0] for x in HITS.split(", ")], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        matchers = lambda: (Matcher([tuple(x) for x in json.loads(zlib.decompress(b))], rate, short) for b in packed)
        only = next(matchers()) if len(packed) == 1 else None

        def found(held: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
            rows = [(doc, tie, *hit) for matcher in ([only] if only else matchers()) for doc, tie, text in held for hit in matcher.search(text)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

        held, size = [], 0
        for b in batches:
            for doc, tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.append((doc, tie, normalize(text.as_py() or "")))
                size += len(held[-1][2])
                if size >= (1 << 20 if only else chunk_chars):
                    yield found(held)
                    held, size = [], 0
        yield found(held)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns.

    Rows are judged each by its own text, those with null or shared ids too; null and empty
    texts stay, very long ones are searched whole, of repeated rows all go or stay; an empty
    table gives an empty result."""
    hits = materialize(benchmark_hits(docs, benchmark, **params).select("doc_id", "tie").distinct(), "hits")
    return without_rows(docs, hits)
