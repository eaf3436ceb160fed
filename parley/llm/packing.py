"""Pattern packing: repeat counts of few-document length patterns by non-negative least squares."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, tie long"


MARKS = b".,;:!?%#*&$()"
ENTRY_BYTES = 200  # of a cached word beside its bytes: two byte strings' heads and a place in a dict


def stem_length(word: bytes) -> int:
    """Bytes before the marks at a word's end, or 0 if there are none or what stands before them
    is not surely a letter (ASCII, or Latin-1 in UTF-8 but for the two signs among them)."""
    n = len(word.rstrip(MARKS))
    if not 0 < n < len(word):
        return 0
    last = word[n - 1]
    latin = n > 1 and word[n - 2] == 0xC3 and last >= 0x80 and last not in (0x97, 0xB7)
    return n if 97 <= last <= 122 or latin else 0


def tokenizer_here(path: str) -> WordTokenizer:
    """This worker process's tokenizer, kept with its cache from task to task."""
    kept = sys.__dict__.setdefault("_parley_tokenizers", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes for themselves, the others by letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


WORD_END, MARK = "</w>", b"\xff"  # a word's end in the vocabulary, and as a byte no UTF-8 text holds


def merge_table(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes for a byte-level BPE vocabulary with marked word ends whose merges stand in
    the order of their ids, or None for any other model. Merging the pair of the least joint id
    then gives the tokenizer's ids: a joint has one merge, and bytes within a span merge alike
    with and without what surrounds it."""
    vocab, merges, letter = model.get("vocab"), model.get("merges"), byte_letters()
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or model.get("dropout") or model.get("byte_fallback"):
        return None
    joint = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if None in joint or joint != sorted(set(joint)) or joint[0] < 512:
        return None
    table = {}
    for token, i in vocab.items():
        core = token.removesuffix(WORD_END)
        if i < joint[0] or i in range(joint[0], joint[-1] + 1):
            if not all(c in letter for c in core):
                return None
            table[bytes(letter[c] for c in core) + (MARK if core != token else b"")] = i
    single = all(bytes([b]) in table and bytes([b]) + MARK in table for b in range(255))
    return table | {MARK: max(vocab.values()) + 1} if single and len(table) == len(joint) + 512 else None


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are the ids
    of its words in order. It folds case by itself, so words are looked up in lower case, but
    not in texts that hold the lower-case form of an added token, which only its own spelling
    names. Words are looked up in a cache of two halves: a half that has reached its bytes
    becomes the older one, so frequent words stay; long words are not cached. Marks that end a
    word are a token group of their own for the tokenizer and are looked up apart (see
    stem_length). Words of Latin, Greek or Cyrillic letters are one group each and are merged
    by merge_table; all others go through the tokenizer itself.
    """

    def __init__(self, path: str, cache_bytes: int = 48 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        encode, older, half, spent = model.encode_batch_fast, {}, cache_bytes // 2, [0]
        self.added = [t.content.lower().encode() for t in model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            table = merge_table(json.load(f)["model"])
        merged = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece if table else None

        def ids_of(word: bytes) -> bytes:
            text = word.decode("utf-8", "replace")
            if merged and len(word) <= longest:
                low = text.lower() if text.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", text))
                if low.isalpha() and max(low) < "\u0500":
                    return array("I", merged(low.encode() + MARK)).tobytes()
            return array("I", encode([text], add_special_tokens=False)[0].ids).tobytes()

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = older.get(word)
                if ids is None:
                    n = stem_length(word)
                    ids = self[word[:n]] + self[word[n:]] if n else ids_of(word)
                if len(word) <= longest:
                    spent[0] += len(word) + len(ids) + ENTRY_BYTES
                    if spent[0] > half:
                        older.clear()
                        older.update(self)
                        self.clear()
                        spent[0] = 0
                    self[word] = ids
                return ids

        self.words, self.older = Words(), older

    def encode(self, text: bytes) -> bytes:
        low = text.lower()
        if any(t in low for t in self.added):
            low = text
        return b"".join(map(self.words.__getitem__, low.split()))


def tokenized_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids, then end_id, cut every `limit` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer_here(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = ([], [], [], [], [], [])
                for doc, tie, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).cast(pa.large_binary())):
                    ids = model.encode(text.as_py() or b"") + end
                    for piece, lo in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[lo : lo + 4 * limit]
                        for col, v in zip(rows, (doc, piece, lo // 4, len(part) // 4, zlib.crc32(part), tie)):
                            col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.xxhash64("text").alias("tie")).mapInArrow(run, PIECES)


def length_patterns(rest: np.ndarray, limit: int, waste: int, most: int) -> list[tuple[int, ...]]:
    """The `most` patterns that explain most of `rest` (what is left of each length's count).

    A pattern is a multiset of up to three present lengths that fills a sequence but for `waste`
    ids: a full piece, a length with its longest partner, or any pair of lengths with the
    longest third. Every pair is looked at, a block of the table of pairs at a time."""
    lengths = np.flatnonzero(rest)
    fits = np.zeros(limit + 1, dtype=np.int64)  # the longest present length of at most that many, or 0
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits)
    value = rest.copy()
    value[0] = 0.0
    best: list[tuple[float, tuple[int, ...]]] = []

    def add(parts: np.ndarray) -> None:
        total = parts.sum(axis=1)
        parts = parts[(total <= limit) & (total >= limit - waste)]
        gain = value[parts].sum(axis=1)
        parts, gain = parts[gain > 0], gain[gain > 0]
        order = np.lexsort((*parts.T, -gain))[:most]
        best.extend((g, tuple(sorted((n for n in p if n), reverse=True))) for g, p in zip(gain[order].tolist(), parts[order].tolist()))
        best.sort(key=lambda x: (-x[0], x[1]))
        del best[most:]

    alone = np.stack([lengths, fits[limit - lengths], np.zeros_like(lengths)], axis=1)
    add(alone)
    for lo in range(0, len(lengths), 128):
        a = np.repeat(lengths[lo : lo + 128], len(lengths))
        b = np.tile(lengths, len(lengths[lo : lo + 128]))
        a, b = a[(b <= a) & (a + b < limit)], b[(b <= a) & (a + b < limit)]
        c = fits[np.minimum(limit - a - b, b)]
        add(np.stack([a, b, c], axis=1)[c > 0])
    return list(dict.fromkeys(p for _, p in best))


def fitted_counts(histogram: np.ndarray, limit: int, waste: int, rounds: int = 8, each: int = 2000, sweeps: int = 4) -> list[tuple[tuple[int, ...], float]]:
    """Patterns with repeat counts x >= 0 that lower |A x - h| (column j of A counts the lengths
    of pattern j): non-negative least squares by cyclic coordinate descent over a growing set
    of patterns, to which each round adds the `each` that explain most of what is left."""
    rest = histogram.astype(float)
    columns: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
    x: dict[tuple[int, ...], float] = {}
    left = rest.tolist()
    for _ in range(rounds):
        there = np.where(histogram > 0, np.array(left), 0.0)
        there[(histogram > 0) & (there == 0.0)] = -1e-9  # a length that is used up is still present
        new = [p for p in length_patterns(there, limit, waste, each) if p not in x]
        for p in new:
            columns[p] = [(n, p.count(n)) for n in set(p)]
            x[p] = 0.0
        for _ in range(sweeps):
            for p, column in columns.items():
                step = max(-x[p], sum(v * left[n] for n, v in column) / sum(v * v for _, v in column))
                if step:
                    x[p] += step
                    for n, v in column:
                        left[n] -= v * step
        if not new:
            break
    return list(x.items())


def packing_plan(histogram: dict[int, int], limit: int, waste: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that use every piece exactly once.

    Patterns leave at most `waste` ids of a sequence empty (limit / 256 unless given). Their
    fitted counts are rounded down and held to the pieces that are left; what is left over is
    packed best-fit, longest first, one pattern for as many repeats as its lengths allow. The
    steps depend on the number of distinct lengths (at most `limit`), not on the documents."""
    waste = limit // 256 if waste is None else waste
    stock = np.zeros(limit + 1, dtype=np.int64)
    for n, c in histogram.items():
        stock[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(p: tuple[int, ...], k: int) -> None:
        k = min(k, *(int(stock[n]) // p.count(n) for n in set(p)))
        if k > 0:
            plan.append((p, k))
            for n in p:
                stock[n] -= k

    for p, x in sorted(fitted_counts(stock, limit, waste), key=lambda t: (-sum(t[0]), -t[1], t[0])):
        take(p, int(x + 1e-6))
    high = limit
    while True:
        while high > 0 and stock[high] == 0:
            high -= 1
        if high <= 0:
            break
        p, room, free = [high], limit - high, stock.copy()
        free[high] -= 1
        while room > 0:
            there = np.flatnonzero(free[1 : room + 1])
            if not len(there):
                break
            n = int(there[-1]) + 1
            p.append(n)
            free[n] -= 1
            room -= n
        take(tuple(p), int(stock[high]))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, repeats, first sequence and offset of each slot it has in
    the plan. Ranks [first, first + repeats) of the length go to the sequences in order."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p, k in plan:
        at = 0
        for n in p:
            slots.setdefault(n, []).append((used.get(n, 0), k, sequence, at))
            used[n] = used.get(n, 0) + k
            at += n
        sequence += k
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in slots.items()}


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of at most `limit` ids as the plan finds.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text
    counts as empty (the end id alone); null doc_ids and repeated rows are packed like others;
    an empty table gives an empty result.

    The driver sees only the histogram of lengths (at most `limit` rows) and the plan, whose
    size depends on `limit`. Pieces get their rank among those of their length from counts per
    stored block, so no task sees all pieces of one length. Those counts grow with the blocks, so
    they are merged, not broadcast.
    """
    pieces = materialize(
        tokenized_pieces(docs, tokenizer, limit, end_id).withColumn("block", F.spark_partition_id()), "pieces"
    )
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(histogram, limit)
    slots = plan_slots(plan)
    before = counts.selectExpr("length", "block", "sum(n) over (partition by length order by block rows between unbounded preceding and current row) - n as base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            length, block, base = (b.column(i).to_numpy() for i in (3, 5, 6))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)]):
                if lo == hi:
                    continue
                key = (int(length[lo]), int(block[lo]))
                seen = seen if key == last else 0
                rank = int(base[lo]) + seen + np.arange(hi - lo, dtype=np.int64)
                first, _, start, at = slots[key[0]]
                k = np.searchsorted(first, rank, side="right") - 1
                sequence[lo:hi], offset[lo:hi] = start[k] + rank - first[k], at[k]
                last, seen = key, seen + hi - lo
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a (length, block) group is part of one stored block, so it is bounded by a partition
    ranked = (
        pieces.join(before.hint("merge"), ["length", "block"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", "block", "base", "tie")
        .repartition("length", "block")
        .sortWithinPartitions("length", "block", "doc_id", "piece", "tie")
        .drop("tie")
    )
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))
