"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items are cut into word n-grams. Their document frequencies are counted over all documents; the
rarest of each item are its seeds. Where a document has a seed, the stretch around it is aligned
with the item, word by word, and a stretch that scores high enough is a copy, edited or not.
The items are a stated query set: they go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small, written
from .textops import ALNUM_LOWER, chunks, grams, within, words

MATCH, MISMATCH, GAP = 2, -1, -1
# Of items that go to the tasks at a time: about 150 MB of arrays.
BLOCK_ITEMS, BLOCK_CHARS = 1_000_000, 32_000_000
PAIRS = 256  # alignments at a time


@dataclass
class Seeds:
    """N-grams of one length, sorted, and where the items have them: ``key[i]`` is at the places
    ``start[i]:start[i + 1]`` of ``item`` and ``at``."""

    key: np.ndarray
    start: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, item: np.ndarray, at: np.ndarray) -> Seeds:
        order = np.lexsort((at, item, gram))
        key, start = np.unique(gram[order], return_index=True)
        return cls(key, np.append(start, len(order)), item[order].astype(np.int32), at[order].astype(np.int32))

    def gram(self) -> np.ndarray:
        return np.repeat(self.key, np.diff(self.start))


class Items:
    """A block of items as arrays: their words' hashes, and the n-grams that may serve as seeds."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        self.ids, codes = ids, [np.zeros(0, np.uint64)]
        for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
            w = words(data, offsets, ALNUM_LOWER, fold=True)
            codes += [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(offsets) - 1)]
        size = np.array([len(c) for c in codes[1:]], np.int64)
        self.words, self.first = np.concatenate(codes), np.append(0, np.cumsum(size))
        owner, nth = np.repeat(np.arange(len(size)), size), np.arange(len(self.words)) - np.repeat(self.first[:-1], size)
        self.seeds: dict[int, Seeds] = {}
        for k in range(1, n + 1):  # shorter items are their own seeds
            here = np.flatnonzero(within(owner, k) & ((size[owner[: len(owner) - k + 1]] == k) | (k == n))) if len(owner) >= k else []
            if len(here):
                self.seeds[k] = Seeds.of(grams(self.words, k)[here], owner[here], nth[here])

    def code(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]

    def keys(self) -> dict[int, np.ndarray]:
        return {k: x.key for k, x in self.seeds.items()}

    def keep_rare(self, frequency: dict[int, np.ndarray], share: float, run: int) -> None:
        """Keeps the rarest share of each item's seeds (at least one), and the rarest of any ``run``
        of its words, so that no such run is without one; ties by hash. frequency: by length, of each
        key."""
        for k, x in self.seeds.items():
            rank = np.empty(len(x.key), np.int64)  # of the keys, rarest first
            rank[np.lexsort((x.key, frequency[k]))] = np.arange(len(x.key))
            own = np.repeat(rank, np.diff(x.start))
            order = np.lexsort((x.at, x.item))  # by item, in the order of its words
            edge = np.flatnonzero(np.diff(x.item[order], prepend=-1, append=-1))
            stay = np.zeros(len(own), bool)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                mine = own[order[lo:hi]]
                distinct = np.unique(mine)
                kept = distinct[: max(1, math.ceil(share * len(distinct)))]
                width = max(1, run - k + 1)
                if len(mine) > width:
                    kept = np.union1d(kept, np.lib.stride_tricks.sliding_window_view(mine, width).min(axis=1))
                else:
                    kept = np.union1d(kept, mine.min())
                stay[order[lo:hi]] = np.isin(mine, kept)
            self.seeds[k] = Seeds.of(x.gram()[stay], x.item[stay], x.at[stay])


def seed_hits(w, keys: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, word index, index of the seed) of each seed that a chunk's documents have."""
    for k, key in keys.items():
        if len(key) and len(w.hash) >= k:
            g = grams(w.hash, k)
            at = np.minimum(np.searchsorted(key, g), len(key) - 1)
            hit = np.flatnonzero((key[at] == g) & within(w.doc, k))
            yield k, hit, at[hit]


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words for each (item, part): the best score, and the indexes of the
    last words of the best alignment (the first such) in the item and in the part."""
    p, height, width = len(items), max(map(len, items)), max(map(len, parts))
    a, b = np.zeros((p, height), np.uint64), np.zeros((p, width), np.uint64)
    for i, (x, y) in enumerate(zip(items, parts)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    alive_a = np.arange(height) < np.array([len(x) for x in items])[:, None]
    alive_b = np.arange(width) < np.array([len(x) for x in parts])[:, None]
    slope = (np.arange(width) * -GAP).astype(np.int32)
    above = np.zeros((p, width + 1), np.int32)
    best, row, end = np.zeros(p, np.int32), np.zeros(p, np.int64), np.zeros(p, np.int64)
    for i in range(height):
        step = np.where((b == a[:, i : i + 1]) & alive_b & alive_a[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        here = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        here = np.maximum(np.maximum.accumulate(here + slope, axis=1) - slope, 0)  # gaps within the row
        at = here.argmax(axis=1)
        top = here[np.arange(p), at]
        better = top > best
        best[better], row[better], end[better] = top[better], i, at[better]
        above[:, 1:] = here
    return best, row, end


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The most words in a row that two texts have in common."""
    best, run = 0, np.zeros(len(b) + 1, np.int64)
    for x in a:
        run[1:] = np.where(b == x, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def _aligned(found: dict[tuple[int, int], list[tuple[int, int]]], w, items: Items, min_score: float, min_run: int) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word) of the best copy of each pair in ``found``;
    found: stretches [start, end) of words for each (document, item)."""
    work = sorted(((d, i, s, e) for (d, i), x in found.items() for s, e in x), key=lambda x: (len(items.code(x[1])), x[3] - x[2]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    lo = 0
    while lo < len(work):
        # as many as fit: a giant stretch is aligned alone
        hi = lo + 1
        while hi < min(lo + PAIRS, len(work)) and (hi - lo + 1) * (work[hi][3] - work[hi][2]) <= 200_000:
            hi += 1
        part, lo = work[lo:hi], hi
        a, b = [items.code(x[1]) for x in part], [w.hash[x[2] : x[3]] for x in part]
        # no more words can match than the item has in the stretch
        able = [int(np.isin(x, y).sum()) >= min(min_score * len(x) - 1e-9, min_run) for x, y in zip(a, b)]
        part, a, b = ([x for x, ok in zip(z, able) if ok] for z in (part, a, b))
        if not part:
            continue
        score, row, end = align(a, b)
        good = [k for k in range(len(part)) if score[k] >= min_score * MATCH * len(a[k]) - 1e-9 or score[k] >= MATCH * min_run and longest_run(a[k], b[k]) >= min_run]
        if not good:
            continue
        # the same alignment from its end backwards gives its start
        _, _, back = align([a[k][: row[k] + 1][::-1] for k in good], [b[k][: end[k] + 1][::-1] for k in good])
        for k, r in zip(good, back.tolist()):
            d, i, s, _ = part[k]
            at = int(s - w.first[d])
            new = (int(score[k]) / (MATCH * len(a[k])), -(at + int(end[k]) - r), at + int(end[k]))
            if (d, i) not in best or new > best[d, i]:
                best[d, i] = new
    for (d, i), (score, first, last) in sorted(best.items()):
        yield d, i, score, -first, last


def stretches(w, items: Items, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Around each seed, as much of the document as the item could fill, half as much again."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for k, hit, at in seed_hits(w, keys):
        for x, s in zip(hit.tolist(), at.tolist()):
            d = int(w.doc[x])
            seeds = items.seeds[k]
            places = slice(int(seeds.start[s]), int(seeds.start[s + 1]))
            for item, o in zip(seeds.item[places].tolist(), seeds.at[places].tolist()):
                n = int(items.first[item + 1] - items.first[item])
                spans[d, item].append((max(int(w.first[d]), x - o - n // 2), min(int(w.first[d + 1]), x - o + n + n // 2 + 1)))
    out = {}
    for pair, x in spans.items():
        x.sort()
        merged = [x[0]]
        for s, e in x[1:]:
            if s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out[pair] = merged
    return out


def _overlaps_of_block(picked: DataFrame, items: Items, min_score: float, share: float, min_run: int) -> DataFrame:
    keys = items.keys()
    counted = pa.schema([("k", pa.int32()), ("i", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(key), np.int64) for k, key in keys.items()}
        for b in batches:
            for _, _, data, offsets in chunks(column(b, "text")):
                w = words(data, offsets, ALNUM_LOWER, fold=True)
                for k, hit, at in seed_hits(w, keys):
                    pairs = np.unique(w.doc[hit] * len(keys[k]) + at)  # once a document
                    total[k] += np.bincount(pairs % len(keys[k]), minlength=len(keys[k]))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], schema=counted)

    # One number for each n-gram of the block's items, as arrays: bounded by the block.
    got = picked.select("text").mapInArrow(count, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
    of, at, n = (got.column(c).to_numpy() for c in ("k", "i", "n"))
    frequency = {k: np.zeros(len(key), np.int64) for k, key in keys.items()}
    for k in frequency:
        frequency[k][at[of == k]] = n[of == k]
    items.keep_rare(frequency, share, min_run)
    rare = items.keys()
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "id")
            for lo, _, data, offsets in chunks(column(b, "text")):
                w = words(data, offsets, ALNUM_LOWER, fold=True)
                rows = list(_aligned(stretches(w, items, rare), w, items, min_score, min_run))
                if rows:
                    d, i, score, first, last = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + x for x in d])), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())], schema=schema)

    return picked.mapInArrow(find, "id long, item long, score double, first_word long, last_word long")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = 3, seed_share: float = 0.6, min_score: float = 0.6, min_run: int = 13) -> DataFrame:
    """Returns id, item, score, first_word and last_word (in the document, from 0): a row for each
    document and item that share a rare seed and align with at least ``min_score`` of the item's
    full score (match 2, mismatch -1, gap -1; an exact copy scores 1), or that have ``min_run`` words
    of the item in a row (its score is then lower), with the best stretch. No such run is missed.

    Words are runs of letters and digits, A-Z in lower case. An item of fewer than ``seed_words``
    words is its own seed.

    Defined cases: null and empty texts have no words and match nothing, on both sides; items with
    a null id are skipped; repeated documents give a row each, a repeated item id, too; documents
    with a null id are reported with a null id; empty tables give an empty one; other columns are
    not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    wanted = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("item is not null and text is not null")
    n, chars = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    out = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        rows.sort(key=lambda r: (r["item"], r["text"]))
        found = _overlaps_of_block(picked, Items([r["item"] for r in rows], [r["text"] for r in rows], seed_words), min_score, seed_share, min_run)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` without an overlap, with their columns; rows with a null id stay."""
    bad = written(benchmark_overlaps(docs, benchmark, id_col=id_col, **how).select(F.col(id_col).alias("_bad")).where("_bad is not null").distinct(), "leaks")
    return docs.join(small(bad), F.col(f"`{id_col}`") == F.col("_bad"), "left_anti")
