"""Removal of repeated passages with suffix automata of reference shards.

A window is a fixed number of consecutive words. A word goes if a window that covers it also
starts in a document with a smaller id.

1. Every window is named by its anchor: the n-gram of least hash in it. Equal windows have equal
   anchors, and a text has far fewer anchors than windows. The smallest document of each anchor
   that more than one document has is its reference document.
2. The stretches of the reference document with its anchors are a reference shard of bounded size.
   A suffix automaton of it goes to the stretches of other documents with the same anchors, which
   are streamed through it for matching statistics: the length of the longest match that ends at
   each word. Lengths of a window or more are repeats. A shard that very many documents meet is
   copied to several tasks, each of which streams a part of them; only the automaton is held.
3. Windows that share an anchor with the reference but are not in it (they can only repeat in
   documents that are not the reference either) are compared exactly, by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, record_batches, small, written
from .textops import chunks, grams, runs, within, words

SHARD_ANCHORS = 20_000  # of one reference document in a shard; about four words each
SHARD_ROWS = 500  # stretches streamed through one copy of a shard


class SuffixAutomaton:
    """Of a set of word sequences; matching takes one step for each word, amortised."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in sequence:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:  # another sequence went here
                last = q
                continue
            if q is None:
                cur, p = len(nxt), last
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = -1, last
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = copy
                p = link[p]
            link[q] = copy
            if cur >= 0:
                link[cur] = copy
            last = cur if cur >= 0 else copy

    def matches(self, sequence: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest match with the set that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for w in sequence:
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            yield n


def window_anchors(w, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and whether the window is all in one document."""
    ok = within(w.doc, window)
    if not len(ok):
        return np.zeros(0, np.uint64), ok
    g = grams(w.hash, gram)
    need, have = window - gram + 1, 1
    low = g
    while have < need:  # least of ever longer ranges
        step = min(have, need - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low, ok


def _anchor_rows(window: int, gram: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "id").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in chunks(column(b, "text")):
                w = words(data, offsets)
                anchor, ok = window_anchors(w, window, gram)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                a, d = anchor[at], w.doc[at]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
                a, d = a[new], d[new]
                order = np.lexsort((a, d))
                a, d = a[order], d[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(ids[lo + d[new]].astype(np.int64))], schema=schema)

    return run


def _stretch_rows(window: int, gram: int, schema: pa.Schema):
    """From documents with their shared anchors: stretches of consecutive windows whose anchors
    have the same reference shard."""

    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, rows, known = column(b, "id").to_pylist(), column(b, "row").to_pylist(), column(b, "shared")
        anchor, ref, shard = (known.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        edge = known.offsets.to_numpy()
        for lo, _, data, offsets in chunks(column(b, "text")):
            w = words(data, offsets)
            least, ok = window_anchors(w, window, gram)
            for d in range(len(offsets) - 1):
                first, last = int(w.first[d]), int(w.first[d + 1]) - window + 1
                s, e = edge[lo + d], edge[lo + d + 1]
                if last <= first or s == e:
                    continue
                order = np.argsort(anchor[s:e])
                key = anchor[s:e][order]
                own = least[first:last].view(np.int64)
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                hit = key[at] == own
                if not hit.any():
                    continue
                at = order[at]
                # windows of one shard in a row are a stretch
                r, q = ref[s:e][at], shard[s:e][at]
                change = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1]) | (r[1:] != r[:-1]) | (q[1:] != q[:-1]))))
                for i, j in zip(change.tolist(), [*change[1:].tolist(), len(own)]):
                    if hit[i]:
                        lo_w, hi_w = first + i, first + j + window - 1
                        words_of = [data[x:y].tobytes() for x, y in zip(w.start[lo_w:hi_w].tolist(), w.end[lo_w:hi_w].tolist())]
                        yield int(r[i]), int(q[i]), ids[lo + d], rows[lo + d], i, b" ".join(words_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from record_batches(of(b), schema, 2048)

    return run


def _matched_rows(window: int, schema: pa.Schema):
    """Streams stretches, sorted by shard, those of the reference first, through its automaton."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, automaton, seen = None, SuffixAutomaton(), {}
        for b in batches:
            for ref, q, salt, late, ident, row, pos, text in zip(*(column(b, c).to_pylist() for c in ("ref", "shard", "salt", "late", "id", "row", "pos", "words"))):
                if (ref, q, salt) != shard:
                    shard, automaton, seen = (ref, q, salt), SuffixAutomaton(), {}
                sequence = text.split(b" ")
                if not late:
                    automaton.add(sequence)
                    continue
                name = hashlib.blake2b(text, digest_size=16).digest()
                if name not in seen:  # copies of a stretch match alike
                    if len(seen) >= 4096:
                        seen.clear()
                    hit = np.fromiter(automaton.matches(sequence), np.int64, len(sequence))[window - 1 :] >= window
                    spans = [(s, e + window - 1) for s, e in runs(hit)]
                    rest = []
                    for i in np.flatnonzero(~hit).tolist():
                        h = hashlib.blake2b(b" ".join(sequence[i : i + window]), digest_size=16).digest()
                        rest.append((i, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
                    seen[name] = spans, rest
                spans, rest = seen[name]
                yield ident, row, [{"s": pos + s, "e": pos + e} for s, e in spans], [{"s": pos + i, "h": h, "g": g} for i, h, g in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(of(batches), schema, 1024)

    return run


def _without(schema: pa.Schema):
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        spans = column(b, "spans").to_pylist()
        for i, (ident, text) in enumerate(zip(column(b, "id").to_pylist(), column(b, "text"))):
            w = (text.as_py() or "").encode().split()
            stay = np.ones(len(w), bool)
            for x in spans[i] or ():
                stay[x["s"] : x["e"]] = False
            kept = w if stay.all() else [w[k] for k in np.flatnonzero(stay).tolist()]
            yield ident, len(w), len(w) - len(kept), b" ".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from record_batches(of(b), schema, 256)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6, shard_rows: int = SHARD_ROWS, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """Returns id, n_words, n_removed and kept_text (the words that stay, joined by one space), a
    row for each row of ``docs``.

    Defined cases: a null or empty text has no words; a document shorter than a window keeps all;
    rows that repeat an id are judged each, and not against one another; a row with a null id is
    neither judged nor a reference; an empty table gives an empty one; other columns are not read.
    """
    gram = min(gram, window)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    named = base.where("id is not null and text is not null")
    anchors = named.mapInArrow(_anchor_rows(window, gram, pa.schema([("anchor", pa.int64()), ("id", pa.int64())])), "anchor long, id long")
    shared = written(anchors.groupBy("anchor").agg(F.min("id").alias("ref"), F.max("id").alias("top")).where("ref < top").select("anchor", "ref"), "anchors")
    large = written(shared.groupBy("ref").count().where(F.col("count") > shard_anchors), "large").select("ref", F.ceil(F.col("count") / shard_anchors).alias("n"))
    shared = shared.join(small(large), "ref", "left").select("anchor", "ref", F.coalesce(F.pmod("anchor", F.col("n")), F.lit(0)).cast("int").alias("shard"))
    of_doc = anchors.join(shared, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "ref", "shard")).alias("shared"))
    stretch = pa.schema([("ref", pa.int64()), ("shard", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("pos", pa.int64()), ("words", pa.binary())])
    stretches = written(
        named.join(of_doc, "id").select("id", F.xxhash64("text").alias("row"), "text", "shared").mapInArrow(_stretch_rows(window, gram, stretch), "ref long, shard int, id long, row long, pos long, words binary"),
        "stretches",
    )
    # Shards that many stretches meet are copied, and the stretches dealt among the copies.
    busy = written(stretches.groupBy("ref", "shard").count().where(F.col("count") > shard_rows), "busy").select("ref", "shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("copies"))
    late, copies = F.col("id") != F.col("ref"), F.coalesce(F.col("copies"), F.lit(1))
    salts = F.when(late, F.array(F.pmod(F.xxhash64("id"), copies).cast("int"))).otherwise(F.sequence(F.lit(0), copies - 1))
    dealt = stretches.join(small(busy), ["ref", "shard"], "left").select("ref", "shard", F.explode(salts).alias("salt"), late.alias("late"), "id", "row", "pos", "words")
    span, rest = pa.struct([("s", pa.int64()), ("e", pa.int64())]), pa.struct([("s", pa.int64()), ("h", pa.int64()), ("g", pa.int64())])
    matched = written(
        dealt.repartition("ref", "shard", "salt").sortWithinPartitions("ref", "shard", "salt", "late").mapInArrow(
            _matched_rows(window, pa.schema([("id", pa.int64()), ("row", pa.int64()), ("spans", pa.list_(span)), ("rest", pa.list_(rest))])),
            "id long, row long, spans array<struct<s: long, e: long>>, rest array<struct<s: long, h: long, g: long>>",
        ),
        "matched",
    )
    other = matched.select("id", "row", F.explode("rest").alias("r")).select("id", "row", "r.s", "r.h", "r.g")
    again = other.groupBy("h", "g").agg(F.min("id").alias("ref"), F.max("id").alias("top")).where("ref < top").select("h", "g", "ref")
    exact = other.join(again, ["h", "g"]).where("id > ref").select("id", "row", F.struct("s", (F.col("s") + window).alias("e")).alias("span"))
    found = matched.select("id", "row", F.explode("spans").alias("span")).unionByName(exact)
    marks = found.groupBy("id", "row").agg(F.collect_list("span").alias("spans")).withColumnsRenamed({"id": "_id", "row": "_row"})
    joined = base.join(marks, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left").select("id", "text", "spans")
    return joined.mapInArrow(_without(pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
