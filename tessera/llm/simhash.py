"""SimHash near-duplicates, found with pivot distance tables.

Fingerprints are made of word shingles. Equal ones are collapsed; the distinct ones are dealt into
cells by the bits of some of their blocks: with b blocks of which k must agree, any two
fingerprints that differ in at most b - k bits meet in a cell. In a cell, the Hamming distances of
each member to a set of reference fingerprints (pivots) are computed once; a pair whose distances
to any pivot differ by more than the radius cannot be linked (triangle inequality) and is
discarded; the rest is verified. Large cells yield a spanning forest, never all their pairs.

Where the radius is too wide for that (25 of 128 bits leave no choice of blocks that selects
anything), fingerprints meet by their texts instead: the least hashes of a text's shingles are its
keys, and those that share a key are a cell, in which the pivot tables do the same. Of two texts with a
Jaccard similarity of 0.8, each of the 16 least hashes of both together is in both with a chance of
0.8, so they miss each other with one of 0.2 ** 16. Keys that very many fingerprints have (those of a
widespread passage) make no cell; fingerprints that have many such keys are compared each with each,
dealt into groups by a hash, of which each pair is a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small, written
from .components import components

PIVOTS = 16
CELL_LIMIT = 4096  # larger cells are compared block by block, in tasks of their own
PAIRWISE = 8  # up to this many members, a cell's links are all emitted
KEYS = 16  # least shingle hashes by which fingerprints meet
GROUPS = 24  # of fingerprints that are compared each with each; every one is sent this many times
TILE = 16  # fingerprints compared with a whole group at once


def shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in parts; fewer words than a shingle: of the
    whole sequence; no words: none."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    joined, k = b" ".join(w), min(shingle, len(w))
    end = np.cumsum(size)
    begin, stop, digest = (end - size)[: len(w) - k + 1].tolist(), (end - 1)[k - 1 :].tolist(), xxhash.xxh64_intdigest
    for lo in range(0, len(begin), 65536):
        part = begin[lo : lo + 65536]
        yield np.fromiter((digest(joined[s:e], seed) for s, e in zip(part, stop[lo : lo + 65536])), np.uint64, len(part))


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The n least distinct values."""
    if len(h) > 8 * n:
        some = np.unique(np.partition(h, 4 * n)[: 4 * n])
        if len(some) >= n:
            return some[:n]
    return np.unique(h)[:n]


def fingerprint(text: bytes, shingle: int, seeds: tuple[int, ...], keys: int = 0) -> tuple[list[int], np.ndarray]:
    """A 64-bit fingerprint for each seed: bit i is 1 if it is set in over half the hashes of the
    shingles; no words: 0. And the ``keys`` least distinct hashes by the first seed (no words: 0)."""
    out, few = [], np.zeros(0, np.uint64)
    for i, seed in enumerate(seeds):
        ones, n = np.zeros(64, np.int64), 0
        for h in shingle_hashes(text, shingle, seed):
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            n += len(h)
            if keys and not i:
                few = least(np.concatenate([few, least(h, keys)]), keys)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0)
    return out, few if len(few) or not keys else np.zeros(1, np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seeds: tuple[int, ...] = (42,), keys: int = 0) -> DataFrame:
    """Rows (id, f0, f1, keys): the fingerprints of whole texts as longs, f1 being 0 with one seed, and
    the keys by which they may meet (none unless asked for)."""
    schema = pa.schema([("id", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint((t or "").encode(), shingle, seeds, keys) for t in (x.as_py() for x in column(b, "text"))]
            made = np.array([f for f, _ in rows], np.uint64).reshape(-1, len(seeds)).view(np.int64)
            f1 = made[:, 1] if len(seeds) > 1 else np.zeros(len(made), np.int64)
            few = pa.array([k.view(np.int64) for _, k in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(np.ascontiguousarray(made[:, 0])), pa.array(np.ascontiguousarray(f1)), few], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, f0 long, f1 long, keys array<long>")


def _masks(blocks: int, agree: int) -> list[int]:
    """A mask for each choice of ``agree`` of ``blocks`` blocks of the 64 bits, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(block, agree))]


def pivots() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, (2, PIVOTS), dtype=np.uint64)


def distances(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each pivot, the distance of each fingerprint. f: (2, n)."""
    return np.stack([np.bitwise_count(f[0] ^ a) + np.bitwise_count(f[1] ^ b) for a, b in p.T]).astype(np.int16)


def _linked(f: np.ndarray, t: np.ndarray, i, j, radius: int) -> np.ndarray:
    """Which pairs (i, j) are within the radius: pivots first, then the survivors exactly."""
    near = np.ones(len(j), bool)
    for row in t:
        near[near] = np.abs(row[i[near]] - row[j[near]]) <= radius
    a, b = i[near], j[near]
    near[near] = np.bitwise_count(f[0, a] ^ f[0, b]) + np.bitwise_count(f[1, a] ^ f[1, b]) <= radius
    return near


def cell_links(f: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link what is linked within each cell; f: (2, n) fingerprints, cell: the
    members' cells, in order."""
    n, first, second = len(cell), [], []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(start, n))
    keep = np.repeat(size > 1, size)
    table = np.zeros((PIVOTS, n), np.int16)
    table[:, keep] = distances(f[:, keep], pivots())
    left = np.repeat(start + size, size) - np.arange(n) - 1  # members behind each in its cell
    left[np.repeat(size > PAIRWISE, size)] = 0
    for o in range(1, PAIRWISE):
        i = np.flatnonzero(left >= o)
        if not len(i):
            break
        good = _linked(f, table, i, i + o, radius)
        first.append(i[good])
        second.append(i[good] + o)
    for s, m in zip(start[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist()):
        rest = np.arange(s, s + m)
        while len(rest):  # a tree for each component, breadth first, over those not reached yet
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                good = _linked(f, table, np.full(len(rest), x), rest, radius)
                if good.any():
                    found = rest[good]
                    first.append(np.full(len(found), x))
                    second.append(found)
                    front += found.tolist()
                    rest = rest[~good]
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last cell, which may go on in the next batch

        def done(x: np.ndarray) -> pa.RecordBatch:
            cell = np.cumsum(np.concatenate(([0], (x[:3, 1:] != x[:3, :-1]).any(axis=0)))) if x.shape[1] else np.zeros(0)
            i, j = cell_links(x[3:5].view(np.uint64), cell, radius)
            return pa.RecordBatch.from_arrays([pa.array(x[5, i]), pa.array(x[5, j])], schema=schema)

        for b in batches:
            x = np.stack([column(b, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "cell", "f0", "f1", "node")])
            x = x if held is None else np.concatenate([held, x], axis=1)
            change = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = x[:, cut:]
            if cut:
                yield done(np.ascontiguousarray(x[:, :cut]))
        if held is not None:
            yield done(np.ascontiguousarray(held))

    return run


def _near(f: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of x and y (indices into f) within the radius, as places in x and in y."""
    i, j = np.divmod(np.flatnonzero(np.bitwise_count(f[0, x, None] ^ f[0, y]) <= radius), max(1, len(y)))
    good = np.bitwise_count(f[0, x[i]] ^ f[0, y[j]]) + np.bitwise_count(f[1, x[i]] ^ f[1, y[j]]) <= radius
    return i[good], j[good]


def cross_links(f: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between x and y (distinct indices into f): every pair is
    compared, unless both are in one tree already."""
    out, side, rest = [], np.zeros(f.shape[1], bool), [x, y]
    side[y] = True
    while len(rest[0]) and len(rest[1]):
        tile = rest[0][:TILE]
        hit = np.zeros(len(tile), bool)
        hit[_near(f, tile, rest[1], radius)[0]] = True
        # Those without a link are done; from one with a link its tree is grown, breadth first.
        rest[0] = np.concatenate([tile[hit], rest[0][TILE:]])
        front = []
        if hit.any():
            front, rest[0] = [int(rest[0][0])], rest[0][1:]
        while front:
            at = front.pop()
            other = int(not side[at])
            found = np.zeros(len(rest[other]), bool)
            found[_near(f, np.array([at]), rest[other], radius)[1]] = True
            if found.any():
                reached = rest[other][found].tolist()
                out += [(at, z) for z in reached]
                front += reached
                rest[other] = rest[other][~found]
    return out


def all_links(f: np.ndarray, x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that link all that is linked in x."""
    if len(x) <= 2 * TILE:
        return [(int(x[i]), int(x[j])) for i, j in zip(*_near(f, x, x, radius)) if i < j]
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    return cross_links(f, a, b, radius) + all_links(f, a, radius) + all_links(f, b, radius)


def _group_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, own, f0, f1, node = np.concatenate(parts, axis=1)
        f, left = np.stack([f0, f1]).view(np.uint64), own == cell // GROUPS
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        same = len(cell) and cell[0] // GROUPS == cell[0] % GROUPS
        found = np.array(all_links(f, x, radius) if same else cross_links(f, x, y, radius), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the parts of one cell
        for b in batches:
            rows = np.stack([column(b, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "own", "f0", "f1", "node")])
            for part in np.split(rows, np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, axis=1):
                if held and part.shape[1] and held[0][0, 0] != part[0, 0]:
                    yield from links(held)
                    held = []
                if part.shape[1]:
                    held.append(part)
        if held:
            yield from links(held)

    return run


def _every_pair(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of all nodes within the radius, however far apart their blocks are."""
    own = F.pmod(F.xxhash64("node"), F.lit(GROUPS))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long")), lambda o: F.least(own, o) * GROUPS + F.greatest(own, o))
    dealt = nodes.select("f0", "f1", "node", own.alias("own"), F.explode(cells).alias("cell"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_group_links(radius), "a long, b long")


def _block_links(nodes: DataFrame, halves: int, max_bits: int, blocks: int, agree: int, cell_limit: int) -> DataFrame:
    """Links (a, b) of the nodes that meet in a cell and are within the radius."""
    masks = _masks(blocks, agree)
    keys = [F.struct(F.lit(i + k * len(masks)).alias("t"), F.col(c).bitwiseAND(F.lit(m)).alias("key")) for k, c in enumerate(("f0", "f1")[:halves]) for i, m in enumerate(masks)]
    dealt = nodes.select("f0", "f1", "node", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "f0", "f1", "node")
    hot = written(dealt.groupBy("t", "key").count().where(F.col("count") > cell_limit), "hot").select("t", "key", F.ceil(F.col("count") / cell_limit).cast("long").alias("s"))
    # A hot cell's members are split into s blocks, and each pair of blocks is a cell.
    own, s = F.pmod(F.xxhash64("node"), F.col("s")), F.col("s")
    cells = F.when(s.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(s, F.lit(1)) - 1), lambda o: 1 + F.least(own, o) * s + F.greatest(own, o)))
    dealt = dealt.join(small(hot), ["t", "key"], "left").select("t", "key", F.explode(cells).alias("cell"), "f0", "f1", "node")
    dealt = dealt.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell")
    return dealt.mapInArrow(_links(max_bits), "a long, b long")


def _key_links(prints: DataFrame, name, radius: int, cell_limit: int) -> DataFrame:
    """Links (a, b) of the fingerprints that share a key and are within the radius."""
    dealt = written(prints.select("f0", "f1", name.alias("node"), F.size("keys").alias("n"), F.explode("keys").alias("key")).distinct(), "keys")
    hot = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_limit).select(F.col("key").alias("_key")), "hot")
    marked = dealt.join(small(hot), F.col("key") == F.col("_key"), "left")
    cells = marked.where("_key is null").select(F.lit(0).alias("t"), "key", F.lit(0).cast("long").alias("cell"), "f0", "f1", "node")
    links = cells.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell").mapInArrow(_links(radius), "a long, b long")
    # Over a quarter of its keys are everybody's: too few others are left to meet by.
    crowded = written(marked.where("_key is not null").groupBy("f0", "f1", "node").agg(F.count(F.lit(1)).alias("h"), F.max("n").alias("n")).where("4 * h > n").select("f0", "f1", "node"), "crowded")
    return links.unionByName(_every_pair(crowded, radius))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (42,), max_bits: int = 3, blocks: int = 6, agree: int = 3, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Returns (id, f0, f1, component), component being the smallest id reachable over links of at
    most ``max_bits`` differing bits (of 64, or of 128 with two seeds).

    Where any two fingerprints within ``max_bits`` agree in ``agree`` of ``blocks`` blocks of one of
    their halves, they meet by these, and all links are found. Where they need not (two seeds only),
    they meet by the 16 least hashes of their shingles: all links between texts with a Jaccard
    similarity of 0.8 or more are found but for a chance of 0.2 ** 12 at most, and of the less similar
    those that share one (at 0.5, all but 1 in 65,000).

    Defined cases: null and empty texts have fingerprint 0 and are linked like any other; a row with a
    null id gets the component of its fingerprint, which links others like any (null if no row with an
    id has or reaches it); rows that repeat an id are each returned, and linked by their texts alone; an
    empty table gives an empty one.
    """
    if len(seeds) == 1 and blocks - agree < max_bits:
        raise ValueError("too few blocks: links would be missed")
    by_blocks = max_bits // len(seeds) <= blocks - agree
    prints = written(fingerprints(docs, id_col, text_col, shingle, seeds, 0 if by_blocks else KEYS), "prints")
    # A node is a distinct fingerprint, by its value (of two fingerprints, by a hash of both).
    name = F.col("f0") if len(seeds) == 1 else F.xxhash64("f0", "f1")
    nodes = written(prints.groupBy("f0", "f1").agg(F.min("id").alias("least")).withColumn("node", name), "nodes")
    links = _block_links(nodes, len(seeds), max_bits, blocks, agree, cell_limit) if by_blocks else _key_links(prints, name, max_bits, cell_limit)
    roots = components(links)
    rooted = written(nodes.join(roots, "node", "left").select("f0", "f1", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least_id = rooted.groupBy("root").agg(F.min("least").alias("component"))
    groups = rooted.join(least_id, "root").select(F.col("f0").alias("_f0"), F.col("f1").alias("_f1"), "component")
    return prints.join(groups, (F.col("f0") == F.col("_f0")) & (F.col("f1") == F.col("_f1")), "left").select(F.col("id").alias(id_col), "f0", "f1", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each group of near-duplicates only the document with the smallest id stays, with its
    columns. Defined cases as in ``near_duplicates``; rows with a null id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = written(found.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(small(gone), F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
