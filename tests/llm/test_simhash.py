import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash

from .conftest import odd_rows


def plain(text, k, seed):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, k, radius, seeds=(42,)):
    f = [[plain(t, k, s) for s in seeds] for _, t in rows]
    nodes = {}
    for (i, _), x in zip(rows, f):
        if i is not None:
            nodes[tuple(x)] = min(nodes.get(tuple(x), i), i)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(nodes)
    for a in range(len(keys)):
        for b in range(a):
            if sum((p ^ q).bit_count() for p, q in zip(keys[a], keys[b])) <= radius:
                p, q = sorted((find(keys[a]), find(keys[b])), key=nodes.get)
                root[q] = p
    return sorted(((i, f"{x[0]:016x}", nodes[find(tuple(x))] if tuple(x) in nodes else None) for (i, _), x in zip(rows, f)), key=str)


def near_texts(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.7:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"w{r.randrange(500)}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(f"w{r.randrange(500)}" for _ in range(300))))
    r.shuffle(rows)
    return rows


def rows_of(df):
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[3]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [4096, 3])
def test_like_brute_force(make, limit):
    rows = near_texts(150, 1) + [(r[0], r[1]) for r in odd_rows()]
    assert rows_of(simhash.near_duplicates(make(rows), cell_limit=limit)) == brute(rows, 3, 3)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("n", [2, 9, 400])
def test_cells_link_all_that_is_near(n):
    r = np.random.default_rng(n)
    f = np.zeros((2, n), np.uint64)
    f[0] = r.integers(0, 4, n).astype(np.uint64) * np.uint64(0xFFFF) ^ (np.uint64(1) << r.integers(0, 40, n).astype(np.uint64))
    cell = np.sort(r.integers(0, 3, n))
    i, j = simhash.cell_links(f, cell, 3)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        assert cell[a] == cell[b] and int(f[0, a] ^ f[0, b]).bit_count() <= 3
        root[find(a)] = find(b)
    for a in range(n):
        for b in range(a):
            if cell[a] == cell[b] and int(f[0, a] ^ f[0, b]).bit_count() <= 3:
                assert find(a) == find(b)


def test_one_document_of_each_group_stays(make):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "other")
    rows = [(5, base), (3, near), (9, base), (7, " ".join(f"v{i}" for i in range(400))), (None, base)]
    docs = make(rows)
    got = simhash.drop_near_duplicates(docs, shingle=5, seeds=(42, 43), max_bits=25, blocks=8, agree=2)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [3, 7, None]


def test_fingerprints_of_rows_without_an_id_link(make, monkeypatch):
    """Three fingerprints in a chain; only a row without an id has the middle one."""
    chain = {"a": 0, "b": 0b111, "c": 0b111111, "d": 0xFF << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.select(F.col("doc_id").alias("id"), F.create_map(*[F.lit(x) for kv in chain.items() for x in kv])[F.col("text")].cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.array().cast("array<long>").alias("keys")))
    got = {(r["doc_id"], r["f0"]): r["component"] for r in simhash.near_duplicates(make([(1, "a"), (None, "b"), (2, "c"), (None, "d")])).collect()}
    assert got == {(1, 0): 1, (None, 0b111): 1, (2, 0b111111): 1, (None, 0xFF << 40): None}


def test_least_hashes():
    r = np.random.default_rng(2)
    for h in (np.zeros(0, np.uint64), np.zeros(500, np.uint64), r.integers(0, 40, 500, dtype=np.uint64), r.integers(0, 1 << 63, 5000, dtype=np.uint64)):
        assert simhash.least(h, 16).tolist() == sorted(set(h.tolist()))[:16]
    text = " ".join(f"w{i % 90}" for i in range(200))
    w = text.split()
    want = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(196)})[:16]
    assert simhash.fingerprint(text.encode(), 5, (42, 43), 16)[1].tolist() == want
    assert simhash.fingerprint(b"", 5, (42,), 16)[1].tolist() == [0]


@pytest.mark.parametrize("limit", [4096, 6])
def test_similar_texts_are_found_by_their_keys(make, limit):
    """Every link within 25 bits of texts with a similarity of 0.8 or more, among texts that share a
    passage of half their length; with a low limit its keys are everybody's."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"w{r.randrange(9000)}" for _ in range(60)]
        if rows and r.random() < 0.5:
            own = list(r.choice(rows)[1].split()[60:])
            for _ in range(r.randrange(0, 3)):
                own[r.randrange(60)] = f"w{r.randrange(9000)}"
        rows.append((i, " ".join(common + own)))
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(make(rows), shingle=5, seeds=(42, 43), max_bits=25, blocks=8, agree=2, cell_limit=limit).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    prints = [[plain(t, 5, s) for s in (42, 43)] for _, t in rows]
    n = 0
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) <= 25:
                n += 1
                assert got[a] == got[b], (a, b)
    assert n > 30


def test_too_few_blocks_are_refused(make):
    with pytest.raises(ValueError):
        simhash.near_duplicates(make([]), max_bits=4)


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0


def test_components_of_chains_and_stars(spark):
    from tessera.llm.components import components

    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (160, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 3 for i in range(100, 161)}, **{i: 500 for i in range(501, 700)}}


def edited_texts(n, seed):
    """Texts of 60 words, most of them with up to 6 words of another replaced."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = r.choice(rows)[1].split() if rows and r.random() < 0.6 else [f"w{r.randrange(5000)}" for _ in range(60)]
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"w{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


def test_all_pairs_within_25_of_128_bits(make):
    rows = edited_texts(300, 6) + [(1000 + r[0] if r[0] else r[0], r[1]) for r in odd_rows()]
    got = sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[3]) for r in simhash.near_duplicates(make(rows), shingle=5, seeds=(42, 43), max_bits=25, blocks=8, agree=2).collect()), key=str)
    assert got == brute(rows, 5, 25, (42, 43))


@pytest.mark.parametrize("n", [1, 40, 700])
def test_groups_link_all_that_is_near(n):
    r = np.random.default_rng(n)
    near = r.integers(0, 1 << 64, (2, 30), dtype=np.uint64)[:, r.integers(0, 30, n)]
    for _ in range(9):
        near[r.integers(0, 2, n), np.arange(n)] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    d = np.bitwise_count(near[:, :, None] ^ near[:, None]).sum(axis=0)

    def parts(pairs):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            assert d[a, b] <= 14
            x, y = sorted((find(int(a)), find(int(b))))
            root[y] = x
        return [find(x) for x in range(n)]

    want = np.argwhere(d <= 14)
    assert parts(simhash.all_links(near, np.arange(n), 14)) == parts(want)
    x, y = np.arange(n)[::2], np.arange(n)[1::2]
    links = simhash.cross_links(near, x, y, 14)
    assert len(links) < max(1, n) and parts(links) == parts([(a, b) for a, b in want if (a - b) % 2])
