import random
from itertools import chain

import pytest

from tessera.llm import substring

from .conftest import odd_rows


def brute(rows, window):
    w = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, x in w:
        if i is not None:
            for k in range(len(x) - window + 1):
                g = tuple(x[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, x in w:
        gone = set()
        if i is not None:
            gone = set(chain.from_iterable(range(k, k + window) for k in range(len(x) - window + 1) if first[tuple(x[k : k + window])] < i))
        out.append((i, len(x), len(gone), b" ".join(y for k, y in enumerate(x) if k not in gone).decode()))
    return sorted(out, key=str)


def got(df, window, **how):
    return sorted((tuple(r) for r in substring.remove_repeats(df, window=window, **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(make, seed):
    r = random.Random(seed)
    parts = [" ".join(r.choice("abcd") for _ in range(r.randrange(3, 30))) for _ in range(12)]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.7 else r.choice("abcdefgh") for _ in range(r.randrange(0, 9)))) for i in range(60)]
    assert got(make(rows), 5, gram=3, shard_rows=3, shard_anchors=4) == brute(rows, 5)
    assert got(make(rows), 13) == brute(rows, 13)


def test_odd_rows(make):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got(make(odd_rows()), 13) == brute(rows, 13)


def test_empty(make):
    assert got(make([]), 13) == []


def test_automaton_gives_matching_statistics():
    r = random.Random(1)
    texts = [[r.choice([b"a", b"b"]) for _ in range(r.randrange(1, 12))] for _ in range(5)]
    a = substring.SuffixAutomaton()
    for t in texts:
        a.add(t)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        q = [r.choice([b"a", b"b", b"c"]) for _ in range(15)]
        want = [max((n for n in range(1, k + 2) if tuple(q[k + 1 - n : k + 1]) in known), default=0) for k in range(len(q))]
        assert list(a.matches(q)) == want
