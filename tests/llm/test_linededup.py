import random
from collections import defaultdict

from tessera.llm import linededup

from .conftest import odd_rows

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, n):
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(docs[key(x)]) < n]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_like_brute_force(make):
    r = random.Random(2)
    lines = ["Hello World", " hello world\t", "ÉTÉ", "été", "", "x", "a\rb"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 12)))) for i in range(80)] + [(r_[0], r_[1]) for r_ in odd_rows()]
    for n in (1, 2, 10):
        got = linededup.drop_frequent_lines(make(rows), min_docs=n, report=True)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, n)


def test_documents_keep_their_columns(make):
    rows = [(i, f"same\nown {i}") for i in range(3)] + [(9, None)]
    docs = make(rows)
    got = linededup.drop_frequent_lines(docs, min_docs=3)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "own 0", 1: "own 1", 2: "own 2", 9: None}
    assert got.select("key", "_id", "_lines").distinct().collect() == [(None, 1, "l")]


def test_empty(make):
    assert linededup.drop_frequent_lines(make([])).count() == 0


def test_no_python_in_the_plan(make):
    plan = linededup.drop_frequent_lines(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
