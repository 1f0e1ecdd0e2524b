import random

import pytest

from tessera.llm import decontaminate

from .conftest import odd_rows


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, id string")


def dp(a, b):
    """Best local alignment, plainly."""
    best, up = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, up[j] + (2 if x == y else -1), up[j + 1] - 1, row[j] - 1))
        best, up = max(best, max(row)), row
    return best


def test_align_like_plain_dp():
    import numpy as np

    r = random.Random(0)
    pairs = [([r.randrange(1, 5) for _ in range(r.randrange(1, 12))], [r.randrange(1, 5) for _ in range(r.randrange(1, 20))]) for _ in range(200)]
    score, _, _ = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert score.tolist() == [dp(a, b) for a, b in pairs]


def corpus():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    bench = [(k, text(r.randrange(12, 40))) for k in range(12)]
    rows = []
    for i in range(120):
        w = text(r.randrange(0, 120))
        if i % 3 == 0:
            k, t = r.choice(bench)
            t = [x for x in t if r.random() > 0.05]
            t = [r.choice(vocabulary) if r.random() < 0.12 else x for x in t]
            at = r.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((i, " ".join(w)))
    return rows, [(k, " ".join(t)) for k, t in bench]


def test_like_brute_force(make, spark):
    rows, bench = corpus()
    got = decontaminate.benchmark_overlaps(make(rows), items(spark, bench), seed_share=1.0).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    want = {}
    for i, t in rows:
        w = t.split()
        for k, q in bench:
            x = q.split()
            seeds = {tuple(x[j : j + 3]) for j in range(len(x) - 2)}
            if any(tuple(w[j : j + 3]) in seeds for j in range(len(w) - 2)) and (s := dp(x, w)) >= 1.2 * len(x):
                want[i, k] = s / (2 * len(x))
    assert found == {p: pytest.approx(s) for p, s in want.items()}
    assert len(want) >= 30
    for r in got:  # the stretch named scores as said
        x, w = dict(bench)[r["item_id"]].split(), dict(rows)[r["doc_id"]].split()
        assert dp(x, w[r["first_word"] : r["last_word"] + 1]) == round(r["score"] * 2 * len(x))


def test_rare_seeds_find_edited_copies(make, spark):
    rows, bench = corpus()
    full = decontaminate.benchmark_overlaps(make(rows), items(spark, bench), seed_share=1.0).select("doc_id", "item_id").collect()
    rare = decontaminate.benchmark_overlaps(make(rows), items(spark, bench)).select("doc_id", "item_id").collect()
    assert set(rare) <= set(full) and len(rare) >= 0.95 * len(full)


def test_odd_rows(make, spark):
    bench = [(1, "alpha beta gamma"), (1, "two"), (2, None), (3, ""), (None, "beta"), (4, "!!"), (5, "ONE, two; three.")]
    got = decontaminate.benchmark_overlaps(make(odd_rows()), items(spark, bench)).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got if r["item_id"] == 5} == {(12, 5, 1.0)}
    assert {r["doc_id"] for r in got if r["item_id"] == 1} >= {12}
    assert not {2, 3, 4, None} & {r["item_id"] for r in got}
    docs = make([*odd_rows(), (12, "one two three"), (None, "one two three")])
    left = decontaminate.drop_contaminated(docs, items(spark, [(5, "one two three")]))
    assert left.columns == docs.columns and left.where("doc_id = 12").count() == 0 and left.count() == docs.count() - 2


def test_empty(make, spark):
    assert decontaminate.benchmark_overlaps(make([]), items(spark, [(1, "a b c")])).count() == 0
    assert decontaminate.benchmark_overlaps(make([(1, "a b c")]), items(spark, [])).count() == 0
    assert decontaminate.drop_contaminated(make([(1, "a b c")]), items(spark, [])).count() == 1


def test_blocks_of_items_give_the_same(make, spark, monkeypatch):
    rows, bench = corpus()
    whole = set(decontaminate.benchmark_overlaps(make(rows), items(spark, bench)).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    assert set(decontaminate.benchmark_overlaps(make(rows), items(spark, bench)).collect()) == whole


def test_excerpts_are_found(make, spark):
    """Of long items any 13 words in a row are a leak, however common their trigrams are."""
    r = random.Random(3)
    bench = [(k, [f"w{r.randrange(400)}" for _ in range(60)]) for k in range(6)]
    other = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    rows, want = [], set()
    for k, x in bench:
        rows += [(1000 + 10 * k + j, " ".join(other(5) + x[:26] + other(2))) for j in range(8)]  # makes its first trigrams common
        want |= {(1000 + 10 * k + j, k) for j in range(8)}
        for at in range(0, 48):
            rows += [(100 * (k + 20) + at, " ".join(other(9) + x[at : at + 13] + other(9))), (100 * (k + 40) + at, " ".join(other(9) + x[at : at + 12] + other(9)))]
            want.add((100 * (k + 20) + at, k))
    got = decontaminate.benchmark_overlaps(make(rows), items(spark, [(k, " ".join(x)) for k, x in bench])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    text = dict(rows)
    for r in got:
        assert " ".join(text[r["doc_id"]].split()[r["first_word"] : r["last_word"] + 1]) in " ".join(dict(bench)[r["item_id"]])


@pytest.mark.parametrize("share, least", [(0.10, 1.0), (0.20, 0.97), (0.25, 0.95)])
def test_recall_of_copies_edited_in_a_share_of_their_words(make, spark, share, least):
    """Of the copies whose alignment reaches the score, those found; 300 copies of 60 items, a third of
    the edits each being other words, words put in and words left out."""
    r = random.Random(int(1000 * share))
    bench = [(k, [f"w{r.randrange(600)}" for _ in range(r.randrange(20, 70))]) for k in range(60)]
    rows, reach, planted = [], set(), 0
    for i in range(300):
        k, x = bench[i % 60]
        copy = list(x)
        for at in sorted(r.sample(range(len(x)), round(share * len(x))), reverse=True):
            what = r.randrange(3)
            copy[at : at + (what != 1)] = [] if what == 2 else [f"v{r.randrange(600)}"]
        w = [f"u{r.randrange(600)}" for _ in range(40)]
        w[20:20] = copy
        planted += 1
        rows.append((i, " ".join(w)))
        if dp(x, w) >= 1.2 * len(x):
            reach.add((i, k))
    got = {(g["doc_id"], g["item_id"]) for g in decontaminate.benchmark_overlaps(make(rows), items(spark, [(k, " ".join(x)) for k, x in bench])).collect()}
    assert planted == 300 and len(reach) >= 150
    assert len(got & reach) >= least * len(reach), (len(got & reach), len(reach))
