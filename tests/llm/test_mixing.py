import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = {"lang": {"en": 3.0, "fr": 1.0, "xx": 0.0}, "source": {"s1": 2.0}}


def fill(budget, children):
    """Shares a budget among (weight, capacity), again and again among those not yet full."""
    given, open_ = [0.0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0]
    while open_ and budget > 1e-9:
        unit = budget / sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] - given[i] <= unit * children[i][0]]
        if not full:
            for i in open_:
                given[i] += unit * children[i][0]
            break
        for i in full:
            budget -= children[i][1] - given[i]
            given[i] = children[i][1]
            open_.remove(i)
    return given


def brute(rows, share, epochs, seed):
    n = {k: len(WORD.findall(r[1] or "")) for k, r in enumerate(rows)}
    tree = defaultdict(lambda: defaultdict(int))
    w_lang, w_src = lambda x: WEIGHTS["lang"].get(x, 1.0), lambda x: WEIGHTS["source"].get(x, 1.0)
    for k, r in enumerate(rows):
        tree[r[2]][r[3]] += n[k]
    langs = list(tree)
    cap = {(a, s): t * epochs if w_lang(a) > 0 and w_src(s) > 0 else 0 for a in langs for s, t in tree[a].items()}
    total = [sum(cap[a, s] for s in tree[a]) for a in langs]
    top = fill(min(sum(total), share * sum(n.values()) // 1), list(zip(map(w_lang, langs), total)))
    out = []
    for a, b in zip(langs, top):
        srcs = list(tree[a])
        for s, g in zip(srcs, fill(b, [(w_src(s), cap[a, s]) for s in srcs])):
            budget, tokens = int(g + 1e-7), tree[a][s]
            if not tokens or not budget:
                continue
            e, rest = divmod(budget, tokens)
            keys = defaultdict(list)
            for k, r in enumerate(rows):
                if (r[2], r[3]) == (a, s):
                    keys[hashlib.md5(f"{seed}|{e}|{'' if r[0] is None else r[0]}".encode()).hexdigest()].append(k)
            upto, taken = 0, set()
            for key in sorted(keys) if rest else ():
                upto += sum(n[k] for k in keys[key])
                if upto > rest:
                    break
                taken |= set(keys[key])
            out += [(rows[k][0], n[k], e + (k in taken)) for key in keys.values() for k in key if e + (k in taken)]
    return sorted(out, key=str)


def mixed(make, rows, share=0.5, epochs=2):
    return mixing.mix(make(rows), levels={"lang": F.col("lang"), "source": F.col("source")}, weights=WEIGHTS, share=share, max_epochs=epochs, seed="t")


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.5, 9.0])
def test_like_brute_force(make, share):
    r = random.Random(share)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["en", "en", "fr", "de", "xx", None]), r.choice(["s0", "s1", "s2", None])) for i in range(300)]
    rows += [x if len(x) == 4 else (*x, "en", "s0") for x in odd_rows() if x[0] != 6 and x[0] != 13]
    got = mixed(make, rows, share).select("doc_id", "mix_tokens", "mix_copies").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, share, 2, "t")


def test_columns_and_empty(make):
    got = mixed(make, [(1, "a b"), (2, "c d")], 1.0)
    assert got.columns == [*make([]).columns, "mix_path", "mix_tokens", "mix_copies"]
    assert mixed(make, []).count() == 0


def test_no_python_in_the_plan(make):
    plan = mixed(make, [(1, "a b")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
