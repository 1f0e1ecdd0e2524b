import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.common import table

from . import test_linededup, test_quality
from .conftest import odd_rows
from .test_decontaminate import dp
from .test_mixing import fill
from .test_simhash import plain as simhash

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted([tuple(x) for x in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_like_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert plain(got.collect()) == plain(want.fetchall())


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        kept = [r[0] for r in docs.select("doc_id").collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)) > 0
        ids = set(kept)
        assert docs.columns == (columns if k < 4 else [*columns, "mix_path", "mix_tokens", "mix_copies"])


def test_odd_rows_pass_every_stage(spark, make):
    docs = make(odd_rows())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= docs.count()
        assert stage(spark, make([]), SF).count() == 0


def good_hosts(rows):
    """Rows are (id, text, lang, source) here and below."""
    base, fails, host = {}, {}, defaultdict(lambda: [0, 0])
    for i, t, _, s in rows:
        n, chars, symbols, _, repeat = test_quality.measures(t)
        base[i] = n < 50 or 100 * repeat > 50 * n
        fails[i] = base[i] or 100 * symbols > 50 * n or chars > 20 * n
        host[s][0] += 1
        host[s][1] += fails[i]
    m, s = test_quality.moments(host)
    rate = {h: (f + m * s) / (n + s) for h, (n, f) in host.items()}
    return [r for r in rows if not base[r[0]] and rate[r[3]] <= 0.8 and (rate[r[3]] <= 0.1 or not fails[r[0]])]


def rare_lines(rows):
    kept = {i: t for i, _, _, t in test_linededup.brute([r[:2] for r in rows], 10)}
    return [(i, kept[i], *more) for i, _, *more in rows]


def first_of_groups(rows):
    """Of 128 bits at most 25 differ: every pair is compared, whatever its texts share."""
    print_of = {r[0]: [simhash(r[1], 5, s) for s in (42, 43)] for r in rows}
    root = {i: i for i in print_of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(print_of)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            diff = [x ^ y for x, y in zip(print_of[a], print_of[b])]
            if sum(d.bit_count() for d in diff) <= 25:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def uncontaminated(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    grams = lambda w: set(zip(w, w[1:], w[2:]))
    items = [(w, grams(w)) for t in items if (w := cut(t))]
    assert all(g for _, g in items)

    def leaks(t):
        w = cut(t)
        mine = grams(w)
        return any(mine & g and dp(x, w) >= 1.2 * len(x) for x, g in items)

    return [r for r in rows if not leaks(r[1])]


def mixture(rows):
    n = {r[0]: len(test_quality.WORD.findall(r[1] or "")) for r in rows}
    domain = lambda s: "web" if hashlib.md5((s or "").encode()).hexdigest()[0] in "01234567" else "books"
    weight = [queries.DOMAIN_WEIGHTS, queries.LANG_WEIGHTS, {}]
    out = []

    def share(level, path, members, given):
        if level == 3:
            budget, tokens = int(given + 1e-7), sum(n[r[0]] for r in members)
            if not tokens or not budget:
                return
            epochs, rest = divmod(budget, tokens)
            order = sorted(members, key=lambda r: hashlib.md5(f"mix|{epochs}|{r[0]}".encode()).hexdigest())
            upto = 0
            for r in order:
                upto += n[r[0]]
                if copies := epochs + (upto <= rest and rest > 0):
                    out.append((r[0], r[1], path, n[r[0]], copies))
            return
        child = defaultdict(list)
        for r in members:
            child[(domain(r[3]), r[2], r[3])[level]].append(r)
        parts = fill(given, [(weight[level].get(k, 1.0), 2.0 * sum(n[r[0]] for r in x)) for k, x in child.items()])
        for (k, x), part in zip(child.items(), parts):
            share(level + 1, [*path, k], x, part)

    share(0, [], rows, float(sum(n.values()) // 2))
    return out


def test_run_like_brute_force(spark):
    """All five stages, plainly, over the same documents."""
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]
    items = [r[0] for r in table(spark, SF, "benchmark").select("text").collect()]
    left = [len(rows)]
    for stage in (good_hosts, rare_lines, first_of_groups, lambda x: uncontaminated(x, items)):
        rows = stage(rows)
        left.append(len(rows))
    assert left[0] > left[1] == left[2] > left[3] > left[4] > 0
    got = corpus_pipeline.run(spark, SF)
    assert plain(got.select("doc_id", "text", "mix_path", "mix_tokens", "mix_copies").collect()) == plain(mixture(rows))
