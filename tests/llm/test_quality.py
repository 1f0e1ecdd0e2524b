import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if count[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measures_like_brute_force(make):
    r = random.Random(3)
    texts = ["\n".join(" ".join(r.choice(["a", "b", "çé", "x#y", "||", "c"]) for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(0, 10))) for _ in range(60)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows()
    got = quality.host_quality(make(rows)).select("doc_id", *quality.MEASURES, "base_failed").collect()
    want = []
    for x in rows:
        m = measures(x[1])
        want.append((x[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def corpus():
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good + f" {i}", "en", "good") for i in range(40)] + [(100 + i, "too short", "en", "bad") for i in range(40)] + [(200, good, "en", "bad"), (201, "short", "en", "good"), (300, good, "en", None)]
    return rows + [(1000 + 10 * h + i, good if i < 7 else "x", "en", f"h{h}") for h in range(8) for i in range(8)]


def test_bad_hosts_lose_all(make):
    got = {r["doc_id"]: r["kept"] for r in quality.host_quality(make(corpus())).collect()}
    assert got[0] and got[39] and got[300] and not got[200] and not got[201] and not got[100]
    kept = quality.keep_good_hosts(make(corpus()))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    assert kept.columns == make([]).columns


def moments(host):
    """(mean, a + b) of the prior over hosts, from their (n, f)."""
    p = [f / n for n, f in host.values()]
    m = sum(p) / len(p)
    spread = sum((x - m) ** 2 for x in p) / (len(p) - 1) if len(p) > 1 else 0.0
    between = spread - m * (1 - m) * sum(1 / n for n, _ in host.values()) / len(p)
    return m, max(0.0, m * (1 - m) / between - 1) if between > m * (1 - m) / 10001 else 10000.0


def test_rates_are_shrunk_with_the_moments_prior(make):
    from collections import defaultdict

    host = defaultdict(lambda: [0, 0])
    for _, t, _, s in corpus():
        host[s][0] += 1
        host[s][1] += len(t.split()) < 50
    m, s = moments(host)
    assert 0 < s < 10000
    got = {r["host"]: r["host_rate"] for r in quality.host_quality(make(corpus())).select("host", "host_rate").distinct().collect()}
    assert got == {h: pytest.approx((f + m * s) / (n + s)) for h, (n, f) in host.items()}


@pytest.mark.parametrize("times", [1, 10, 100])
def test_a_bad_host_is_found_in_any_corpus(spark, times):
    """One host that always fails beside twenty that fail at times, however large these are."""
    rows = [(f"h{h}", i % 7 == 0, 25 * times) for h in range(20) for i in range(7)] + [("bad", True, 100)]
    failed = spark.createDataFrame(rows, "host string, failed boolean, n int").selectExpr("host", "failed", "explode(sequence(1, n)) as k").drop("k")
    got = {r["host"]: (r["rejected"], r["rate"]) for r in quality.host_verdicts(failed, quality.Rules()).collect()}
    assert [h for h, (rejected, _) in got.items() if rejected] == ["bad"] and got["bad"][1] > 0.95 and got["h3"][1] < 0.2


def test_hosts_vouch_for_documents_that_only_fail_other_rules(make):
    good = " ".join(f"w{i}" for i in range(60))
    symbols = " ".join(f"w{i}##" for i in range(60))  # passes the base rules
    rows = [(i, good, "en", "trusted") for i in range(200)] + [(1000 + i, good if i % 3 else "x", "en", "doubtful") for i in range(200)]
    rows += [(2000, symbols, "en", "trusted"), (2001, symbols, "en", "doubtful"), (2002, good, "en", "doubtful")]
    got = {r["doc_id"]: r["kept"] for r in quality.host_quality(make(rows)).collect()}
    assert got[2000] and not got[2001] and got[2002] and got[0] and got[1001] and not got[1000]
    assert {r["doc_id"] for r in quality.keep_good_hosts(make(rows)).collect()} == {i for i, k in got.items() if k}


def test_long_words_of_a_known_bad_sequence_are_told_apart(make):
    """Words that every polynomial modulo 2 ** 64 gives one value."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    text = " ".join(["x", a, "y", "x", b, "y"] + [f"w{i}" for i in range(60)])
    assert len(a) == 2048 and [r["n_repeat_words"] for r in quality.host_quality(make([(1, text)])).collect()] == [0]


def test_one_host_and_empty(make):
    assert quality.host_quality(make([])).count() == quality.keep_good_hosts(make([])).count() == 0
    assert [r["kept"] for r in quality.host_quality(make([(1, None)])).collect()] == [False]
    assert quality.keep_good_hosts(make(odd_rows())).where(F.col("doc_id") == 6).count() == 0
