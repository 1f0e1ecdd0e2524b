import random
import re

from tessera.llm import licenses

from .conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def wrapped(text, templates, threshold):
    """(label, share) of every run of words over a line end in a paragraph, no longer than the template,
    that contains it, and none of whose lines does so alone."""
    lines = [WORD.findall(x) for x in text.split("\n")]
    for label, template in templates:
        code = WORD.findall(low(template))
        s = set(code)
        enough = lambda have: len(have) >= threshold * len(s) - 1e-9
        alone = [enough(s & set(x)) for x in lines]
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and lines[end]:
                end += 1
            words = [(x, k) for k in range(at, end) for x in lines[k]]
            if enough(s & {x for x, _ in words}):
                for q in range(len(words)):
                    have = set()
                    for x, k in words[q : q + len(code)] if words[q][0] in s else ():
                        if x in s:
                            have.add(x)
                            if k > words[q][1] and enough(have) and not any(alone[words[q][1] : k + 1]):
                                yield label, len(have) / len(s)
            at = end + 1


def brute(rows, templates=licenses.TEMPLATES, threshold=0.8):
    sets = [(label, set(WORD.findall(low(t)))) for label, t in templates]
    out = []
    for i, t in rows:
        w = WORD.findall(low(t))
        places, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        found, best = set(), 0.0
        for line in low(t).split("\n"):
            have = set(WORD.findall(line))
            for label, s in sets:
                share = len(s & have) / len(s)
                if share >= threshold - 1e-9:
                    found.add(label)
                    best = max(best, share)
        for label, share in wrapped(low(t), templates, threshold):
            found.add(label)
            best = max(best, share)
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best))
    return sorted(out, key=str)


def test_like_brute_force(make):
    r = random.Random(4)
    words = "mit license apache general public the licensed under version 2 0 3 by cc nc sa rights reserved all software é".split()
    rows = []
    for i in range(150):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(0, 5))]
        if r.random() < 0.5:
            t = r.choice(licenses.TEMPLATES)[1].split()
            lines.insert(0, " ".join(x.upper() if r.random() < 0.2 else x for x in t if r.random() < 0.9))
        rows.append((i, "\n".join(lines)))
    rows += [(x[0], x[1]) for x in odd_rows()]
    got = licenses.scan_licenses(make(rows)).drop("blocks").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_blocks_say_where(make):
    rows = [(1, "x\nall  Rights\treserved\n\nLicensed under CC BY-NC 4.0."), (2, "all rights reserved")]
    got = {r["doc_id"]: sorted((b["label"], b["line"]) for b in r["blocks"]) for r in licenses.scan_licenses(make(rows)).collect()}
    assert got[1] == [("arr", 1), ("cc-by", 3), ("cc-by-nc", 3), ("cc-by-sa", 3)] and got[2] == [("arr", 0)]


WRAPPED = {
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:""",
    "mit": """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this""",
    "arr": """All
rights
reserved""",
}


def test_notices_wrapped_over_lines(make):
    texts = [f"some words\n\n{t}\n\nmore words" for t in WRAPPED.values()] + [t.replace("\n", "\r\n") + "\r\n" for t in WRAPPED.values()]
    texts += ["all rights\n\nreserved", "all rights\n" + "of other people are\n" + "well reserved", "all rights", "reserved", "x all\nAll rights reserved\nreserved"]
    got = {r["doc_id"]: [(b["label"], b["line"], b["containment"]) for b in r["blocks"]] for r in licenses.scan_licenses(make(list(enumerate(texts)))).collect()}
    n = len(WRAPPED)
    for i, label in enumerate(WRAPPED):
        assert [(x, at) for x, at, _ in got[i]] == [(label, 2)] and [(x, at) for x, at, _ in got[n + i]] == [(label, 0)]
        assert min(share for *_, share in got[i]) > 0.9  # words put into the MIT notice count in its length
    assert [got[2 * n + i] for i in range(5)] == [[], [], [], [], [("arr", 1, 1.0)]]


def test_empty(make):
    assert licenses.scan_licenses(make([])).count() == 0
    assert licenses.scan_licenses(make([(1, "mit license")]), templates=()).first()["labels"] == "mit"


def test_sql_finds_the_same(make):
    import duckdb

    from tessera.llm import queries

    r = random.Random(9)
    rows = []
    for i in range(60):
        words = r.choice(licenses.TEMPLATES)[1].split()
        words = [x for x in words if r.random() < 0.93]
        for _ in range(r.randrange(0, 4)):
            words.insert(r.randrange(len(words) + 1), r.choice(["\n", "\n", "\n\n", "of", "the"]))
        rows.append((i, " ".join(r.choice(["a", "free", "\n"]) for _ in range(r.randrange(0, 6))) + " " + " ".join(words)))
    rows += [(x[0], x[1]) for x in odd_rows() if x[0] != 10]
    got = licenses.scan_licenses(make(rows)).drop("blocks").collect()
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(tuple, got), key=str) == sorted(db.sql(queries.SQL["op10_licenses"]).fetchall(), key=str) == brute(rows)
