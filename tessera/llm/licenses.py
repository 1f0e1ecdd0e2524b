"""License scan: an exact containment join between text blocks and license templates.

Tokens are ordered by their frequency in the whole corpus, rarest first. A block that contains at
least the threshold of a template's token set must contain one of the template's rarest tokens (the
prefix), must be at least as long as the overlap it needs, and at each shared prefix token enough
tokens must be left behind it on both sides. Blocks that pass these three filters are verified.

A block is a line, or a run of words over the ends of lines of one paragraph, as notices are wrapped.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .textops import ALNUM_LOWER, chunks, words

# The phrases and labels of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# License notices in common use, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("arr", "All rights reserved."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
)
MAX_TEMPLATES = 10_000  # templates are broadcast; more are refused

NEWLINE = np.uint8(0x0A)


def _codes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        w = words(data, offsets, ALNUM_LOWER, fold=True)
        out += [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(offsets) - 1)]
    return out


class Templates:
    """Templates with their tokens in global order, and the index of their prefixes."""

    def __init__(self, templates, threshold: float, frequency: dict[int, int]) -> None:
        self.threshold = threshold
        rank = {t: i for i, t in enumerate(sorted(frequency, key=lambda t: (frequency[t], t)))}
        self.rank, self.labels, self.tokens, self.need = rank, [], [], []
        self.codes: list[np.ndarray] = []
        self.span: list[int] = []  # the words that a run over line ends may have
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for label, code in templates:
            ordered = sorted({int(c) for c in code}, key=rank.__getitem__)
            if not ordered:
                continue
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            for at, t in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix[t].append((len(self.tokens), at))
            self.labels.append(label)
            self.tokens.append({rank[t] for t in ordered})
            self.need.append(need)
            self.codes.append(np.array(ordered, np.uint64))
            self.span.append(len(code))
        self.known = np.array(sorted(rank), np.uint64)
        self.seeds = np.array(sorted(self.prefix), np.uint64)

    def match(self, block: np.ndarray, n_tokens: int) -> list[tuple[int, float]]:
        """(template, containment) of each template that the block contains. block: its tokens
        that occur in templates, n_tokens: of all its tokens."""
        ranks = sorted({self.rank[int(c)] for c in block})
        have, found, seen = set(ranks), [], set()
        place = {r: i for i, r in enumerate(ranks)}
        for c in {int(c) for c in block}:
            for k, at in self.prefix.get(c, ()):
                if k in seen or n_tokens < self.need[k]:  # length
                    continue
                before, behind = min(at, place[self.rank[c]]), min(len(self.tokens[k]) - at, len(ranks) - place[self.rank[c]])
                if before + behind < self.need[k]:  # position: too few tokens are left on one side
                    continue
                seen.add(k)
                shared = len(self.tokens[k] & have)
                if shared >= self.need[k]:
                    found.append((k, shared / len(self.tokens[k])))
        return found

    def match_runs(self, block: np.ndarray, known: np.ndarray, line: np.ndarray, alone: dict[int, set[int]]) -> list[tuple[int, int, float]]:
        """(template, first line, containment) of the runs of words that contain a template and go
        over a line end. block: a paragraph's words, known: which occur in templates, line: their
        lines, alone: by template the lines that contain it themselves, which no run may touch. Of
        runs that overlap, the best one is given."""
        out = []
        for k, _ in self.match(np.unique(block[known]), len(block)):
            at = np.flatnonzero(np.isin(block, self.codes[k])).tolist()
            n: dict[int, int] = defaultdict(int)
            lo, best = 0, None  # best: containment, first and last word
            for p in at:
                n[int(block[p])] += 1
                while p - at[lo] >= self.span[k] or n[int(block[at[lo]])] > 1:
                    c = int(block[at[lo]])
                    n[c] -= 1
                    if not n[c]:
                        del n[c]
                    lo += 1
                first, last = int(line[at[lo]]), int(line[p])
                if len(n) < self.need[k] or first == last or any(x in alone.get(k, ()) for x in range(first, last + 1)):
                    continue
                share = len(n) / len(self.tokens[k])
                if best and at[lo] > best[2]:
                    out.append((k, int(line[best[1]]), best[0]))
                    best = None
                if not best or share > best[0]:
                    best = (share, at[lo], p)
            if best:
                out.append((k, int(line[best[1]]), best[0]))
        return out


def token_frequency(docs: DataFrame, text_col: str, wanted: np.ndarray) -> dict[int, int]:
    """How often each wanted token (a hash) occurs in all documents; tasks sum before they send."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for b in batches:
            for _, _, data, offsets in chunks(column(b, "text")):
                code = words(data, offsets, ALNUM_LOWER, fold=True).hash
                at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                n += np.bincount(at[wanted[at] == code], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(n)], schema=schema)

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect() if len(wanted) else []
    found = {r["token"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}
    return {int(t): found.get(int(t), 0) for t in wanted}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Returns id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks
    (label, line, containment of each block that meets the threshold), a row for each row of
    ``docs``. A block is a line of the text, or a run of words over line ends (given by its first
    line) in a paragraph, none of whose lines contains the template alone; a run has at most as
    many words as the template, and a paragraph ends at a line without words. score is the best
    containment found, 1 where a base phrase stands, 0 where nothing is found.

    Defined cases: a null or empty text has no words and no labels (empty strings); repeated rows
    are scanned each; an empty table gives an empty one; other columns are not read. Of templates
    with equal token sets both labels are given.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    codes = _codes([t for _, t in templates])
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
    index = Templates(list(zip([x for x, _ in templates], codes)), threshold, token_frequency(docs, text_col, known))
    wanted = [(c, label) for c, (_, label) in zip(_codes([p for p, _ in phrases]), phrases)]
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = column(b, "id"), column(b, "text")
            for lo, hi, data, offsets in chunks(text):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *_scanned(data, offsets, index, wanted, schema)], schema=schema)

    return (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(scan, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, line: long, containment: double>>")
        .withColumnRenamed("id", id_col)
    )


def _scanned(data: np.ndarray, offsets: np.ndarray, index: Templates, wanted, schema: pa.Schema) -> list[pa.Array]:
    w = words(data, offsets, ALNUM_LOWER, fold=True)
    n = len(offsets) - 1
    starts: dict[int, list[int]] = defaultdict(list)
    base: dict[int, set[str]] = defaultdict(set)
    for code, label in wanted:
        k = len(code)
        if not k or len(w.hash) < k:
            continue
        hit = w.doc[: len(w.doc) - k + 1] == w.doc[k - 1 :]
        for j in range(k):
            hit = hit & (w.hash[j : len(w.hash) - k + 1 + j] == code[j])
        for i in np.flatnonzero(hit).tolist():
            d = int(w.doc[i])
            starts[d].append(i - int(w.first[d]))
            base[d].add(label)
    # Lines and runs over them as blocks: the line of a word is the number of line ends before it, texts apart.
    blocks: dict[int, list[dict]] = defaultdict(list)
    if len(index.seeds) and len(w.hash):
        at = np.minimum(np.searchsorted(index.seeds, w.hash), len(index.seeds) - 1)
        seeded = np.flatnonzero(index.seeds[at] == w.hash)
        if len(seeded):
            ends = np.concatenate(([0], np.cumsum(data == NEWLINE)))
            line = ends[w.start] + w.doc  # grows at line ends and at texts
            at = np.minimum(np.searchsorted(index.known, w.hash), len(index.known) - 1)
            in_any = index.known[at] == w.hash
            alone: dict[int, set[int]] = defaultdict(set)  # lines by template; no two texts share a line
            for x in np.unique(line[seeded]).tolist():
                lo, hi = int(np.searchsorted(line, x)), int(np.searchsorted(line, x, "right"))
                for k, share in index.match(w.hash[lo:hi][in_any[lo:hi]], hi - lo):
                    alone[k].add(x)
                    d = int(w.doc[lo])
                    blocks[d].append({"label": index.labels[k], "line": int(x - d - ends[offsets[d]]), "containment": share})
            para = np.cumsum(np.concatenate(([0], (np.diff(line) > 1) | (np.diff(w.doc) > 0))))
            for x in np.unique(para[seeded]).tolist():
                lo, hi = int(np.searchsorted(para, x)), int(np.searchsorted(para, x, "right"))
                if line[lo] == line[hi - 1]:
                    continue
                d = int(w.doc[lo])
                for k, at_line, share in index.match_runs(w.hash[lo:hi], in_any[lo:hi], line[lo:hi], alone):
                    blocks[d].append({"label": index.labels[k], "line": int(at_line - d - ends[offsets[d]]), "containment": share})
    n_base = np.array([len(starts.get(d, ())) for d in range(n)], np.int64)
    labels = [",".join(sorted(base.get(d, set()) | {x["label"] for x in blocks.get(d, ())})) for d in range(n)]
    return [
        pa.array(np.diff(w.first).astype(np.int64)),
        pa.array(n_base),
        pa.array([min(starts[d]) if d in starts else None for d in range(n)], pa.int64()),
        pa.array([max(starts[d]) if d in starts else None for d in range(n)], pa.int64()),
        pa.array([",".join(sorted(base.get(d, ()))) for d in range(n)], pa.string()),
        pa.array(labels, pa.string()),
        pa.array([1.0 if d in base else max([0.0, *(x["containment"] for x in blocks.get(d, ()))]) for d in range(n)], pa.float64()),
        pa.array([blocks.get(d, []) for d in range(n)], schema.field("blocks").type),
    ]
