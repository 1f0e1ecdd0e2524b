"""Toxicity with subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the bag of its byte n-grams and itself, hashed into a table of vectors; a passage is the
mean of its two words; a linear softmax over two labels scores it, and a document's logit is a soft
maximum over its passages. Vectors and softmax are trained jointly. Misspelt or inflected words share
n-grams with those seen, and so their vectors.

As the model is linear behind the vectors, a bag's logit is the mean of its n-grams' logits: one
number for each bucket is all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held_out
from .textops import ALNUM_LOWER, Words, chunks, mix, words

BUCKETS, NGRAMS, DIM, PASSAGE = 1 << 18, (3, 4, 5), 8, 2
THRESHOLD = 0.3
SHARPNESS = 1.0  # of the mean over a document's passages: 0 is the plain mean, infinity the maximum
_MUL = np.uint64(0x9E3779B97F4A7C15)


def subwords(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word in ``pick``) of each subword of the picked words: n-grams of
    <word>, and the word itself."""
    size = w.end[pick] - w.start[pick] + 2
    end = np.cumsum(size)
    begin, total = end - size, int(end[-1]) if len(end) else 0
    owner = np.repeat(np.arange(len(pick)), size)
    inner = np.arange(total) - begin[owner]
    text = np.where(inner == 0, 0x3C, np.where(inner == size[owner] - 1, 0x3E, w.data[np.clip(w.start[pick][owner] + inner - 1, 0, max(0, len(w.data) - 1))])).astype(np.uint64)
    bucket, of = [w.hash[pick] % np.uint64(BUCKETS)], [np.arange(len(pick))]
    for n in NGRAMS:
        at = np.flatnonzero(inner <= size[owner] - n)
        with np.errstate(over="ignore"):
            code = np.full(len(at), n, np.uint64)
            for j in range(n):
                code = code * _MUL + text[at + j]
            bucket.append(mix(code) % np.uint64(BUCKETS))
        of.append(owner[at])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    logit: np.ndarray  # of each bucket
    bias: float

    def word_logits(self, w: Words) -> np.ndarray:
        """Each distinct word of the chunk is looked up once."""
        _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        bucket, of = subwords(w, first)
        return (np.bincount(of, self.logit[bucket], len(first)) / np.maximum(1, np.bincount(of, minlength=len(first))))[back]


def passages(first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, document of each passage): PASSAGE words each, the rest of a
    document is its last."""
    nth = np.arange(len(doc)) - first[doc]
    head = nth % PASSAGE == 0
    return np.cumsum(head) - 1, doc[head]


def document_logits(score: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A soft maximum over each document's passages, and the passages' weights in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, of, score)
    weight = np.exp(SHARPNESS * (score - top[of]))
    weight /= np.bincount(of, weight, n)[of]
    return np.bincount(of, weight * score, n), weight


def train(texts: list[str], target: np.ndarray, *, epochs: int = 60, rate: float = 4.0, seed: int = 3, patience: int = 10) -> Model:
    """Gradient descent on the mean log loss of a softmax over two columns (both labels weighted
    alike), each bucket's steps scaled by its own gradients so far (Adagrad). Only the buckets that the
    sample has are trained; others score 0. Stops early where the loss has not fallen by a thousandth
    in ``patience`` epochs."""
    r = np.random.default_rng(seed)
    # Each distinct word of the sample has its subwords once.
    buckets, owners, tokens, docs, known, n_words, at = [], [], [], [], np.zeros(0, np.uint64), 0, 0
    for lo, hi, data, offsets in chunks(pa.array(texts, pa.string())):
        w = words(data, offsets, ALNUM_LOWER, fold=True)
        own, first = np.unique(w.hash, return_index=True)
        new = ~np.isin(own, known, assume_unique=True)
        b, o = subwords(w, first[new])
        buckets.append(b), owners.append((o + n_words).astype(np.int32)), tokens.append(w.hash), docs.append((w.doc + at).astype(np.int32))
        known = np.concatenate([known, own[new]])
        n_words += int(new.sum())
        at += hi - lo
    bucket, owner, doc = (np.concatenate(x) for x in (buckets, owners, docs))
    order = np.argsort(known)
    code = order[np.searchsorted(known, np.concatenate(tokens), sorter=order)].astype(np.int32)
    del buckets, owners, tokens, docs, known, order
    rows, place = np.unique(bucket, return_inverse=True)  # the buckets there are
    vectors, head, bias = r.normal(0, 0.05, (len(rows), DIM)), np.outer(np.ones(DIM), [-0.5, 0.5]) / np.sqrt(DIM), np.array([1.0, -1.0])
    per_word = np.maximum(1, np.bincount(owner, minlength=n_words))
    n = len(texts)
    start = np.searchsorted(doc, np.arange(n + 1))
    passage, of = passages(start, doc)
    per_passage = np.bincount(passage)
    y = target.astype(float)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    seen, seen_bias, best, since = np.full(len(rows), 1e-8), 1e-8, np.inf, 0
    for _ in range(epochs):
        turn = head[:, 1] - head[:, 0]  # the softmax's log odds are linear in the mean vector
        word = np.bincount(owner, (vectors @ turn)[place], n_words) / per_word
        score = np.bincount(passage, word[code]) / per_passage + (bias[1] - bias[0])
        z, weight = document_logits(score, of, n)
        z[np.diff(start) == 0] = bias[1] - bias[0]
        p = 1 / (1 + np.exp(-z))
        loss = -(share * np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, None))).sum()
        since = 0 if loss < best * 0.999 else since + 1
        best = min(best, loss)
        if since >= patience:
            break
        g = share * (p - y)  # by the toxic column's logit; the other's is its negative
        g_word = np.bincount(code, ((g[of] * weight) / per_passage)[passage], n_words) / per_word
        g_row = np.bincount(place, g_word[owner], len(rows))
        g_head = g_row @ vectors
        seen += g_row**2
        seen_bias += g.sum() ** 2
        vectors -= (rate * g_row / np.sqrt(seen))[:, None] * turn / (turn @ turn)
        head += 1e-3 * np.outer(g_head / max(1e-12, np.abs(g_head).max()), [1.0, -1.0])
        bias -= 0.05 * g.sum() / np.sqrt(seen_bias) * np.array([-1.0, 1.0])
    logit = np.zeros(BUCKETS, np.float32)
    logit[rows] = vectors @ (head[:, 1] - head[:, 0])
    return Model(logit, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 2000, max_other: int = 4000, max_chars: int = 20_000, **how) -> Model:
    """Trains on a bounded sample of labelled documents outside the held-out fold: about
    ``max_toxic`` and ``max_other``, of at most ``max_chars`` code points, chosen by a hash of the id.
    A document with several labels counts as toxic if one says so."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.when(F.col("y") == 1, 1).otherwise(0)).alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chance = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.when(F.col("y") == 1, min(1.0, max_toxic / max(1, count.get(1, 0)))).otherwise(min(1.0, max_other / max(1, count.get(0, 0))))
    sample = known.where(chance < wanted).limit(2 * (max_toxic + max_other))
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") <= max_chars)
    rows = picked.join(F.broadcast(sample), F.col("_id") == F.col("id")).select("id", "y", "text").collect()
    if len({r["y"] for r in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if rows and rows[0]["y"] else -4.0)
    rows.sort(key=lambda r: (str(r["id"]), r["text"]))
    return train([r["text"] for r in rows], np.array([r["y"] for r in rows]), **how)


def score_texts(model: Model, text: pa.Array) -> np.ndarray:
    out = np.zeros(len(text))
    for lo, hi, data, offsets in chunks(text):
        w = words(data, offsets, ALNUM_LOWER, fold=True)
        z = np.full(hi - lo, model.bias)
        if len(w.hash):
            passage, of = passages(w.first, w.doc)
            score = np.bincount(passage, model.word_logits(w)) / np.bincount(passage) + model.bias
            soft, _ = document_logits(score, of, hi - lo)
            some = np.diff(w.first) > 0
            z[some] = soft[some]
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, threshold: float = THRESHOLD, **how) -> DataFrame:
    """Returns id, held_out, score and predicted (1 if score >= ``threshold``) of whole texts, a
    row for each row of ``docs``. Trains on ``labels`` first if no model is given.

    Defined cases: a null, empty or wordless text gets the bias's score; without labels of both
    kinds every score is that of the one kind (low if there are none); a row with a null id is
    not held out; repeated rows are scored each; an empty table gives an empty one; other columns
    are not read.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = score_texts(model, column(b, "text"))
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
