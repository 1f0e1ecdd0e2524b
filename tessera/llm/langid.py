"""Language identification with a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's
greatest activation in the window feeds a softmax. A text is cut into such windows from its first
byte to its last, and the windows' probabilities are averaged by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, held_out
from .textops import chunks

WINDOW, WIDTHS, EMBED, FILTERS = 128, (2, 3, 4), 8, 8
UNKNOWN = "und"


@dataclass
class Network:
    """Weights. The filters of all widths are one matrix over the widest; a narrower filter's
    weights for the bytes it doesn't see are zero, and stay so."""

    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # widest * EMBED x number of filters
    bias: np.ndarray
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        m = np.zeros((max(WIDTHS), EMBED, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            m[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        return m.reshape(max(WIDTHS) * EMBED, -1)

    @classmethod
    def new(cls, labels: list[str], seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return cls(labels, r.normal(0, 0.5, (256, EMBED)).astype(np.float32), r.normal(0, 0.3, (max(WIDTHS) * EMBED, n)).astype(np.float32) * cls.mask(), np.zeros(n, np.float32), r.normal(0, 0.1, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def columns(self, x: np.ndarray) -> np.ndarray:
        """x: windows of bytes (n, WINDOW) -> (n, positions, widest * EMBED)."""
        e = self.embed[x]
        at = x.shape[1] - max(WIDTHS) + 1
        cols = np.empty((x.shape[0], at, max(WIDTHS) * EMBED), np.float32)
        for j in range(max(WIDTHS)):
            cols[:, :, j * EMBED : (j + 1) * EMBED] = e[:, j : j + at]
        return cols

    def pooled(self, x: np.ndarray) -> np.ndarray:
        c = self.columns(x)
        return np.maximum((c.reshape(-1, c.shape[2]) @ self.filters).reshape(*c.shape[:2], -1).max(axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], *, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on cross entropy, classes weighted alike. Half the windows of each pass are cut short
    at random, so that short texts are learnt, too."""
    net, r = Network.new(labels, seed), np.random.default_rng(seed)
    weight = len(target) / (len(labels) * np.maximum(1, np.bincount(target, minlength=len(labels))))
    names = ("embed", "filters", "bias", "out", "out_bias")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    steps = epochs * -(-len(target) // batch)
    for _ in range(epochs):
        order = r.permutation(len(target))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            x, y = windows[pick].copy(), target[pick]
            cut = np.where(r.random(len(pick)) < 0.5, r.integers(6, WINDOW, len(pick)), WINDOW)
            x[np.arange(WINDOW) >= cut[:, None]] = 0
            c = net.columns(x)
            act = (c.reshape(-1, c.shape[2]) @ net.filters).reshape(*c.shape[:2], -1)
            at = act.argmax(axis=1)  # n x filters
            raw = np.take_along_axis(act, at[:, None], 1)[:, 0] + net.bias
            h = np.maximum(raw, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            d *= (weight[y] / len(y))[:, None]
            d = d.astype(np.float32)
            g = {"out": h.T @ d, "out_bias": d.sum(axis=0)}
            dh = (d @ net.out.T) * (raw > 0)
            g["bias"] = dh.sum(axis=0)
            best = np.take_along_axis(c, at[:, :, None], 1)  # n x filters x columns: where each filter was greatest
            g["filters"] = np.einsum("nf,nfk->kf", dh, best) * Network.mask()
            dc = (dh[:, :, None] * net.filters.T[None]).reshape(*at.shape, max(WIDTHS), EMBED)
            g["embed"] = np.zeros_like(net.embed)
            row = np.arange(len(y))[:, None]
            for j in range(max(WIDTHS)):
                np.add.at(g["embed"], x[row, at + j], dc[:, :, j])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, (getattr(net, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3000, windows_each: int = 4, max_labels: int = 10_000, **how) -> Network | None:
    """Trains on a bounded sample of the labelled documents outside the held-out fold: about
    ``max_docs`` documents, dealt evenly among all languages (one each at least), chosen by a hash of
    their ids, and of each ``windows_each`` windows spread over its text. Every language is learnt:
    more than ``max_labels`` are refused, as they are no languages. Returns None if there is no
    labelled document."""
    usable = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("id")))
    counts = usable.groupBy("lang").count()
    n_labels = counts.limit(max_labels + 1).count()
    if n_labels > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    if not n_labels:
        return None
    each = max(1, max_docs // n_labels)
    n, chance = F.length("text"), F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    # Twice as many as wanted, and fifty at least, so that no language is without.
    rates = counts.select(F.col("lang").alias("_lang"), (max(2 * each, 50) / F.col("count")).alias("rate"))
    starts = [F.floor(F.greatest(n - WINDOW, F.lit(0)) * (k / max(1, windows_each - 1))).cast("int") + 1 for k in range(windows_each)]
    cuts = F.array_distinct(F.array(*(F.substring(F.col("text"), s, F.lit(WINDOW)) for s in starts)))
    picked = usable.withColumn("chance", chance).join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where("chance < rate")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id", "text"))  # at most some times ``each`` a language
    rows = picked.withColumn("rank", rank).where(F.col("rank") <= each).select("id", "lang", cuts.alias("cuts")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["lang"], r["cuts"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    text = [(c.encode()[:WINDOW], r["lang"]) for r in rows for c in r["cuts"] if c]
    x = np.zeros((max(1, len(text)), WINDOW), np.uint8)
    for i, (b, _) in enumerate(text):
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = np.array([labels.index(lang) for _, lang in text] or [0])
    return train(x, y, labels, **how)


def _predicted(net: Network, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fold, letters = column(b, "id"), column(b, "held_out"), column(b, "letters").to_pylist()
            for lo, hi, data, offsets in chunks(column(b, "text")):
                n = np.diff(offsets)
                count = -(-n // WINDOW)  # windows of each text; the last is filled up with zeros
                doc = np.repeat(np.arange(hi - lo), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = offsets[doc] + nth * WINDOW
                size = np.minimum(WINDOW, offsets[doc + 1] - start)
                total = np.zeros((hi - lo, len(net.labels)))
                padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
                for s in range(0, len(doc), 128):
                    e = min(s + 128, len(doc))
                    x = padded[start[s:e, None] + np.arange(WINDOW)]
                    x[np.arange(WINDOW) >= size[s:e, None]] = 0
                    np.add.at(total, doc[s:e], net.probabilities(x) * size[s:e, None])
                share = total / np.maximum(n, 1)[:, None]
                best = share.argmax(axis=1)
                known = [letters[lo + i] and n[i] > 0 for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), fold.slice(lo, hi - lo), pa.array([net.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known)]), pa.array([float(min(1.0, share[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best.tolist(), known))])], schema=schema
                )

    return run


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None, **how) -> DataFrame:
    """Returns id, held_out, lang_pred and score (the prediction's mean probability) of whole
    texts, a row for each row of ``docs``. Trains first if no network is given.

    Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every
    text if there is nothing to learn from; a row with a null id is not held out; repeated rows
    are predicted each; an empty table gives an empty one; other columns are not read.
    """
    net = net or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how) or Network.new([UNKNOWN], 0)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    text = F.col(f"`{text_col}`")
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    return picked.mapInArrow(_predicted(net, schema), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
