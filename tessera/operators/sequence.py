"""Sequences of windows, and a recurrent classifier trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dense_sequences(facts: DataFrame, steps: int, dim: int, keys: Sequence[str] = ("tile_id", "year"), step: str = "window_index", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each key with ``seq``, an array of struct<step, vector, label, valid> for steps 1
    to ``steps``. A missing step has a zero vector, label -1 and is not valid; so is a step whose
    label is unknown. Two facts of one step: the larger vector by order of elements is taken."""
    one = facts.groupBy(*keys, F.col(step).cast("int").alias("step")).agg(F.max(F.struct(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y"))).alias("_f"))
    packed = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "_f"))).alias("_m"))
    zero = F.array_repeat(F.lit(0.0), dim)

    def cell(i):
        found = F.element_at(F.col("_m"), i)
        y = F.coalesce(found["y"], F.lit(-1))
        return F.struct(i.alias("step"), F.coalesce(found["v"], zero).alias("vector"), y.alias("label"), (found["v"].isNotNull() & y.isin(0, 1)).alias("valid"))

    return packed.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(steps)), cell).alias("seq"))


@dataclass
class GRU:
    """One gated recurrent layer and a linear head on every step."""

    wx: np.ndarray  # dim x 3h: update, reset, candidate
    wh: np.ndarray  # h x 3h
    b: np.ndarray
    out: np.ndarray  # h
    out_b: float = 0.0

    @classmethod
    def new(cls, dim: int, hidden: int, seed: int) -> GRU:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, dim**-0.5, (dim, 3 * hidden)), r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), np.zeros(3 * hidden), r.normal(0, hidden**-0.5, hidden))

    @classmethod
    def of(cls, weights: DataFrame) -> GRU:
        """From the five rows that ``weights`` gives."""
        rows = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in weights.limit(6).collect()}
        return cls(**{**rows, "out_b": float(rows["out_b"])})

    def weights(self, spark: SparkSession) -> DataFrame:
        """Rows (name, shape, values), to be written as Parquet."""
        rows = [(n, list(np.shape(w)), np.ravel(w).tolist()) for n, w in vars(self).items()]
        return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """x (n, t, dim) -> logits (n, t), and what the backward pass needs."""
        n, t, _ = x.shape
        k = len(self.out)
        h, logits, kept = np.zeros((n, k)), np.zeros((n, t)), []
        for i in range(t):
            a, u = x[:, i] @ self.wx + self.b, h @ self.wh
            z, r = (1 / (1 + np.exp(-(a[:, s] + u[:, s]))) for s in (slice(0, k), slice(k, 2 * k)))
            c = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            new = (1 - z) * c + z * h
            kept.append((h, z, r, c, u[:, 2 * k :], new))
            h = new
            logits[:, i] = h @ self.out + self.out_b
        return logits, kept

    def gradients(self, x: np.ndarray, kept: list[tuple], d: np.ndarray) -> dict[str, np.ndarray]:
        """d: gradient by the logits. Back through time."""
        k = len(self.out)
        g = {"wx": np.zeros_like(self.wx), "wh": np.zeros_like(self.wh), "b": np.zeros_like(self.b), "out": np.zeros_like(self.out), "out_b": d.sum()}
        dh = np.zeros((len(x), k))
        for i in range(x.shape[1] - 1, -1, -1):
            h, z, r, c, uc, new = kept[i]
            g["out"] += new.T @ d[:, i]
            dh = dh + np.outer(d[:, i], self.out)
            dc = dh * (1 - z) * (1 - c * c)
            dz, dr = dh * (h - c) * z * (1 - z), dc * uc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            g["wx"] += x[:, i].T @ da
            g["wh"] += h.T @ du
            g["b"] += da.sum(axis=0)
            dh = dh * z + du @ self.wh.T
        return g


def rank_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve by mid-ranks; not a number with labels of one kind."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return float("nan")
    _, back, ties = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(ties) - (ties - 1) / 2)[back]
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))


def train_gru(x: np.ndarray, y: np.ndarray, valid: np.ndarray, *, watched: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, hidden: int = 128, epochs: int = 80, batch: int = 64, rate: float = 5e-4, decay: float = 1e-5, seed: int = 42) -> GRU:
    """Adam on masked cross entropy, positives weighted so that both classes count alike.

    With ``watched`` sequences (x, y, valid) the net of the epoch with the highest ROC AUC on their
    valid steps is returned, the first of equals; without, or where no epoch has one, the last."""
    net, r = GRU.new(x.shape[2], hidden, seed), np.random.default_rng(seed)
    pos, neg = int((y[valid] == 1).sum()), int((y[valid] == 0).sum())
    weight = max(neg, 1) / max(pos, 1)
    names = ("wx", "wh", "b", "out", "out_b")
    m, v, step = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    best, chosen = -1.0, None
    for _ in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), batch):
            pick = order[lo : lo + batch]
            logits, kept = net.forward(x[pick])
            p, ok = 1 / (1 + np.exp(-logits)), valid[pick]
            yy = np.where(ok, y[pick], 0)
            d = np.where(yy == 1, weight * (p - 1), p) * ok / max(1, ok.sum())
            step += 1
            for name, g in net.gradients(x[pick], kept, d).items():
                g = g + decay * getattr(net, name)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8))
        if watched is not None:
            auc = rank_auc(watched[1][watched[2]], net.forward(watched[0])[0][watched[2]])
            if auc > best:
                best, chosen = auc, copy.deepcopy(net)
    return chosen or net


def _sample(sequences: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Vectors, labels and valid flags of at most ``n`` rows, by a seeded hash of their keys."""
    keys = [c for c in sequences.columns if c != "seq"]
    rows = sequences.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n).collect()
    part = lambda name, kind: np.array([[s[name] for s in r["seq"]] for r in rows], dtype=kind)
    return (part("vector", float), part("label", int), part("valid", bool)) if rows else None


def fit_gru(sequences: DataFrame, *, watched: DataFrame | None = None, max_sequences: int = 5000, seed: int = 42, **how) -> GRU:
    """Trains on the driver on a bounded sample; ``watched`` sequences (a sample of the same bound)
    choose the epoch."""
    if (sample := _sample(sequences, max_sequences, seed)) is None:
        raise ValueError("no sequences to train on")
    return train_gru(*sample, watched=None if watched is None else _sample(watched, max_sequences, seed), seed=seed, **how)


def score_gru(sequences: DataFrame, net: GRU) -> DataFrame:
    """A row for each key and step, valid or not: step, label, valid and p_stressed."""
    keys = [f for f in sequences.schema if f.name != "seq"]
    names = [f.name for f in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", step int, label int, valid boolean, p_stressed double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array([[np.asarray(s["vector"], float) for s in seq] for seq in part["seq"]])
            p = 1 / (1 + np.exp(-net.forward(x)[0]))
            out = part[names].loc[part.index.repeat(x.shape[1])].reset_index(drop=True)
            flat = [s for seq in part["seq"] for s in seq]
            yield out.assign(step=[s["step"] for s in flat], label=[s["label"] for s in flat], valid=[s["valid"] for s in flat], p_stressed=p.ravel())

    return sequences.mapInPandas(run, schema)
