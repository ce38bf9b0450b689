"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled 1) and unlabelled text train a small
network under the non-negative unbiased risk

    pi * E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - pi * E_p[l(g, -1)])

with the logistic loss l. Labels 0 are never read. The class prior pi is
estimated from the same two samples: a first network separates positives
from unlabelled text, and pi is the smallest ratio, over score thresholds, of
the unlabelled share above the threshold to the positive share above it
(with a confidence margin for both shares), measured on halves of the samples
that network did not see.

Fitting reads a bounded sample (about ``max_positives`` and
``max_unlabelled`` documents, drawn at random by a fixed seed); scoring reads every whole text, one
pass, without a shuffle.

Defined results: null text counts as empty; an empty text gets a score from
its (all-zero) features; a null id is never held out and never labelled;
repeated rows are scored each; no positives or no unlabelled rows: every
score is 0.5; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, fold, map_text, strings, thinned, thinned_keys

by_value(__name__)

BIGRAM_SLOTS = 96
MARKS = b".,!|#%&*$?:;'\"-_/()<>[]{}=+@~^`\\"
THRESHOLD = 0.3


def features(text: str) -> np.ndarray:
    """Shares of character classes, marks, repeated words and lines, and a
    hashed histogram of byte pairs of the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, raw.size)
    hist = np.bincount(raw, minlength=256) / n
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words)) / k
    alnum_end = sum(w[-1].isalnum() for w in words) / k
    same = sum(map(str.__eq__, words, words[1:])) / k
    distinct = len(set(words)) / k if words else 0.0
    shares = [
        hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[128:].sum(), hist[32], hist[10],
        upper, alnum_end if words else 0.0, same, distinct, len(set(lines)) / len(lines) if words else 0.0,
        *hist[np.frombuffer(MARKS, dtype=np.uint8)],
    ]
    shares = np.asarray(shares)
    pairs = np.zeros(BIGRAM_SLOTS)
    if raw.size > 1:
        slot = (raw[:-1].astype(np.int32) * 31 + raw[1:]) % BIGRAM_SLOTS
        pairs = np.bincount(slot, minlength=BIGRAM_SLOTS) / raw.size
    size = [np.log1p(raw.size) / 10.0, np.log1p(len(words)) / 10.0, raw.size / k / 20.0 if words else 0.0]
    return np.concatenate([shares, np.sqrt(shares), np.sqrt(pairs), np.minimum(size, 5.0)])


def feature_rows(texts: list[str]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, len(features(""))))


@dataclass
class Net:
    """One hidden layer of tanh units over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * m))


def _softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, v)


def pu_weights(mp: np.ndarray, mu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk and its derivative by each margin. Where the
    negative part falls below zero, the step undoes that part alone."""
    pos = prior * _softplus(-mp).mean()
    neg = _softplus(mu).mean() - prior * _softplus(mp).mean()
    dp_pos = -prior * sigmoid(-mp) / mp.size
    dp_neg = -prior * sigmoid(mp) / mp.size
    du_neg = sigmoid(mu) / mu.size
    if neg >= 0:
        return pos + neg, dp_pos + dp_neg, du_neg
    return pos, -dp_neg, -du_neg


def pn_weights(mp: np.ndarray, mu: np.ndarray, _: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Plain separation of the two samples, each with half the weight."""
    loss = 0.5 * (_softplus(-mp).mean() + _softplus(mu).mean())
    return loss, -0.5 * sigmoid(-mp) / mp.size, 0.5 * sigmoid(mu) / mu.size


def train(xp: np.ndarray, xu: np.ndarray, prior: float, weights, steps: int, hidden: int = 8, seed: int = 7,
          decay: float = 3e-3, batch: int = 8192) -> Net:
    rng = np.random.default_rng(seed)
    both = np.concatenate([xp, xu])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    net = Net(mean, scale, rng.normal(0, 0.1, (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (xp, xu))
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        bp = zp[rng.integers(0, len(zp), min(batch, len(zp)))]
        bu = zu[rng.integers(0, len(zu), min(batch, len(zu)))]
        x = np.concatenate([bp, bu])
        h = np.tanh(x @ params[0] + params[1])
        m = h @ params[2] + params[3][0]
        _, dp, du = weights(m[: len(bp)], m[len(bp):], prior)
        d = np.concatenate([dp, du])
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
        rate = 0.01 * (0.1 ** (t / steps))
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Net(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def estimate_prior(sp: np.ndarray, su: np.ndarray, sure: float = 0.1) -> float:
    """Smallest ratio of shares above a threshold, plus a margin for the
    sampling error of both shares."""
    cuts = np.unique(sp)
    share_p = 1 - np.searchsorted(np.sort(sp), cuts, "left") / sp.size
    share_u = 1 - np.searchsorted(np.sort(su), cuts, "left") / su.size
    err = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(sp.size) + 1 / np.sqrt(su.size))
    at = np.argmin((share_u + err) / np.maximum(share_p, 1e-9))
    return float(np.clip(share_u[at] / max(share_p[at], 1e-9), 0.02, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 300) -> tuple[Net | None, float]:
    """(network, estimated prior); no network without both samples."""
    if not len(xp) or not len(xu):
        return None, 0.5
    first = train(xp[::2], xu[::2], 0.5, pn_weights, steps)
    prior = estimate_prior(first.margin(xp[1::2] if len(xp) > 1 else xp), first.margin(xu[1::2] if len(xu) > 1 else xu))
    return train(xp, xu, prior, pu_weights, steps), prior


def _gather(rows: DataFrame) -> np.ndarray:
    """Features of a bounded sample ``_text``, computed by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(strings(b, "_text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    got = sorted(bytes(r["x"]) for r in map_text(rows.select("_text"), run, "x binary").collect())
    if not got:
        return np.zeros((0, len(features(""))))
    x = np.frombuffer(b"".join(got), dtype=np.float32).reshape(len(got), -1)
    return x[np.random.default_rng(2).permutation(len(x))]


@dataclass
class QualityModel:
    net: Net | None
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        return np.clip(self.net.score(feature_rows(texts)), 0.0, 1.0) if texts else np.zeros(0)


def fit_quality(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                exclude: Column | None = None, max_positives: int = 8000, max_unlabelled: int = 20000) -> QualityModel:
    """Learn from ``positives`` (a table with ``id_col``) and from the other
    texts of ``docs``. ``exclude``: rows of ``docs`` to leave out of both
    samples (the held-out fold)."""
    base = docs if exclude is None else docs.filter(~F.coalesce(exclude, F.lit(False)))
    base = base.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null")
    known = positives.select(F.col(id_col).alias("_id")).dropDuplicates()
    ids = thinned_keys(base.select("_id").dropDuplicates().join(known, "_id", "left_semi"), max_positives, 41)
    trusted = base.join(F.broadcast(ids), "_id", "left_semi").dropDuplicates(["_id"])
    net, prior = fit(_gather(trusted), _gather(thinned(base, max_unlabelled, 43)))
    return QualityModel(net, prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score, predicted`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(strings(b, "_text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                [id_col, "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = docs.select(id_col).schema.add("score", "double").add("predicted", "integer")
    return map_text(rows, run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(strings(b, text_col)) >= threshold, pa.bool_()))

    return map_text(docs, run, docs.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col, 5) == 0, F.lit(False))


def learn_from_labels(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Trusted positives: labelled 1 outside the held-out fold."""
    positives = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    return fit_quality(docs, positives, exclude=held_out(F.col("doc_id")))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs, learn_from_labels(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
