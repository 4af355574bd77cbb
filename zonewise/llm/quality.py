"""Quality classifier from positive and unlabelled documents.

The model minimises the non-negative unbiased risk  pi * E_pos[l(g)] + max(0, E_unl[l(-g)] - pi * E_pos[l(-g)])  with the logistic
loss: only trusted positives and unlabelled text enter it, never a negative label. The class prior pi is the share of
label 1 among the labelled rows that may be learnt from.

g adds up one weight per feature and quantile bin. Features describe the shape of a whole text: transitions between classes of
bytes, repetition of words and lines, word and line lengths. The fit uses bounded samples (``POSITIVES`` and ``UNLABELLED`` rows
in expectation, drawn by a hash of doc_id over all rows); scoring is one pass over all rows without a shuffle.

Defined cases: a null text is empty and gets the score of empty texts; rows without a doc_id are scored and count as not
held out; repeated rows get equal scores; without labels or documents to learn from every score is 0.5 (nothing is
rejected).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVES, UNLABELLED = 12_000, 24_000
BINS, STEPS, RATE, BOUND, PULL = 16, 250, 0.05, 3.0, 3.0

_kind = np.full(256, 6, np.uint8)  # other symbols
for _k, _chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:'\"-()?"]):
    _kind[list(_chars)] = _k
_kind[128:] = 7
N_FEATURES = 64 + 14


def features(text: str) -> np.ndarray:
    """Shape of a text; zeros for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    kinds = _kind[np.frombuffer(text.encode(), np.uint8)]
    n = len(kinds)
    counts = np.bincount(kinds[:-1].astype(np.int64) * 8 + kinds[1:], minlength=64)
    out[:64] = counts / max(1, n - 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = list(zip(words, words[1:], strict=False))
    seen = len(set(words))
    out[64:] = (
        np.log1p(n),
        seen / nw,
        seen / np.sqrt(nw),
        len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        sum(w.isupper() for w in words) / nw,
        sum(w.isalpha() for w in words) / nw,
        len(set(lines)) / nl,
        np.log1p(n / nl),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / nl,
        sum("|" in x for x in lines) / nl,
    )
    return out


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model | None:
    """Full-batch Adam with a falling rate; the weights of the least risk met on the way are kept.

    While the bounded part of the risk is negative it counts as zero and only the positive part has a gradient. g is bounded
    softly to +-BOUND inside the loss, so that a few confident rows cannot outweigh the rest, and a pull to zero of
    PULL / rows keeps small samples from being learnt by heart.
    """
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(unlabelled, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    model = Model(edges, np.zeros((both.shape[1], BINS)), 0.0)
    flat = model.bins(both) + np.arange(both.shape[1]) * BINS
    n_pos, size, pull = len(positive), both.shape[1] * BINS, PULL / len(both)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    least, kept = np.inf, theta
    for t in range(1, STEPS + 1):
        g = BOUND * np.tanh((theta[flat].sum(axis=1) + theta[-1]) / BOUND)
        gp, gu = g[:n_pos], g[n_pos:]
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        risk = prior * np.logaddexp(0, -gp).mean() + max(0.0, rest) + pull / 2 * (theta[:-1] ** 2).sum()
        if risk < least:
            least, kept = risk, theta
        d = np.zeros(len(g))
        d[:n_pos] = -prior / n_pos * sigmoid(-gp)
        if rest >= 0:
            d[:n_pos] -= prior / n_pos * sigmoid(gp)
            d[n_pos:] = sigmoid(gu) / len(gu)
        d *= 1 - (g / BOUND) ** 2
        grad = np.bincount(flat.ravel(), np.repeat(d, flat.shape[1]), size + 1)
        grad[-1] = d.sum()
        grad[:-1] += pull * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        rate = RATE * (1 - (t - 1) / STEPS)
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(edges, kept[:-1].reshape(-1, BINS), float(kept[-1]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _drawn(key: Column, salt: str, share: float) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model | None:
    """Fit on rows that are not held out."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n, good = usable.agg(F.count(F.lit(1)), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    total = docs.count()
    if not good or not total:
        return None
    trusted = usable.filter("quality = 1").filter(_drawn(F.col("doc_id"), "p", positives / good)).select(F.col("doc_id").alias("_id")).distinct()
    # about ``positives`` ids: bounded whatever the corpus holds
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("_id").isNotNull().alias("trusted"),
        (_drawn(F.col("doc_id"), "u", unlabelled / total) & ~held_out(F.col("doc_id"))).alias("drawn"),
    ).filter("trusted or drawn")

    def run(batches):
        for batch in batches:
            made = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("trusted"), batch.column("drawn")], names=["x", "trusted", "drawn"])

    sample = rows.mapInArrow(run, "x binary, trusted boolean, drawn boolean").toArrow()
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    # the order of arriving rows must not matter for the sums
    order = np.lexsort(x.T)
    x, is_p, is_u = x[order], np.array(sample.column("trusted"))[order], np.array(sample.column("drawn"))[order]
    return fit(x[is_p], x[is_u], good / n if prior is None else prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and ``_score``."""
    if model is None:
        return docs.withColumn("_score", F.lit(0.5))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([features(t.as_py() or "") for t in batch.column("text")]).astype(np.float64)
            yield batch.append_column("_score", pa.array(model.score(x)))

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, _score double")
