"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features describe it and its two neighbours; a transition weight ties adjacent labels.
Forward-backward gives each line's probability of being good, and their mean, weighted by length, is the document's.
Training lines take their document's label; a logistic curve fitted on the training documents turns the mean into the
probability of label 1. Documents of a batch are scored together, line by line, so memory is bounded by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidily

#: Bound of the training sample: labelled documents.
TRAIN_DOCS = 3000
#: Documents of more lines are fitted in stretches of so many; all their lines count.
STRETCH = 64
FOLDS = 5
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
LOWER_ETC = bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
COMMON = b" ,.;:'\"()?-\t\r"
SYMBOLS = bytes(set(range(33, 127)) - set(UPPER) - set(LOWER_ETC) - set(DIGITS) - set(COMMON))
N_LINE = 14
NEIGHBOUR = (1, 2, 4, 6, 7, 9, 13)  # of a line's features, those its neighbours see
N_FEATURES = N_LINE + 2 * len(NEIGHBOUR)


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of N_LINE numbers, from 0 to about 1, for each line of a document."""
    seen: set[int] = set()
    out = np.zeros((len(lines), N_LINE))
    for i, line in enumerate(lines):
        n = len(line)
        full = max(n, 1)
        words = line.split()
        upper = (n - len(line.translate(None, UPPER))) / full
        symbols = (n - len(line.translate(None, SYMBOLS))) / full
        digits = (n - len(line.translate(None, DIGITS))) / full
        lower = (n - len(line.translate(None, LOWER_ETC))) / full
        stutter = sum(map(eq, words, words[1:])) / len(words) if words else 0.0
        distinct = len(set(words)) / len(words) if words else 1.0
        key = hash(line) if n > 20 else None
        again = float(key in seen)
        if key is not None:
            seen.add(key)
        out[i] = (
            1.0, upper, symbols, digits, upper > 0.4, lower, symbols > 0.04, 1.0 - distinct if len(words) > 8 else 0.0,
            np.log1p(n) / 8, again, n / (len(words) + 1) / 12, line[-1:] in b".!?" if n else 0.0,
            stutter, stutter > 0.2,
        )
    out[:, 10] = np.minimum(out[:, 10], 3.0)
    return out


def features(lines: np.ndarray) -> np.ndarray:
    """A document's line features with those of the lines before and after."""
    near = lines[:, NEIGHBOUR]
    blank = np.zeros((1, near.shape[1]))
    return np.hstack([lines, np.vstack([blank, near[:-1]]), np.vstack([near[1:], blank])])


def of_text(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a whole text; an empty text is one empty line."""
    lines = text.split(b"\n")
    return features(line_features(lines)), np.array([len(x) + 1 for x in lines], dtype=float)


@dataclass
class Crf:
    """weights: log-odds of good per feature; tie: log weight of equal adjacent labels; curve: slope and offset."""

    weights: np.ndarray
    tie: float
    curve: tuple[float, float] = (8.0, 0.0)


class Batch:
    """Documents side by side: position t of all that have as many lines, longest first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][self.order]
        self.longest = int(self.sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-self.sizes, -np.arange(self.longest), side="left")

    def marginals(self, odds: np.ndarray, tie: float) -> tuple[np.ndarray, float]:
        """P(good) of each line, and the summed P(equal labels) of adjacent lines."""
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        same = 1 / (1 + np.exp(-tie))
        fore, back = np.empty_like(p), np.ones_like(p)
        for t in range(self.longest):
            at = self.starts[: self.alive[t]] + t
            prior = 0.5 if t == 0 else fore[at - 1] * same + (1 - fore[at - 1]) * (1 - same)
            good = prior * p[at]
            fore[at] = good / (good + (1 - prior) * (1 - p[at]))
        later = np.full_like(p, 0.5)  # share of the message for good, normalised
        equal = 0.0
        for t in range(self.longest - 2, -1, -1):
            at = self.starts[: self.alive[t + 1]] + t
            nxt = at + 1
            good, bad = later[nxt] * p[nxt], (1 - later[nxt]) * (1 - p[nxt])
            up, down = same * good + (1 - same) * bad, (1 - same) * good + same * bad
            later[at] = up / (up + down)
            f = fore[at]
            gg, bb = f * same * good, (1 - f) * same * bad
            gb, bg = f * (1 - same) * bad, (1 - f) * (1 - same) * good
            equal += float(((gg + bb) / (gg + bb + gb + bg)).sum())
        good = fore * later
        return good / (good + (1 - fore) * (1 - later)), equal


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 150, rate: float = 0.15, l2: float = 2e-3) -> Crf:
    """Fit on (features, lengths, label) by gradient ascent of the conditional likelihood, each document weighing 1.

    Without both labels there is nothing to tell apart: the model then scores all 0.5.
    """
    labels = np.array([d[2] for d in documents])
    if len(set(labels.tolist())) < 2:
        return Crf(np.zeros(N_FEATURES), 0.0, (0.0, 0.0))
    sizes = np.array([len(d[1]) for d in documents])
    stretches = np.array([min(STRETCH, n - at) for n in sizes.tolist() for at in range(0, n, STRETCH)])
    batch, x = Batch(stretches), np.vstack([d[0] for d in documents])
    y = np.repeat(labels, sizes).astype(float)
    share = np.array([1 / (labels == 1).sum(), 1 / (labels == 0).sum()]) / 2  # both labels weigh the same
    weight = np.repeat(np.where(labels == 1, share[0], share[1]) / sizes, sizes)
    pairs = float((stretches - 1).sum())
    w, tie = np.zeros(N_FEATURES), 0.0
    m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    for step in range(1, steps + 1):
        good, equal = batch.marginals(x @ w, tie)
        up = np.append(x.T @ (weight * (y - good)) - l2 * w, (pairs - equal) / max(pairs, 1) - 0.2 * tie)
        m, v = 0.9 * m + 0.1 * up, 0.99 * v + 0.01 * up**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, tie = w + move[:-1], tie + move[-1]
    model = Crf(w, tie)
    means = document_means(model, documents)
    a, b = 4.0, -2.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * means + b)))
        a, b = a + 2 * (((labels - p) * means).mean() - 1e-4 * a), b + 2 * (labels - p).mean()
    model.curve = (float(a), float(b))
    return model


def document_means(model: Crf, documents: list[tuple]) -> np.ndarray:
    """Length-weighted mean of P(good) over each document's lines."""
    if not documents:
        return np.zeros(0)
    sizes = np.array([len(d[1]) for d in documents])
    odds = np.concatenate([d[0] @ model.weights for d in documents])
    good, _ = Batch(sizes).marginals(odds, model.tie)
    lengths = np.concatenate([d[1] for d in documents])
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    return np.add.reduceat(good * lengths, at) / np.add.reduceat(lengths, at)


def scores(model: Crf, texts: list[bytes], piece: int = 512) -> np.ndarray:
    """Score of each whole text, from 0 to 1."""
    a, b = model.curve
    out = [np.zeros(0)]
    for at in range(0, len(texts), piece):
        some = texts[at : at + piece]
        out.append(1 / (1 + np.exp(-np.clip(a * document_means(model, [of_text(t) for t in some]) + b, -30, 30))))
    return np.concatenate(out)


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Crf:
    """Fit on TRAIN_DOCS labelled documents at most, the first by a hash of their keys, outside the held-out fold.

    Rows without a label or key are left out; of repeated labels of a key the greatest holds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    known = F.broadcast(known.orderBy(F.xxhash64("key"), "key").limit(TRAIN_DOCS))
    body = F.coalesce(F.col(text), F.lit(""))
    chosen = docs.select(F.col(key).alias("key"), body.alias("text")).join(known, "key")
    chosen = chosen.select("key", "label", F.col("text").cast("binary").alias("text"))

    @tidily
    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [of_text(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"].astype(str),
                    "label": batch["label"],
                    "x": [g[0].astype("<f4").tobytes() for g in got],
                    "n": [g[1].astype("<f8").tobytes() for g in got],
                }
            )

    rows = chosen.mapInPandas(prepare, "key string, label int, x binary, n binary").limit(2 * TRAIN_DOCS).collect()
    rows.sort(key=lambda r: (r["key"], bytes(r["x"])))
    return fit(
        [
            (np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(r["n"], "<f8"), r["label"])
            for r in rows
        ]
    )


def score(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1, higher: better), from its whole text alone; every row stays.

    A null text is empty, and an empty text is one empty line. An input column named quality_score is replaced.
    """

    @F.pandas_udf("double")
    @tidily
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(scores(model, list(batch)))

    return docs.withColumn("quality_score", of(F.coalesce(F.col(text), F.lit("")).cast("binary")))
