"""Quality by a Bradley-Terry ranking.

A document's score is a linear function of shape features of its text: shares of kinds of characters, lengths and repetition of
words and lines. It is learned from preference pairs, a document of label 1 over one of label 0: the logistic loss of the
difference of their features. All labelled documents that are not held out take part: Spark deals them into blocks, and in
a block every document of label 1 is preferred to every one of label 0. The threshold is the quantile of the training scores below which the share of label 0
lies; scores are mapped to 0..1 so that the threshold becomes ``THRESHOLD``.

Null and empty texts have features of their own (no character, no word) and a defined score. Without pairs every text scores
``NO_EVIDENCE``. Repeated rows get equal scores. Scores are rounded to 9 decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from alignframe.llm.common import small_batches, stored
from alignframe.llm.labelled import training_values
from alignframe.operators.ranking import group_quantile

THRESHOLD = 0.3
NO_EVIDENCE = 0.5
# Rows of a block, and the least of a label that a block is meant to have.
BLOCK_ROWS = 128
LEAST_ROWS = 16
# Tasks that a step of the fit has for every core.
TASKS_PER_CORE = 4
STEPS = 30
TOLERANCE = 1e-6
RIDGE = 1e-3

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "#$%&*@^~|<>=+_\\/{}[]`"]] = True
_HINGES = (0.02, 0.05, 0.1, 0.2, 0.4)


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    words = raw.split()
    lines = raw.split(b"\n")
    w = max(len(words), 1)
    shares = [
        counts[_MARKS].sum() / n,
        upper / max(upper + lower, 1),
        counts[48:58].sum() / n,
        counts[33] / n,
        sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / len(lines),
        (counts[:32].sum() - counts[9:14].sum()) / n,
    ]
    hinges = [max(s - h, 0.0) for s in shares for h in _HINGES]
    return [
        *shares,
        *hinges,
        *(min(s / 0.05, 1.0) for s in shares),
        counts[[44, 46]].sum() / n,
        (len(raw) - counts[9:14].sum() - counts[32]) / w / 10,
        np.log1p(len(set(words))) / np.log1p(w) if words else 0.0,
        float(not words),
        min(len(words), 50) / 50,
    ]


@dataclass
class Model:
    weights: np.ndarray | None = None
    offset: float = 0.0
    scale: float = 1.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), NO_EVIDENCE)
        strength = (features * self.weights).sum(axis=1)
        z = (strength - self.offset) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 9)


def _matrix(texts) -> np.ndarray:
    return np.array([text_features(t) for t in texts]).reshape(len(texts), -1)


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """The features of texts as little-endian doubles."""
    return pd.Series([row.astype("<f8").tobytes() for row in _matrix(texts.tolist())], dtype=object)


def _unpacked(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def _task_sums(rows: DataFrame, summed: Callable[[Iterator[pd.DataFrame]], Iterator[list]]) -> list[np.ndarray]:
    """What ``summed`` makes of the rows of each task, one vector per task that has any.

    The driver gets them as packed bytes from a single stage. Tasks take several files each, so that vectors grow in number
    with the cores and not with the table; batches stream through a task, whatever it reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sums in summed(batches):
            yield pd.DataFrame({"sums": [np.concatenate([np.ravel(x) for x in sums]).astype("<f8").tobytes()]})

    few = rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInPandas(run, "sums binary").toArrow()
    return [np.frombuffer(x, dtype="<f8") for x in parts.column("sums").to_pylist()]


def _together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows per label, means and summed squares about them of several parts as those of all their rows."""
    counts, means, squares = (np.array(x) for x in zip(*parts, strict=True))
    n = counts.sum(axis=1)[:, None]
    mean = (n * means).sum(axis=0) / n.sum()
    return counts.sum(axis=0), mean, (squares + n * (means - mean) ** 2).sum(axis=0)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    so_far = []
    for batch in batches:
        if len(batch):
            x = _unpacked(batch["value"])
            mean, counts = x.mean(axis=0), np.bincount(batch["y"], minlength=2)
            so_far = [_together([*so_far, (counts, mean, ((x - mean) ** 2).sum(axis=0))])]
    yield from so_far


def _counts_and_deviations(rows: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """How many training rows each label has, and the standard deviation of every feature."""
    parts = [(x[:2], *np.split(x[2:], 2)) for x in _task_sums(rows.select("y", "value"), _moments)]
    if not parts:
        return {}, np.zeros(0)
    counts, _, squares = _together(parts)
    return {y: int(n) for y, n in enumerate(counts) if n}, np.sqrt(squares / counts.sum())


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``good, bad``: every training row in a block of some ``BLOCK_ROWS``, in which each good row is preferred to each bad one.

    Rows are dealt by the hash of their id. Where a label is rare its rows go to as many blocks as it takes to give
    each ``LEAST_ROWS`` of them, so that every row of the other label has partners; the copies are few next to all rows.
    """
    blocks = -(-sum(counts.values()) // BLOCK_ROWS)
    copies = {y: min(blocks, -(-LEAST_ROWS * blocks // n)) for y, n in counts.items()}
    first = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    last = first + F.when(F.col("y") == 1, copies[1] - 1).otherwise(copies[0] - 1)
    dealt = rows.select("y", "value", F.explode(F.sequence(first, last)).alias("_at")).withColumn("_at", F.col("_at") % blocks)
    of = lambda y: F.sort_array(F.collect_list(F.when(F.col("y") == y, F.col("value"))))
    return stored(dealt.groupBy("_at").agg(of(1).alias("good"), of(0).alias("bad")).drop("_at"), "blocks")


def _slopes(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Number of pairs of a good and a bad row, and summed over them the logistic loss of the lead and its two derivatives."""
    lead = np.clip((good @ w)[:, None] - (bad @ w)[None, :], -60, 60)
    lost = 1 / (1 + np.exp(lead))
    bend = lost * (1 - lost)
    grad = bad.T @ lost.sum(axis=0) - good.T @ lost.sum(axis=1)
    cross = good.T @ bend @ bad
    hess = (good.T * bend.sum(axis=1)) @ good + (bad.T * bend.sum(axis=0)) @ bad - cross - cross.T
    return lead.size, float(np.log1p(np.exp(-lead)).sum()), grad, hess


def _summed(blocks: DataFrame, spread: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """``_slopes`` of all blocks; a task sends one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        n, loss, grad, hess = 0, 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            for good, bad in zip(batch["good"], batch["bad"], strict=True):
                if len(good) and len(bad):
                    part = _slopes(_unpacked(good) / spread, _unpacked(bad) / spread, w)
                    n, loss, grad, hess = n + part[0], loss + part[1], grad + part[2], hess + part[3]
        if n:
            yield n, loss, grad, hess

    total = np.sum(_task_sums(blocks, run), axis=0)
    return int(total[0]), float(total[1]), total[2 : 2 + len(w)], total[2 + len(w) :].reshape(len(w), len(w))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on all labelled documents that are not held out. Features stay in the tasks; the driver gets sums and the threshold."""
    rows = training_values(docs, labels, "quality", _packed(F.col(text)), key, text)
    counts, spread = _counts_and_deviations(rows)
    if len(counts) < 2:
        return Model()
    spread = np.where(spread > 0, spread, 1.0)
    small_batches(docs.sparkSession)
    blocks = _blocks(rows, counts)
    w = _minimum(lambda at: _summed(blocks, spread, at), len(spread)) / spread

    @F.pandas_udf("double")
    def strength(values: pd.Series) -> pd.Series:
        return pd.Series((_unpacked(values) * w).sum(axis=1))

    strengths = stored(rows.select(F.lit(0).alias("all"), strength("value").alias("strength")), "strengths")
    # Halfway between the two strengths that part the share of label 0 from the rest.
    share = (counts[0] - 0.5) / (sum(counts.values()) - 1)
    offset = group_quantile(strengths, "all", "strength", share, "offset").first()["offset"]
    away = strengths.agg(F.avg(F.abs(F.col("strength") - offset))).first()[0]
    return Model(w, float(offset), float(max(away / 4, 1e-6)))


def _minimum(slopes: Callable[[np.ndarray], tuple], width: int) -> np.ndarray:
    """Where the mean loss of all pairs plus the ridge is least, by Newton steps, halved while they would raise it."""

    def at(w: np.ndarray):
        n, loss, grad, hess = slopes(w)
        return loss / n + RIDGE / 2 * (w @ w), grad / n + RIDGE * w, hess / n + RIDGE * np.eye(width)

    w = np.zeros(width)
    loss, grad, hess = at(w)
    for _ in range(STEPS):
        step = np.linalg.solve(hess, grad)
        found = at(w - step)
        while found[0] > loss and np.abs(step).max() > TOLERANCE:
            step = step / 2
            found = at(w - step)
        if found[0] > loss:
            break
        w, (loss, grad, hess) = w - step, found
        if np.abs(step).max() <= TOLERANCE:
            break
    return w


def _descend(difference: np.ndarray) -> np.ndarray:
    """The weights for pairs that are given by the difference of their features."""
    return _minimum(lambda w: _slopes(difference, np.zeros((1, difference.shape[1])), w), difference.shape[1])


def score(text: Column, model: Model) -> Column:
    """The score of a whole text, 0 to 1; ``THRESHOLD`` and more is good."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_matrix(texts.tolist())) if len(texts) else np.zeros(0))

    return of(text)
