"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their first 4 to 7 letters, in lower case. Spark counts them over the
training rows and keeps those whose share differs between the labels beyond chance. Every training text that names a group is
also written with other terms of the same family in place of it; the model is fitted to the labels while squared
changes of the score between a text and its rewritings are penalised. So a group's name carries no weight of its own
that another's would not carry, and, since names are tied to the neutral term of their family, hardly any.

Null and empty texts get the score of a text without any known feature. Without training rows that score is 0.25.
Repeated rows get equal scores. Scores are rounded to 9 decimals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.labelled import ROWS_PER_LABEL, training_rows

# Families of terms that a swap exchanges; the first of each is its neutral term.
IDENTITY_TERMS = (
    ("person", "man", "woman", "boy", "girl", "transgender", "nonbinary"),
    ("people", "men", "women", "boys", "girls", "immigrants", "refugees", "foreigners", "disabled"),
    ("believer", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics"),
    ("human", "black", "white", "asian", "african", "european", "arab", "latino", "mexican", "jewish", "islamic"),
    ("partner", "gay", "lesbian", "straight", "bisexual", "queer", "homosexual"),
)
FEATURES = 4096
EVIDENCE = 25.0
COUNTERFACTUAL = 4.0
RIDGE = 2e-4
STEPS = 300
SWAPS = 4
PRIOR = 0.25

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in range(4, 8) if len(word) > n)]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def rewritings(words: set[str], families=IDENTITY_TERMS, swaps: int = SWAPS) -> list[set[str]]:
    """The words of the text with one named group exchanged for the family's neutral term and for the next ones."""
    out = []
    for family in families:
        for at, term in enumerate(family):
            if term in words:
                others = [t for t in [family[0], *(family[(at + i) % len(family)] for i in range(1, swaps))] if t != term]
                out += [(words - {term}) | {other} for other in dict.fromkeys(others)]
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = float(np.log(PRIOR / (1 - PRIOR)))

    def score(self, text: str | None) -> float:
        known = self.weights
        found = {f for w in words_of(text) for f in features_of(w) if f in known}
        z = self.bias + sum(known[f] for f in sorted(found))
        return round(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))), 9)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, y in zip(batch["text"], batch["y"], strict=True):
            seen[int(y)].update(text_features(words_of(text)))
        names = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"feature": names, "clean": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]})


def select_features(sample: DataFrame, clean: int, toxic: int, most: int, evidence: float) -> list[str]:
    """The features with the largest log-likelihood ratio between the two labels, ``most`` at most."""
    counted = sample.mapInPandas(_counts, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")
    )
    n = clean + toxic

    def term(observed: Column, row: Column, column: int) -> Column:
        return F.when(observed > 0, observed * F.ln(observed * n / (row * column))).otherwise(0.0)

    present, absent = F.col("c") + F.col("t"), n - F.col("c") - F.col("t")
    ratio = 2 * (
        term(F.col("c"), present, clean) + term(F.col("t"), present, toxic)
        + term(clean - F.col("c"), absent, clean) + term(toxic - F.col("t"), absent, toxic)
    )
    strong = counted.withColumn("ratio", ratio).where(F.col("ratio") >= evidence)
    return [r["feature"] for r in strong.orderBy(F.desc("ratio"), "feature").limit(most).select("feature").collect()]


def _encode(index: dict[str, int], families, swaps: int):
    """Per text the numbers of its features, and those of its rewritings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda words: np.array(sorted({index[f] for f in text_features(words) if f in index}), dtype="<i4")
        for batch in batches:
            rows = []
            for doc_id, text, y in zip(batch["doc_id"], batch["text"], batch["y"], strict=True):
                words = words_of(text)
                swapped = [known(w).tobytes() for w in rewritings(words, families, swaps)]
                rows.append((doc_id, int(y), known(words).tobytes(), swapped))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "ids", "swapped"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL, key: str = "doc_id", text: str = "text",
        families=IDENTITY_TERMS, features: int = FEATURES, evidence: float = EVIDENCE,
        counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on at most ``rows`` labelled documents per label; the driver gets their feature numbers, a bounded table."""
    sample, stands_for = training_rows(docs, labels, "toxic", rows, key, text)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = (sum(n for y, n in sizes.items() if y) + 1) / (sum(sizes.values()) + 1 / PRIOR)
        return Model(bias=float(np.log(share / (1 - share))))
    names = select_features(sample, sizes[0], sizes[1], features, evidence)
    names += [t for family in families for t in family if t not in set(names)]
    index = {name: i for i, name in enumerate(names)}
    coded = sample.mapInPandas(_encode(index, families, SWAPS), "doc_id bigint, y int, ids binary, swapped array<binary>")
    table = coded.toPandas().sort_values(["doc_id", "ids"], kind="stable")
    texts = [np.frombuffer(b, dtype="<i4") for b in table["ids"]]
    weight = np.array([stands_for[y] for y in table["y"]])
    pairs = [
        (own, np.frombuffer(b, dtype="<i4")) for own, swapped in zip(texts, table["swapped"], strict=True) for b in swapped
    ]
    w, bias = _descend(texts, table["y"].to_numpy(dtype=float), weight / weight.sum(), pairs, len(names), counterfactual)
    return Model({name: float(w[i]) for name, i in index.items() if w[i]}, float(bias))


class _Rows:
    """A 0/1 matrix by its rows' column numbers."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.columns = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.height, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.columns], minlength=self.height)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.of], minlength=self.width)


def _descend(texts, y, weight, pairs, width, counterfactual):
    """Adam on weighted logistic loss + ridge + counterfactual penalty, all rows at every step: no randomness."""
    x = _Rows(texts, width)
    own, other = _Rows([p[0] for p in pairs], width), _Rows([p[1] for p in pairs], width)
    w, bias = np.zeros(width), float(np.log(max(weight[y == 1].sum(), 1e-6) / max(weight[y == 0].sum(), 1e-6)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        error = (1 / (1 + np.exp(-np.clip(x.times(w) + bias, -60, 60))) - y) * weight
        grad, grad_bias = x.back(error) + RIDGE * w, error.sum()
        if pairs:
            change = (own.times(w) - other.times(w)) * (2 * counterfactual / len(pairs))
            grad += own.back(change) - other.back(change)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        rate = 0.1 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return w, bias


def score(text: Column, model: Model) -> Column:
    """The score of a whole text, 0 to 1."""

    class Weights(dict):
        """Weighted features of each word, remembered for the frequent ones."""

        def __missing__(self, word: str) -> tuple:
            found = tuple(f for f in features_of(word) if f in model.weights)
            if len(self) < 200_000:
                self[word] = found
            return found

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered = Weights()
        for batch in texts:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                found = {f for fs in map(remembered.__getitem__, words_of(t)) if fs for f in fs}
                out[i] = model.bias + sum(model.weights[f] for f in sorted(found))
            yield pd.Series(np.round(1 / (1 + np.exp(-np.clip(out, -60, 60))), 9))

    return of(text)
