"""BLEU over tables of token arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from alignframe.functions import bleu
from alignframe.session import reachable, spread

_ORDERS = range(1, bleu.MAX_ORDER + 1)
_COUNTS = ["hyp_len", "ref_len", *[f"match_{n}" for n in _ORDERS], *[f"total_{n}" for n in _ORDERS]]
# Tokens whose n-grams are numbered at a time; one longer pair is numbered alone.
_TOKENS = 1 << 20


def _matches(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """Lengths and clipped matches of each order, a line per pair of token arrays.

    An n-gram is numbered by the number of its beginning and its last token, so equal numbers mean equal tokens of one
    pair. Only what the sides share goes on to the next order: nothing longer can match elsewhere.
    """
    pairs = len(hyp)
    sizes = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (hyp, ref)]
    tokens = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode(null_encoding="encode")
    token, radix = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(tokens.dictionary)
    both = np.concatenate(sizes)
    pair = np.repeat(np.concatenate([np.arange(pairs), np.arange(pairs)]), both)
    end = np.repeat(np.cumsum(both), both)
    of_hyp = np.arange(len(token)) < sizes[0].sum()

    out = np.zeros((pairs, 2 + bleu.MAX_ORDER), np.int64)
    out[:, 0], out[:, 1] = sizes
    start, beginning = np.arange(len(token)), pair
    for n in _ORDERS:
        _, first, number = np.unique(beginning * radix + token[start + n - 1], return_index=True, return_inverse=True)
        uses = [np.bincount(number[of_hyp[start] == side], minlength=len(first)) for side in (True, False)]
        shared = np.minimum(*uses)
        out[:, 1 + n] = np.bincount(pair[start[first]], weights=shared, minlength=pairs)
        goes_on = (shared[number] > 0) & (start + n < end[start])
        start, beginning = start[goes_on], number[goes_on]
    return out


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows that weigh ``most`` together, a heavier row alone."""
    a, total = 0, 0
    for i, w in enumerate(weights.tolist()):
        if total and total + w > most:
            yield a, i
            a, total = i, 0
        total += w
    if a < len(weights):
        yield a, len(weights)


@F.arrow_udf(ArrayType(LongType()))
def _pair_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    weights = sum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (hyp, ref))
    width = 2 + bleu.MAX_ORDER
    counted = [_matches(hyp.slice(a, b - a), ref.slice(a, b - a)) for a, b in _slices(weights, _TOKENS)]
    flat = np.concatenate(counted).ravel() if counted else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))


def ngram_counts(df: DataFrame, key: str, hyp: str, ref: str, keep: list[str] | None = None) -> DataFrame:
    """Lengths, clipped matches and totals per row; ``key`` is unique, ``keep`` names further columns of the row.

    The token arrays shuffle once, on the key, so that the work is even. N-grams never leave their row: both sides are
    numbered and counted side by side, in memory of a few numbers a token. A NULL array counts as empty, a NULL token as
    a token of its own.
    """
    reachable(df.sparkSession)
    keys = [key, *(keep or [])]
    counted = spread(df.select(*keys, hyp, ref), key).select(*keys, _pair_counts(F.col(hyp), F.col(ref)).alias("_ngram_counts"))
    rows = counted.select(*keys, *[F.col("_ngram_counts")[i].alias(c) for i, c in enumerate(_COUNTS[: 2 + bleu.MAX_ORDER])])
    return rows.withColumns({f"total_{n}": F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)) for n in _ORDERS})


def _score(effective_order: bool = True) -> Column:
    return bleu.score(
        F.col("hyp_len"),
        F.col("ref_len"),
        [F.col(f"match_{n}") for n in _ORDERS],
        [F.col(f"total_{n}") for n in _ORDERS],
        effective_order,
    )


def sentence_bleu(df: DataFrame, key: str, hyp: str, ref: str, keep: list[str] | None = None,
                  out: str = "bleu") -> DataFrame:
    """``key``, the kept columns and the BLEU of every row."""
    counted = ngram_counts(df, key, hyp, ref, keep)
    return counted.select(key, *(keep or []), _score().alias(out))


def corpus_bleu(df: DataFrame, key: str, hyp: str, ref: str, group: list[str], effective_order: bool = True,
                out: str = "bleu") -> DataFrame:
    """BLEU per group: counts of rows are summed (map-side first), then combined once."""
    sums = (
        ngram_counts(df, key, hyp, ref, group)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in _COUNTS])
    )
    return sums.select(*group, "rows", _score(effective_order).alias(out))


def batch_weighted_bleu(df: DataFrame, key: str, hyp: str, ref: str, batch: str, group: list[str] | None = None,
                        effective_order: bool = True, out: str = "bleu") -> DataFrame:
    """Corpus BLEU of each batch, averaged with the rows as weights."""
    group = group or []
    scored = corpus_bleu(df, key, hyp, ref, [*group, batch], effective_order, "_bleu")
    weighted = F.sum(F.col("_bleu") * F.col("rows")) / F.sum("rows")
    return scored.groupBy(*group).agg(F.sum("rows").alias("rows"), weighted.alias(out))


def blend_scores(df: DataFrame, columns: list[str], weights: list[float] | None = None,
                 out: str = "score") -> DataFrame:
    """Weighted sum of score columns; equal weights by default."""
    weights = weights or [1.0 / len(columns)] * len(columns)
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + F.col(c) * w
    return df.withColumn(out, total)
