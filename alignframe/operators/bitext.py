"""Translation pairs in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.operators.overlap import batch_weighted_bleu
from alignframe.operators.prompts import ENGLISH_TO_GERMAN, GERMAN_TO_ENGLISH, template_column
from alignframe.operators.ranking import with_position

FORWARD, BACKWARD = "forward", "backward"


def bidirectional(df: DataFrame, key: str, src: str = "src", ref: str = "ref",
                  forward: str = ENGLISH_TO_GERMAN, backward: str = GERMAN_TO_ENGLISH) -> DataFrame:
    """Two rows per pair, ``seq`` alternating forward and backward, pairs ordered by the length of ``src``.

    Only key and length are sorted; the texts shuffle once, on the key.
    """
    lengths = df.select(key, F.length(src).alias("_len"))
    places = with_position(lengths, ["_len", key], "_rank").select(key, "_rank")

    def row(step: int, name: str, source: str, target: str, template: str) -> Column:
        return F.struct(
            F.col(key).alias(key),
            F.lit(name).alias("direction"),
            F.col(source).alias("src"),
            F.col(target).alias("ref"),
            template_column(template, {"src": F.col(source), "ref": F.col(target)}).alias("prompt"),
            (F.col("_rank") * 2 + step).alias("seq"),
        )

    return df.select(key, src, ref).join(places, key).select(
        F.inline(F.array(row(0, FORWARD, src, ref, forward), row(1, BACKWARD, ref, src, backward)))
    )


def translation_evaluation(df: DataFrame, key: str, hyp: str, ref: str, batch: str, quality: str,
                           direction: str = "direction") -> DataFrame:
    """``direction, rows, bleu, quality``: corpus BLEU of each batch, weighted by its rows, and mean quality.

    As in corpus scoring, a batch too short for some order of n-grams scores 0.
    """
    bleu = batch_weighted_bleu(df, key, hyp, ref, batch, [direction], effective_order=False)
    means = by_direction(df, {"quality": F.avg(quality)}, direction).select(direction, "quality")
    return bleu.join(means, direction)


def by_direction(df: DataFrame, metrics: dict[str, Column], direction: str = "direction") -> DataFrame:
    """Metrics of each direction over that direction's own rows."""
    return df.groupBy(direction).agg(
        F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in metrics.items()]
    )
