"""Token-level diagnostics of a logged policy update.

Input: one row per token with ``seq_id, batch_id, logp, old_logp, ref_logp, entropy, mask, advantage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.operators.ranking import group_quantile
from alignframe.operators.skew import lookup

TOKEN, SEQUENCE = "token", "sequence"


def _masked_mean(x: Column, mask: Column | None = None) -> Column:
    mask = F.col("mask") if mask is None else mask
    return F.sum(x * mask) / F.greatest(F.sum(mask), F.lit(1))


def kl_column() -> Column:
    d = F.col("ref_logp") - F.col("logp")
    return F.exp(d) - d - 1


def token_kl(df: DataFrame, out: str = "kl") -> DataFrame:
    return df.withColumn(out, kl_column())


def mean_kl(df: DataFrame) -> DataFrame:
    """Masked mean divergence per batch."""
    return df.groupBy("batch_id").agg(_masked_mean(kl_column()).alias("kl"))


def _log_ratio() -> Column:
    return F.col("logp") - F.coalesce(F.col("old_logp"), F.col("logp"))


def importance_ratio(df: DataFrame, level: str = TOKEN, eps_low: float = 0.2, eps_high: float = 0.2,
                     delta: float | None = None) -> DataFrame:
    """Adds ``ratio`` and ``clipped_ratio``; ``delta`` caps the unclipped one from above.

    At sequence level all tokens share the ratio of the masked mean log-ratio.
    """
    if level == TOKEN:
        rows = df.withColumn("_log", _log_ratio())
    elif level == SEQUENCE:
        means = df.groupBy("seq_id").agg(
            F.count(F.lit(1)).alias("_n"), _masked_mean(_log_ratio()).alias("_log")
        )
        rows = lookup(df, means, ["seq_id"], ["_log"], weight="_n")
    else:
        raise ValueError(f"unknown importance level: {level}")
    raw = F.exp("_log")
    clipped = F.least(F.greatest(raw, F.lit(1 - eps_low)), F.lit(1 + eps_high))
    capped = raw if delta is None else F.least(raw, F.lit(float(delta)))
    return rows.withColumns({"ratio": capped, "clipped_ratio": clipped}).drop("_log")


def clipped_objective(df: DataFrame, loss_type: str = "grpo", beta: float = 0.0, max_len: int | None = None,
                      entropy_mask: str | None = None, **ratio_options) -> DataFrame:
    """Loss per batch: ``grpo`` averages sequence means, ``bnpo`` all tokens, ``dr_grpo`` divides by a fixed length."""
    rows = importance_ratio(df, **ratio_options)
    loss = -F.least(F.col("ratio") * F.col("advantage"), F.col("clipped_ratio") * F.col("advantage"))
    if entropy_mask is not None:
        loss = loss * F.col(entropy_mask).cast("int")
    if beta != 0.0:
        loss = loss + kl_column() * beta

    sequences = rows.groupBy("batch_id", "seq_id").agg(
        F.sum(loss * F.col("mask")).alias("_loss"), F.sum("mask").alias("_tokens")
    )
    if loss_type == "grpo":
        total = F.avg(F.col("_loss") / F.greatest("_tokens", F.lit(1)))
    elif loss_type == "bnpo":
        total = F.sum("_loss") / F.greatest(F.sum("_tokens"), F.lit(1))
    elif loss_type == "dr_grpo":
        if not max_len:
            raise ValueError("dr_grpo needs max_len")
        total = F.sum("_loss") / (F.count(F.lit(1)) * max_len)
    else:
        raise ValueError(f"unknown loss type: {loss_type}")
    return sequences.groupBy("batch_id").agg(total.alias("loss"))


def high_entropy_mask(df: DataFrame, q: float, out: str = "high_entropy") -> DataFrame:
    """Marks the unmasked tokens at or above the ``1 - q`` quantile of their batch's unmasked entropies."""
    kept = df.where(F.col("mask") == 1)
    cut = group_quantile(kept, "batch_id", "entropy", 1.0 - q, "_cut")
    # The number of values per batch comes with the quantile, so tokens are not counted once more to find hot batches.
    rows = lookup(df, cut, ["batch_id"], ["_cut"], weight="_rows")
    mark = (F.col("mask") == 1) & F.coalesce(F.col("entropy") >= F.col("_cut"), F.lit(False))
    return rows.withColumn(out, mark).drop("_cut")


def mean_entropy(df: DataFrame) -> DataFrame:
    return df.groupBy("batch_id").agg(_masked_mean(F.col("entropy")).alias("entropy"))


def clip_report(df: DataFrame, eps_low: float = 0.2, eps_high: float = 0.2, **ratio_options) -> DataFrame:
    """Share of tokens whose ratio is clipped, per batch and then over batches; one row."""
    rows = importance_ratio(df, eps_low=eps_low, eps_high=eps_high, **ratio_options)
    low = (F.col("ratio") < 1 - eps_low) & (F.col("advantage") < 0)
    high = (F.col("ratio") > 1 + eps_high) & (F.col("advantage") > 0)
    marks = {"low": low.cast("double"), "high": high.cast("double"), "region": (low | high).cast("double")}
    if ratio_options.get("level", TOKEN) == SEQUENCE:
        # One ratio per sequence: the mean is over sequences, whatever their masks.
        flags = rows.groupBy("batch_id", "seq_id").agg(*[F.max(m).alias(n) for n, m in marks.items()])
        batches = flags.groupBy("batch_id").agg(*[F.avg(n).alias(n) for n in marks])
    else:
        batches = rows.groupBy("batch_id").agg(*[_masked_mean(m).alias(n) for n, m in marks.items()])
    return batches.agg(
        F.avg("low").alias("low_mean"),
        F.min("low").alias("low_min"),
        F.avg("high").alias("high_mean"),
        F.max("high").alias("high_max"),
        F.avg("region").alias("region_mean"),
    )


def anchored_objective(df: DataFrame, ref_tokens: DataFrame, num_generations: int, eps_low: float = 0.2,
                       eps_high: float = 0.2, **objective_options) -> DataFrame:
    """``batch_id, loss, loss_corrected``: the clipped objective with a supervised term on the reference answers.

    ``ref_tokens`` has ``batch_id, logp, ref_logp, mask``. The clamp is on the log-ratio itself, as in the metric this
    reproduces, although its bounds are ratio bounds.
    """
    base = clipped_objective(df, eps_low=eps_low, eps_high=eps_high, **objective_options)
    log_ratio = F.col("logp") - F.col("ref_logp")
    clamped = F.least(F.greatest(log_ratio, F.lit(1 - eps_low)), F.lit(1 + eps_high))
    anchor = ref_tokens.groupBy("batch_id").agg(_masked_mean(clamped).alias("_anchor"))
    term = F.coalesce("_anchor", F.lit(0.0))
    return base.join(anchor, "batch_id", "left").select(
        "batch_id",
        (F.col("loss") - term / num_generations).alias("loss"),
        (-term).alias("loss_corrected"),
    )
