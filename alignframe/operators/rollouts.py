"""Rewards and group-relative advantages of sampled completions.

One rule for missing rewards: NaN and NULL both mean that the reward does not apply to the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.functions.text import number
from alignframe.operators.ranking import running_total
from alignframe.operators.skew import lookup

STD_EPSILON = 1e-4
ZERO_STD = 1e-8


def dedupe_references(df: DataFrame, prompt: str, ref: str, order: str) -> DataFrame:
    """One reference per prompt: the last by ``order``."""
    return df.groupBy(prompt).agg(F.max_by(ref, order).alias(ref))


def drop_consecutive(df: DataFrame, group: list[str], column: str, order: str, block: Column) -> DataFrame:
    """Collapse runs of equal values along ``order`` inside each group.

    ``block``, a whole number, cuts a group into pieces that follow ``order``, so that a group of any size is handled in
    pieces. A row that opens a piece looks at the last row of the piece before it.
    """
    pieced = df.withColumn("_block", block)
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    marked = pieced.withColumns(
        {"_previous": F.lag(F.struct(column)).over(inside), "_nth": F.row_number().over(inside)}
    )
    ends = pieced.groupBy(*group, "_block").agg(F.max_by(F.struct(column), order).alias("_end"))
    before = _previous_end(ends, group)
    joined = marked.join(before, [*group, "_block"], "left")
    previous = F.when(F.col("_nth") == 1, F.col("_end")).otherwise(F.col("_previous"))
    return joined.where(previous.isNull() | ~previous[column].eqNullSafe(F.col(column))).select(*df.columns)


_PIECES = 4096


def _previous_end(ends: DataFrame, group: list[str]) -> DataFrame:
    """``_end`` of the piece before each piece. Pieces are chained inside stretches of ``_PIECES`` numbers; only one row per
    stretch is chained over a whole group."""
    placed = ends.withColumn("_stretch", F.floor(F.col("_block") / _PIECES))
    chain = Window.partitionBy(*group, "_stretch").orderBy("_block")
    inside = placed.withColumns({"_before": F.lag("_end").over(chain), "_nth_piece": F.row_number().over(chain)})
    lasts = placed.groupBy(*group, "_stretch").agg(F.max_by("_end", "_block").alias("_last"))
    over_group = Window.partitionBy(*group).orderBy("_stretch")
    earlier = lasts.select(*group, "_stretch", F.lag("_last").over(over_group).alias("_last"))
    joined = inside.join(earlier, [*group, "_stretch"])
    return joined.select(*group, "_block", F.when(F.col("_nth_piece") == 1, F.col("_last")).otherwise(F.col("_before")).alias("_end"))


def attach_references(rollouts: DataFrame, refs: DataFrame, prompt: str, ref: str) -> DataFrame:
    """The reference of its prompt on every rollout; ``refs`` has one row per prompt."""
    return lookup(rollouts, refs, [prompt], [ref])


def unmatched_references(attached: DataFrame, ref: str) -> DataFrame:
    """How many rollouts lack a reference; a caller that needs all of them stops on a count above 0."""
    return attached.agg(
        F.count(F.lit(1)).alias("rollouts"), F.count_if(F.col(ref).isNull()).alias("unmatched")
    )


def first_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """One row per group, the first by ``order``; an aggregate, so groups may be of any size."""
    others = [c for c in df.columns if c != group]
    firsts = df.groupBy(group).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return firsts.select(group, *[F.col("_first")[c].alias(c) for c in others]).select(*df.columns)


def combine_rewards(df: DataFrame, weights: dict[str, float], out: str = "reward") -> DataFrame:
    """Weighted sum over the rewards that apply; 0 when none does."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(number(c), F.lit(0.0)) * w
    return df.withColumn(out, total)


def group_advantages(df: DataFrame, group: str, reward: str, scale: bool = True) -> DataFrame:
    """Adds ``group_mean, group_std, advantage, zero_std``.

    Group statistics are an aggregate with map-side combine, looked up per row; a window would gather a group in one
    task. A group of one has no spread: its advantage is 0. A row without reward has no advantage and does not count in
    its group's statistics.
    """
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(number(reward)).alias("group_mean"),
        F.coalesce(F.stddev_samp(number(reward)), F.lit(0.0)).alias("group_std"),
    )
    rows = lookup(df, stats, [group], ["group_mean", "group_std"], weight="_n")
    distance = number(reward) - F.col("group_mean")
    advantage = distance / (F.col("group_std") + STD_EPSILON) if scale else distance
    return rows.withColumns({"advantage": advantage, "zero_std": F.abs("group_std") <= ZERO_STD})


def reward_report(df: DataFrame, group: str, reward: str, rewards: list[str]) -> DataFrame:
    """``metric, value``: per reward mean and spread; mean reward and group spread; share of groups without spread."""
    parts = {}
    for c in rewards:
        parts[f"rewards/{c}/mean"] = F.avg(number(c))
        parts[f"rewards/{c}/std"] = F.stddev_samp(number(c))
    rows = df.agg(*[e.alias(n) for n, e in parts.items()])

    spread = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(number(reward)).alias("total"),
        F.coalesce(F.stddev_samp(number(reward)), F.lit(0.0)).alias("std"),
    )
    # Every rollout carries its group's statistics, so groups weigh by their size; the share counts groups.
    groups = spread.agg(
        (F.sum("total") / F.sum("n")).alias("reward"),
        (F.sum(F.col("std") * F.col("n")) / F.sum("n")).alias("reward_std"),
        F.avg((F.col("std") <= ZERO_STD).cast("double")).alias("frac_reward_zero_std"),
    )
    return _metric_lines(rows).unionByName(_metric_lines(groups))


def _metric_lines(df: DataFrame) -> DataFrame:
    return df.unpivot([], [f"`{c}`" for c in df.columns], "metric", "value")


def completion_mask(df: DataFrame, ids: str, eos_id: int, mask_truncated: bool = False) -> DataFrame:
    """Adds ``kept_ids`` (up to and including the first end mark), ``length``, ``terminated`` and ``mask_sum``.

    With ``mask_truncated`` rows without an end mark get an all-zero mask; their length stays.
    """
    at = F.array_position(ids, F.lit(eos_id).cast("bigint"))
    ended = at > 0
    size = F.when(ended, at).otherwise(F.size(ids)).cast("bigint")
    kept = F.when(ended, F.slice(F.col(ids), F.lit(1), at.cast("int"))).otherwise(F.col(ids))
    counted = F.when(ended | F.lit(not mask_truncated), size).otherwise(F.lit(0).cast("bigint"))
    return df.withColumns({"kept_ids": kept, "length": size, "terminated": ended, "mask_sum": counted})


def completion_report(df: DataFrame, length: str = "length", terminated: str = "terminated") -> DataFrame:
    """Lengths of all completions and of those that ended; 0 where none did."""
    ended = F.when(F.col(terminated), F.col(length))
    zero = F.lit(0).cast("bigint")
    return df.agg(
        F.avg(length).alias("mean_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        (1 - F.count_if(F.col(terminated)) / F.count(F.lit(1))).alias("clipped_ratio"),
        F.coalesce(F.avg(ended), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(ended), zero).alias("min_terminated_length"),
        F.coalesce(F.max(ended), zero).alias("max_terminated_length"),
    )


def minmax_scale(df: DataFrame, column: str, group: str | None = None, out: str = "scaled") -> DataFrame:
    """Rescale to 0..1 over the table or over each group; a constant column becomes 0, a missing value stays missing."""
    value = number(column)
    ends = [F.min(value).alias("_low"), F.max(value).alias("_high")]
    if group is None:
        span = df.agg(F.struct(*ends).alias("_span"))
        rows = df.withColumn("_span", span.scalar()).withColumns(
            {"_low": F.col("_span._low"), "_high": F.col("_span._high")}
        )
    else:
        spans = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *ends)
        rows = lookup(df, spans, [group], ["_low", "_high"], weight="_n")
    scaled = F.when(value.isNull(), F.lit(None).cast("double")).when(F.col("_low") == F.col("_high"), F.lit(0.0)).otherwise(
        (value - F.col("_low")) / (F.col("_high") - F.col("_low"))
    )
    return rows.withColumn(out, scaled).select(*df.columns, out)


def tokens_seen(df: DataFrame, step: str, tokens: str) -> DataFrame:
    """``step, tokens, num_tokens``: tokens of each step and all tokens so far."""
    steps = df.groupBy(F.col(step).alias("step")).agg(F.sum(tokens).alias("tokens"))
    return running_total(steps, "step", "tokens", "num_tokens")


@dataclass(frozen=True)
class RewardSpec:
    """A named reward: a function from a table to a column of it. An Arrow ``pandas_udf`` call is a column too."""

    name: str
    fn: Callable[[DataFrame], Column]
    weight: float = 1.0


def apply_rewards(df: DataFrame, specs: list[RewardSpec], out: str = "reward") -> DataFrame:
    """One column per reward, and their weighted sum."""
    scored = df.withColumns({s.name: s.fn(df) for s in specs})
    return combine_rewards(scored, {s.name: s.weight for s in specs}, out)
