"""Preparation of a data set by task name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignframe.operators.bitext import bidirectional
from alignframe.operators.dialogue import label_pairs
from alignframe.operators.examples import length_order, split_by_key
from alignframe.operators.equivalence import formula_reward, preference_reward
from alignframe.operators.filters import agreed_safe, length_between, nonempty
from alignframe.operators.overlap import blend_scores, sentence_bleu
from alignframe.operators.prompts import NL_TO_FORMULA, PASSAGE_TO_FORMULA, chat_text, pick_preferred, render_prompt, user_message
from alignframe.operators.rollouts import minmax_scale


def preference_task(df: DataFrame) -> DataFrame:
    """Safe preference pairs as chat prompt and better answer. Narrow: no shuffle."""
    picked = pick_preferred(agreed_safe(df)).withColumn("prompt", chat_text(user_message(F.col("prompt"))))
    return nonempty(picked, "better_answer")


def dialogue_task(df: DataFrame) -> DataFrame:
    """Transcripts as chat prompt and last message; malformed ones are flagged, so that a caller counts what it drops."""
    return label_pairs(df)


def translation_task(df: DataFrame, key: str = "pair_id") -> DataFrame:
    return bidirectional(df, key)


def formula_task(df: DataFrame, key: str = "pair_id", test_fraction: float = 0.2, seed: int = 2) -> DataFrame:
    """Statement and formula pairs with prompts; ``part`` is train or test, shortest formula first."""
    return length_order(_both_parts(render_prompt(df, NL_TO_FORMULA), key, test_fraction, seed), "FOL", key)


def distillation_task(df: DataFrame, key: str = "doc_id", least_chars: int = 200, test_fraction: float = 0.2,
                      seed: int = 0) -> DataFrame:
    """Documents of some length with prompt and formula target; ``part`` is train or test, shortest document first."""
    long = length_between(df, {"document": (least_chars, None)})
    prompts = render_prompt(long, PASSAGE_TO_FORMULA)
    return length_order(_both_parts(prompts, key, test_fraction, seed), "document", key)


def _both_parts(df: DataFrame, key: str, test_fraction: float, seed: int) -> DataFrame:
    train, test = split_by_key(df, key, test_fraction, seed)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


TASKS: dict[str, Callable[..., DataFrame]] = {
    "preference": preference_task,
    "dialogue": dialogue_task,
    "translation": translation_task,
    "formula": formula_task,
    "distillation": distillation_task,
}


def translation_reward(df: DataFrame, key: str = "pair_id", hyp: str = "hyp", ref: str = "ref", quality: str = "quality") -> DataFrame:
    """``key, reward``: the mean of sentence BLEU and a given quality score."""
    scored = sentence_bleu(df, key, hyp, ref, [quality])
    return blend_scores(scored, ["bleu", quality], out="reward").select(key, "reward")


def scored_text_reward(df: DataFrame, score: str = "score", group: str | None = None) -> DataFrame:
    """Adds ``reward``: a given score, scaled to 0..1."""
    return minmax_scale(df, score, group, "reward")


# The reward that belongs to a task.
REWARDS: dict[str, Callable[..., DataFrame]] = {
    "translation": translation_reward,
    "formula": formula_reward,
    "preference": preference_reward,
    "dialogue": scored_text_reward,
}


def task_reward(name: str, df: DataFrame, *tables: DataFrame, **options) -> DataFrame:
    """The task's reward over a table of completions; ``tables`` are those the reward looks up."""
    if name not in REWARDS:
        raise ValueError(f"no reward for task: {name}")
    return REWARDS[name](df, *tables, **options)


def prepare_task(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in TASKS:
        raise ValueError(f"unknown task: {name}")
    return TASKS[name](df, **options)
