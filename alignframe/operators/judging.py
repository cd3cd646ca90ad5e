"""Pairwise judging in both orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.operators.prompts import template_column


# A readable verdict that prefers neither answer by name.
NO_LETTER = ""


def judge_requests(df: DataFrame, template: str, idx: str = "idx", question: str = "question",
                   answer: str = "answer", other: str = "other", system: str | None = None) -> DataFrame:
    """Every question twice, with the answers in both orders; ``target`` is the letter of ``answer``.

    The template may use ``{question} {answer_a} {answer_b}`` or ``{input} {output_1} {output_2}``. With ``system`` a request
    also has ``messages``, the system's and the user's, for judges that take a chat.
    """

    def message(first: str, second: str) -> Column:
        q, a, b = F.col(question), F.col(first), F.col(second)
        return template_column(
            template,
            {"question": q, "answer_a": a, "answer_b": b, "input": q, "output_1": a, "output_2": b},
        )

    orders = F.array(
        F.struct(F.lit("A").alias("target"), message(answer, other).alias("message")),
        F.struct(F.lit("B").alias("target"), message(other, answer).alias("message")),
    )
    requests = df.select(idx, F.inline(orders))
    if system is None:
        return requests
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return requests.withColumn("messages", F.array(said("system", F.lit(system)), said("user", F.col("message"))))


def parse_verdicts(df: DataFrame, raw: str, style: str = "json", out: str = "output") -> DataFrame:
    """Adds the letter a judge gave; NULL where the reply cannot be read.

    ``json`` replies name it in ``better_answer``; one that is null there is a verdict without a letter. ``short`` replies say ``(a)`` or ``(b)``, and ``(c)`` for a tie.
    """
    if style == "json":
        answer = F.try_variant_get(F.try_parse_json(F.col(raw)), "$.better_answer", "variant")
        letter = F.when(F.is_variant_null(answer), F.lit(NO_LETTER)).otherwise(F.try_variant_get(answer, "$", "string"))
    elif style == "short":
        letter = F.nullif(F.upper(F.regexp_extract(raw, r"\(([abc])\)", 1)), F.lit(""))
    else:
        raise ValueError(f"unknown reply style: {style}")
    return df.withColumn(out, letter)


def verdict_points() -> Column:
    """+1 for the model under test, -1 for the other one, 0 for a tie or an unknown letter."""
    return (
        F.when(F.col("output") == F.col("target"), 1).when(F.col("output").isin("A", "B"), -1).otherwise(0)
    )


def net_outcome(net: Column) -> Column:
    return F.when(net > 0, "win").when(net < 0, "lost").otherwise("tie")


def pair_scoreboard(df: DataFrame, idx: str = "idx") -> DataFrame:
    """``idx, net, outcome``. Unreadable replies count as never given; unknown letters leave a question at 0."""
    board = df.where(F.col("output").isNotNull()).groupBy(idx).agg(F.sum(verdict_points()).alias("net"))
    return board.withColumn("outcome", net_outcome(F.col("net")))


def win_rates(scoreboard: DataFrame, dataset: DataFrame, idx: str = "idx", subset: str = "subset") -> DataFrame:
    """Rates over all rows of the dataset; ``invalid`` are rows without any verdict."""
    scored = dataset.select(idx, subset).join(scoreboard.select(idx, "outcome"), idx, "left")
    of = lambda o: F.count_if(F.coalesce(F.col("outcome") == o, F.lit(False)))
    counts = scored.groupBy(subset).agg(
        of("win").alias("wins"), of("lost").alias("losses"), of("tie").alias("ties"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.select(
        subset,
        *[
            (F.col(c).cast("double") / F.col("total")).alias(o)
            for o, c in (("win", "wins"), ("lost", "losses"), ("tie", "ties"))
        ],
        "total",
        (F.col("total") - F.col("wins") - F.col("losses") - F.col("ties")).alias("invalid"),
    )
