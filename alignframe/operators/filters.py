"""Row filters and checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignframe.functions import logic


def agreed_safe(df: DataFrame) -> DataFrame:
    """Rows whose better response is also the safer one and is flagged safe; a missing flag counts as unsafe."""
    flags = F.array("is_response_0_safe", "is_response_1_safe")
    flag = F.get(flags, F.col("better_response_id"))
    return df.where(
        (F.col("better_response_id") == F.col("safer_response_id")) & F.coalesce(flag, F.lit(False))
    )


def label_is(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def length_between(df: DataFrame, bounds: dict[str, tuple[int | None, int | None]],
                   exclude_substrings: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """Keep rows whose texts have lengths within inclusive bounds and hold none of the given phrases."""
    keep = F.lit(True)
    for column, (low, high) in bounds.items():
        if low is not None:
            keep = keep & (F.length(column) >= low)
        if high is not None:
            keep = keep & (F.length(column) <= high)
    for column, phrases in (exclude_substrings or {}).items():
        for phrase in phrases:
            keep = keep & ~F.contains(F.col(column), F.lit(phrase))
    return df.where(keep)


def nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(column) > 0)


def check_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Violations per column: NULL or empty values. One pass, one row."""
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(c)).alias(f"missing_{c}") for c in columns]
    )


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; the job fails on the first row with a missing or empty value."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    message = f"a required value is missing or empty: {', '.join(columns)}"
    return df.where(F.assert_true(ok, message).isNull())


def within_formula_budget(df: DataFrame, column: str, out: str = "in_budget", max_chars: int = logic.MAX_CHARS,
                          max_and: int = logic.MAX_CONJUNCTIONS, max_or: int = logic.MAX_DISJUNCTIONS) -> DataFrame:
    return df.withColumn(out, logic.in_budget(column, max_chars, max_and, max_or))
