"""Positions, running totals and exact quantiles without one big partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.functions.text import col, number
from alignframe.operators.skew import lookup
from alignframe.session import cut


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Row number from 0 over the whole table. ``order`` must be unique, or ties fall at random.

    A range sort gives every task one slice, a row id counts inside it, and the sizes of the slices before it are
    added. The sorted rows are checkpointed, because both passes must see the same slices: keep ``df`` narrow and
    join the positions back.
    """
    return number_rows(df.orderBy(*[col(c) for c in order]), name)


def number_rows(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a sorted table with their numbers from 0."""
    ranked = cut(ordered.withColumn("_id", F.monotonically_increasing_id()))
    # The id holds the slice number above bit 33 and the row number inside the slice below it.
    ranked = ranked.withColumn("_slice", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort task, so at most spark.sql.shuffle.partitions rows.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return ranked.join(F.broadcast(starts), "_slice").select(
        *ordered.columns, (F.col("_start") + F.col("_row")).alias(name)
    )


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 4096, levels: int = 2) -> DataFrame:
    """Running sum along a column of whole numbers from 0 with one row per value.

    Rows are summed inside blocks of ``width`` values, block totals inside blocks of blocks, and so on for ``levels``;
    only the totals of the last level meet in one task, one for ``width`` ** ``levels`` values.
    """
    blocked = df.withColumn("_block", F.expr(f"{order} div {width}"))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    if levels > 1:
        upto = running_total(totals.withColumnRenamed("_block", "_at"), "_at", "_total", "_upto", width, levels - 1)
        before = upto.select(F.col("_at").alias("_block"), (F.col("_upto") - F.col("_total")).alias("_before"))
    else:
        earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(before, "_block")
        .select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
    )


# Leading bits of a number's fraction that the first digit holds beside sign and exponent, and bits of each later digit.
_LEAD_BITS = 4
_DIGIT_BITS = 16
_FRACTION_BITS = 52
_EXPONENT_SHIFT = 1100


def _digits(v: Column) -> list[Column]:
    """A double as whole numbers whose order, the first deciding first, is the order of doubles."""
    size = F.abs(v)
    # The logarithm may be off by one next to a power of two; scaling by such a power is exact.
    near = F.floor(F.log2(size))
    exponent = F.when(size < F.pow(F.lit(2.0), near), near - 1).when(size >= F.pow(F.lit(2.0), near + 1), near + 1).otherwise(near)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << _FRACTION_BITS)).cast("bigint")
    lead = _FRACTION_BITS - _LEAD_BITS
    whole = (exponent + _EXPONENT_SHIFT) * (1 << _LEAD_BITS) + F.shiftright(fraction, lead)
    infinite = size == float("inf")
    first = F.when(infinite, F.lit(1 << 17)).otherwise(whole)
    out = [F.when(v > 0, first).when(v < 0, -first).otherwise(F.lit(0)).cast("bigint")]
    mask = (1 << _DIGIT_BITS) - 1
    for shift in range(lead - _DIGIT_BITS, -1, -_DIGIT_BITS):
        digit = F.shiftright(fraction, shift).bitwiseAND(F.lit(mask).cast("bigint"))
        out.append(F.when(infinite | (v == 0), F.lit(0)).when(v < 0, F.lit(mask) - digit).otherwise(digit).cast("bigint"))
    return out


def group_quantile(df: DataFrame, group: str, value: str, q: float, name: str, rows: str = "_rows") -> DataFrame:
    """Exact interpolated quantile per group, for groups of any size, and the number of values it is taken over (``rows``).

    Radix selection: values are counted by their first digit (map-side combine), a group's running counts tell the digits of
    its two wanted ranks, and only values with these digits are read again and counted by the next one. Once every group
    has no more of them left than a digit has values, these values are the last digit. So a task orders at most so many rows per
    group, whatever the values are. What a round finds, one row per group, is checkpointed.
    """
    digits = [f"_d{i}" for i in range(1 + (_FRACTION_BITS - _LEAD_BITS) // _DIGIT_BITS)]
    ends, ranks = ("low", "high"), ["_low_rank", "_high_rank"]
    values = df.select(group, number(value).alias("_v")).where(F.col("_v").isNotNull())
    left = values.select(group, "_v", *[d.alias(n) for n, d in zip(digits, _digits(F.col("_v")), strict=True)])
    left = left.withColumns({"_in_low": F.lit(True), "_in_high": F.lit(True)})
    found, digit = None, digits.pop(0)
    while digit is not None:
        known = [] if found is None else [F.first(c).alias(c) for c in (*ranks, "_all", "_part")]
        counts = left.groupBy(group, digit).agg(
            *[F.sum(F.col(f"_in_{end}").cast("bigint")).alias(f"_{end}_n") for end in ends],
            *[F.max(F.when(F.col(f"_in_{end}"), F.col("_v"))).alias(f"_{end}_v") for end in ends],
            *known,
        )
        if found is None:
            rank = (F.col("_all") - 1) * F.lit(float(q))
            counts = counts.withColumn("_all", F.sum("_low_n").over(Window.partitionBy(group))).withColumns(
                {"_low_rank": F.floor(rank), "_high_rank": F.ceil(rank), "_part": rank - F.floor(rank)}
            )
        found = _chosen(counts, group, digit)
        if digit == "_v":
            break
        found = cut(found)
        most = found.agg(F.max(F.greatest("_low_left", "_high_left"))).first()[0] or 0
        first = digit
        digit = "_v" if most <= 1 << _DIGIT_BITS or not digits else digits.pop(0)
        kept = lookup(left.drop(*ranks, "_all", "_part"), found, [group], ["_all", "_part", "_low_digit", "_high_digit", *ranks], weight="_all")
        left = kept.withColumns({f"_in_{end}": F.col(f"_in_{end}") & (F.col(first) == F.col(f"_{end}_digit")) for end in ends})
        left = left.where(F.col("_in_low") | F.col("_in_high")).drop("_low_digit", "_high_digit", first)
        if digit != "_v":
            left = cut(left)
    low, high = F.col("_low_value"), F.col("_high_value")
    return found.select(group, F.col("_all").alias(rows), F.when(low == high, low).otherwise(low + (high - low) * F.col("_part")).alias(name))


def _chosen(counts: DataFrame, group: str, digit: str) -> DataFrame:
    """Per group the digits that hold the two ranks, the largest value and the number of values there, and the ranks among them."""
    ends = ("low", "high")
    running = Window.partitionBy(group).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({f"_{end}_upto": F.sum(f"_{end}_n").over(running) for end in ends})

    def of(column: str, end: str) -> Column:
        here, before = F.col(f"_{end}_rank"), F.col(f"_{end}_upto") - F.col(f"_{end}_n")
        return F.max(F.when((before <= here) & (here < F.col(f"_{end}_upto")), F.expr(column)))

    return placed.groupBy(group).agg(
        F.max("_all").alias("_all"), F.max("_part").alias("_part"),
        *[of(digit, end).alias(f"_{end}_digit") for end in ends],
        *[of(f"_{end}_v", end).alias(f"_{end}_value") for end in ends],
        *[of(f"_{end}_n", end).alias(f"_{end}_left") for end in ends],
        *[of(f"_{end}_rank - _{end}_upto + _{end}_n", end).alias(f"_{end}_rank") for end in ends],
    )
