"""Lookups that stay balanced when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.session import joined_rows

# At most this many keys count as hot. Every key outside the largest 512 holds under 1/512 of the rows.
HOT_KEYS = 512
# Copies of a small table, so that a key with a third of all rows is shared by this many tasks.
SALTS = 32


def lookup(rows: DataFrame, table: DataFrame, on: list[str], take: list[str],
           weight: str | None = None, hot_keys: int = HOT_KEYS, hot_where: Column | None = None) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per ``on``.

    Rows of the most frequent keys are dealt over ``SALTS`` copies of their table row; all others, and rows with a NULL
    key, shuffle once as they are, the latter spread by the task that produced them. Only 64-bit hashes of the hot keys
    are broadcast, ``hot_keys`` of them at most: where another key shares a hash it is dealt out as well, and the result
    does not depend on the choice. ``weight`` names a column of ``table`` that holds the number of rows per key;
    ``hot_where`` names the hot rows of a table that is ranked already, and must hold for ``hot_keys`` rows at most.
    Without either, no key is singled out, and adaptive execution splits what turns out large.
    """
    for c in on:
        table = table.where(F.col(c).isNotNull())
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    keyed = rows.withColumn("_hash", F.xxhash64(*on))
    # Always 0, but not to the optimizer: both uses of the table read the same columns, so that its shuffle is computed once.
    zero = F.pmod(F.xxhash64(*dict.fromkeys([*on, *take, *([weight] if weight else [])])), F.lit(1)).cast("int")
    copied = table.select(*on, *[F.col(c).alias(f"_v_{c}") for c in take], F.xxhash64(*on).alias("_hash"), zero.alias("_zero"))

    salt, salts = F.lit(0), F.array(F.col("_zero"))
    if weight is not None or hot_where is not None:
        ranked = table.where(hot_where) if hot_where is not None else table.orderBy(F.desc(weight), *on)
        hot = F.broadcast(ranked.limit(hot_keys).select(F.xxhash64(*on).alias("_hash"), (zero == 0).alias("_is_hot")).distinct())
        keyed, copied = keyed.join(hot, "_hash", "left"), copied.join(hot, "_hash", "left")
        salt = F.when(F.col("_is_hot"), F.spark_partition_id() % SALTS).otherwise(0)
        salts = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("_zero"))
    # The task number is the same when a lost task is run again.
    dealt = keyed.select(
        *rows.columns,
        *[F.col(c).alias(f"_k_{c}") for c in on],
        F.when(missing, F.spark_partition_id()).otherwise(salt).alias("_deal"),
    )
    others = copied.select(*[F.col(c).alias(f"_o_{c}") for c in on], *[f"_v_{c}" for c in take], F.explode(salts).alias("_salt"))
    same = [F.col(f"_k_{c}") == F.col(f"_o_{c}") for c in on] + [F.col("_deal") == F.col("_salt")]
    return joined_rows(dealt, others, _all(same), "left").select(*rows.columns, *[F.col(f"_v_{c}").alias(c) for c in take])


def salted_lookup(rows: DataFrame, table: DataFrame, on: list[str], take: list[str], salts: int = SALTS) -> DataFrame:
    """The same left join for a ``table`` that is small next to ``rows``, reading ``rows`` only once.

    Each key of the table is repeated ``salts`` times, and every task deals its rows to one of the copies.
    """
    dealt = rows.withColumn("_salt", F.spark_partition_id() % salts)
    copies = table.select(
        *on, *take, F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt")
    )
    return dealt.join(copies, [*on, "_salt"], "left").select(*rows.columns, *take)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
