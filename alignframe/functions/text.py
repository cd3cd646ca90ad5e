"""Text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules by which translation metrics set punctuation apart.
PUNCTUATION = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)

# All white space a dialogue parser would trim, not only the blank that Spark's trim() knows.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _EDGES, "")


def words(c: Column | str) -> Column:
    """White-space tokens, no empty ones."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != F.lit(""))


def translation_tokens(c: Column | str) -> Column:
    """White-space tokens after punctuation is set apart, but for points and commas inside numbers."""
    apart = col(c)
    for pattern, put in PUNCTUATION:
        apart = F.regexp_replace(apart, pattern, put)
    return words(apart)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value.

    A lambda variable is computed once per row. A projected column that is read inside another lambda may be
    inlined by the optimizer and then be recomputed for every element.
    """
    return F.transform(F.array(value), body)[0]


def hash_bucket(key: Column | str, seed: int, buckets: int) -> Column:
    """Repeatable bucket of a key: md5 is the same in every engine, and in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def number(c: Column | str) -> Column:
    """A score with NaN, the mark for "not applicable", turned into NULL."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
