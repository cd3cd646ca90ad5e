"""Labelled documents for the classifiers: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import crc_mod, stored
from alignframe.session import joined_rows

HELD_OUT_OF = 5
# Labelled rows that a model is fitted on, per label value.
ROWS_PER_LABEL = 8000


def _known(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of the labelled ids that are not held out; an id that is labelled more than once has its highest label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), HELD_OUT_OF) != 0))
    return known.groupBy("doc_id").agg(F.max(label).alias("y"))


def training_values(docs: DataFrame, labels: DataFrame, label: str, value: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, value, y`` of every labelled document that is not held out, as a stored table.

    ``value`` is worked out where the text is read, so texts do not shuffle. Of rows that repeat an id one takes part, the one
    whose text has the smallest hash.
    """
    rows = docs.where(F.col(key).isNotNull() & (crc_mod(F.col(key), HELD_OUT_OF) != 0)).select(
        F.col(key).alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), value.alias("value")).alias("_row")
    )
    one = rows.groupBy("doc_id").agg(F.min("_row")["value"].alias("value"))
    return stored(joined_rows(one, _known(labels, label), "doc_id").select("doc_id", "value", "y"), "training")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_LABEL, key: str = "doc_id",
                  text: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """``doc_id, text, y`` of at most ``rows`` documents per label value, and how many each of them stands for.

    Only documents whose id is not held out are used, those with the smallest hashes of their ids: the same ones in every
    run. A document that is labelled more than once has its highest label. Of rows that repeat an id one takes part, the one
    whose text has the smallest hash. The sample is stored, so the documents are read once for all that is fitted on it.
    """
    known = _known(labels, label).join(docs.select(F.col(key).alias("doc_id")).where(F.col(key).isNotNull()).distinct(), "doc_id")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)
    ]
    # At most 2 * rows ids and labels, some hundred kilobytes.
    chosen = F.broadcast(picked[0].union(picked[1]))
    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    # Each task sends one text of an id at most, however many rows repeat it.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    sample = stored(known.groupBy("doc_id", "y").agg(one).select("doc_id", "text", "y"), "sample")
    stands_for = {y: counts[y] / min(counts[y], rows) for y in counts}
    return sample, stands_for
