"""Supervised examples, splits, orders and padding."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.functions.text import words
from alignframe.operators.ranking import running_total, with_position
from alignframe.operators.skew import HOT_KEYS, lookup
from alignframe.session import reachable, spread

IGNORED_LABEL = -100
EOS_ID = 0
UNKNOWN_ID = -1
# Words whose ids every task has at hand, and the longest of them.
FREQUENT_WORDS = 1 << 16
_FREQUENT_BYTES = 64
_BATCHES_PER_TASK = 1 << 16


def build_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``token, token_id``: ids from 1 by falling count, then by token; 0 is the end mark."""
    tokens = df.select(F.explode(F.flatten(F.array(*[words(c) for c in columns]))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    ranked = with_position(counts, [F.desc("uses"), F.col("token")], "rank")
    return ranked.select("token", (F.col("rank") + 1).alias("token_id"))


def supervised_examples(df: DataFrame, key: str, prompt: str, answer: str, vocab: DataFrame,
                        max_len: int = 4096) -> DataFrame:
    """``input_ids, attention_mask, labels`` per key: prompt then answer, labels only on the answer.

    The end mark is added when it is not there yet and the example is shorter than ``max_len``; nothing is cut. Frequent
    words get their ids where the text is read. Of all others each example sends every distinct one once to the
    vocabulary, beside its row of packed ids, in which they are filled in when they return.
    """
    reachable(df.sparkSession)
    coded = _coded(frequent_words(vocab))
    texts = spread(df.select(key, prompt, answer), key).select(key, words(prompt).alias("_p"), words(answer).alias("_a"))
    packed = texts.select(key, F.size("_p").alias("_prompt_len"), coded(F.concat("_p", "_a")).alias("_coded"))
    # The packed ids go with one row of their example, which looks nothing up.
    sent = packed.select(
        key,
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_coded.rare", F.array().cast("array<string>"))))
        .alias("_place", "token"),
        F.struct("_prompt_len", F.col("_coded.ids").alias("ids")).alias("_packed"),
    ).withColumn("_packed", F.when(F.col("_place") == 0, F.col("_packed")))
    found = lookup(sent, vocab, ["token"], ["token_id"], hot_where=F.col("token_id") <= HOT_KEYS)
    # One group is one example.
    rare = F.sort_array(F.array_agg(F.when(F.col("_place") > 0, F.struct("_place", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id")))))
    gathered = found.groupBy(key).agg(F.first("_packed", ignorenulls=True).alias("_packed"), rare.alias("_rare"))
    body = F.transform("_packed.ids", lambda t: F.when(t < 0, F.get("_rare", -1 - t.cast("int"))["id"]).otherwise(t))
    full = F.when(
        (F.coalesce(F.get("_body", F.size("_body") - 1), F.lit(UNKNOWN_ID)) != EOS_ID) & (F.size("_body") < max_len),
        F.concat("_body", F.array(F.lit(EOS_ID).cast("bigint"))),
    ).otherwise(F.col("_body"))
    return (
        gathered.select(key, F.col("_packed._prompt_len").alias("_prompt_len"), F.coalesce(body, F.array().cast("array<bigint>")).alias("_body"))
        .withColumn("input_ids", full)
        .select(
            key,
            "input_ids",
            F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
            F.transform(
                "input_ids",
                lambda t, i: F.when(i < F.col("_prompt_len"), F.lit(IGNORED_LABEL).cast("bigint")).otherwise(t),
            ).alias("labels"),
        )
    )


def frequent_words(vocab: DataFrame, most: int = FREQUENT_WORDS) -> pa.Table:
    """At most ``most`` short words of a vocabulary with the smallest ids, some megabytes."""
    short = vocab.where((F.col("token_id") >= 0) & (F.col("token_id") <= most) & (F.octet_length("token") <= _FREQUENT_BYTES))
    return short.select("token", F.col("token_id").cast("bigint").alias("token_id")).limit(most).toArrow()


def _coded(frequent: pa.Table) -> Callable[[Column], Column]:
    """Ids of frequent words; others are numbered within their row, -1 for the first, and listed."""
    known, ids = frequent["token"].combine_chunks().cast(pa.string()), frequent["token_id"].to_numpy()

    @F.arrow_udf("ids array<bigint>, rare array<string>")
    def coded(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = tokens.flatten().dictionary_encode()
        number = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.fill_null(pc.index_in(distinct.dictionary.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
        value = np.where(place >= 0, ids[np.maximum(place, 0)] if len(ids) else 0, -1)[number] if len(number) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(value < 0)
        radix = max(len(distinct.dictionary), 1)
        words_of_rows, within = np.unique(row[at] * radix + number[at], return_inverse=True)
        begins = np.searchsorted(words_of_rows, np.arange(len(sizes) + 1) * radix)
        value[at] = -1 - (within - begins[row[at]])
        offsets = lambda ends: pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets(np.concatenate([[0], np.cumsum(sizes)])), pa.array(value, pa.int64())),
                pa.ListArray.from_arrays(offsets(begins), distinct.dictionary.take(pa.array(words_of_rows % radix)).cast(pa.string())),
            ],
            ["ids", "rare"],
        )

    return coded


def split_by_key(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and evaluation rows: disjoint, complete, the same in every run, and of exact size.

    The evaluation part has the rows with the smallest hashes of their keys, ``test_fraction`` of all that have a key, rounded
    to the nearest number with halves up. Rows that share a key stay together, so the last key may bring some rows more. A job
    finds the last hash; the parts themselves are filters, without a shuffle.
    """
    last = _hash_at(df.select(shuffle_key(key, seed).alias("_hash")), test_fraction)
    held_out = F.lit(False) if last is None else F.coalesce(shuffle_key(key, seed) <= last, F.lit(False))
    return df.where(~held_out), df.where(held_out)


def _hash_at(hashes: DataFrame, fraction: float) -> str | None:
    """The hash up to which ``fraction`` of all rows lie; the driver gets one row a round.

    Hashes are counted by their first digits, and only those that begin like the wanted one are counted by more digits.
    A round orders 65,536 rows at most, the last one what is left of a hash's 2^32 beginnings.
    """
    hashes = hashes.where(F.col("_hash").isNotNull())
    wanted = math.floor(hashes.count() * fraction + 0.5)
    if wanted <= 0:
        return None
    begins = ""
    for digits in (4, 8, 32):
        counts = hashes.where(F.col("_hash").startswith(begins)).groupBy(F.substring("_hash", 1, digits).alias("_begins")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_begins").rowsBetween(Window.unboundedPreceding, 0))
        row = counts.withColumn("_upto", upto).where(F.col("_upto") >= wanted).orderBy("_begins").first()
        if row is None:
            # Everything is wanted.
            return "g"
        begins, wanted = row["_begins"], wanted - (row["_upto"] - row["_n"])
    return begins


def shuffle_key(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A repeatable shuffle."""
    return df.orderBy(shuffle_key(key, seed), key)


def length_order(df: DataFrame, column: str, key: str) -> DataFrame:
    """Shortest text first; the key breaks ties."""
    return df.orderBy(F.length(column), key)


def padding_report(df: DataFrame, length: str, batch_size: int, multiple: int = 8) -> DataFrame:
    """Cost of padding length-sorted batches: ``batch_id, rows, max_len, padded_len, waste``.

    Rows of one length are interchangeable, so no row is sorted: lengths are counted, the running count says which
    batches a length reaches, and each batch adds up its lengths.
    """
    counts = df.groupBy(F.col(length).cast("bigint").alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts.where(F.col("_len").isNotNull()), "_len", "_n", "_upto")
    reach = upto.select(
        "_len",
        (F.col("_upto") - F.col("_n")).alias("_from"),
        "_upto",
    ).withColumns(
        {
            "_first": F.expr(f"_from div {batch_size}"),
            "_last": F.expr(f"(_upto - 1) div {batch_size}"),
        }
    )
    # A length shared by very many rows reaches very many batches: list them in pieces, in many tasks.
    pieces = reach.select(
        "*",
        F.explode(F.sequence("_first", "_last", F.lit(_BATCHES_PER_TASK).cast("bigint"))).alias("_piece"),
    ).repartition("_piece")
    batches = pieces.select(
        "_len",
        "_from",
        "_upto",
        F.explode(
            F.sequence("_piece", F.least("_last", F.col("_piece") + (_BATCHES_PER_TASK - 1)))
        ).alias("batch_id"),
    )
    begin, end = F.col("batch_id") * batch_size, (F.col("batch_id") + 1) * batch_size
    inside = F.least("_upto", end) - F.greatest("_from", begin)
    sums = batches.groupBy("batch_id").agg(
        F.sum(inside).alias("rows"),
        F.max("_len").alias("max_len"),
        F.sum(inside * F.col("_len")).alias("_used"),
    )
    padded = F.ceil(F.col("max_len") / multiple) * multiple
    return sums.select(
        "batch_id",
        "rows",
        "max_len",
        padded.alias("padded_len"),
        (padded * F.col("rows") - F.col("_used")).alias("waste"),
    )


def preview(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The first rows by key: a top-k, not a sort."""
    return df.orderBy(key).limit(n)
