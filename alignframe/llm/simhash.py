"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six of their eight bytes, each at its own
position. Postings of single bytes would hold 1/256 of all fingerprints each, so the index is keyed by four bytes at
once: the eight positions form four neighbours' pairs, and six agreeing bytes always contain two whole pairs. Every pair
met in a posting list is tallied by its agreeing bytes, kept from six on, and verified bit by bit.

A posting list longer than ``LONG_LIST`` is not paired up. Within it, fingerprints at most two bits apart share a
neighbour at one bit or none, so each is listed under its 33 neighbours and linked to the smallest one of the list:
all members of such a list are within two bits of each other. Nothing is left out, and work is linear.

Null texts and texts without words have fingerprint zero and are linked like any other. Repeated rows stay repeated. A
null ``doc_id`` never names a component; a class without any id has a null component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import components, stored

SEED = 42
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
LONG_LIST = 128
_BLOCK = 1 << 16

# Four bytes out of two of the four 16-bit quarters of a fingerprint.
_MASKS = [
    sum(0xFFFF << (16 * q) for q in pair) for pair in [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    ones, count = np.zeros(64, dtype=np.int64), max(len(words) - shingle + 1, 1)
    for at in range(0, count, _BLOCK):
        part = words[at : min(at + _BLOCK, count) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)], strict=False)) if count > 1 else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp`` with the fingerprint as bigint."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(key).alias(key), of(F.col(text)).alias("fp"))


def _agreeing_bytes(a: str, b: str) -> Column:
    return sum(
        (F.expr(f"shiftrightunsigned({a} ^ {b}, {8 * i}) & 255") == 0).cast("int") for i in range(8)
    )


def links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that connect exactly those at most two bits apart."""
    indexed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _MASKS])).alias("slot", "bytes"),
    )
    lengths = indexed.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = indexed.join(lengths, ["slot", "bytes"])
    short, long = postings.where(F.col("n") <= long_list), postings.where(F.col("n") > long_list)

    left = short.select("slot", "bytes", F.col("fp").alias("a"))
    right = short.select("slot", "bytes", F.col("fp").alias("b"))
    tallied = left.join(right, ["slot", "bytes"]).where("a < b").select("a", "b", _agreeing_bytes("a", "b").alias("shared"))
    verified = tallied.where((F.col("shared") >= MIN_BYTES) & (F.expr("bit_count(a ^ b)") <= MAX_BITS))

    free = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.get(F.array(*[F.lit(_free_bits(m)) for m in _MASKS]), F.col("slot"))[i] == 1,
        ),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
    )
    near = long.select("slot", "fp", F.explode(F.concat(F.array("fp"), free)).alias("near"))
    # One row per list and task after the map-side minimum; the star's centre is any of the list's members.
    centres = near.groupBy("slot", "near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(centres, ["slot", "near"]).select(F.col("fp").alias("a"), "b").where("a <> b")
    return verified.select("a", "b").union(stars)


def _free_bits(mask: int) -> list[int]:
    return [0 if mask >> i & 1 else 1 for i in range(64)]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    long_list: int = LONG_LIST) -> DataFrame:
    """``key, fingerprint, component_id``: one row per row of ``docs``."""
    printed = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    # Copies share a fingerprint: the index sees each fingerprint once, whatever the size of its class.
    classes = printed.groupBy("fp").agg(F.min(key).alias("least"))
    joined = components(links(printed.select("fp").distinct(), long_list))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(smallest, "component").select("fp", "component_id")
    return printed.join(found, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
