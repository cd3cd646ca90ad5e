"""Spelling variants of a corpus' words, found through permuterm rotations.

Words are counted over whole texts. Every word is marked with a terminator and turned: the rotation that starts behind one
of its characters and leaves that character out, ``word[p+1:] + $ + word[:p]``, is shared by exactly those words that differ
by a replacement there, and it is the whole rotation of the word that lacks the character. So all rotations are sorted, and
each group of equal ones holds the words one edit apart at one place: replacements among the shortened rotations, insertions
and deletions between them and the whole one. A group has as many members as the alphabet has letters, at most, and one
more. It is scanned once: its members get counts and their best neighbour, no pairs are made.

A pair one deletion apart would meet once for each letter of a run of equal ones; only the first letter of a run counts, so
every pair meets once and counts add up without a distinct.

Rotations of words longer than ``LONG_WORD`` are replaced by their place, length and a polynomial hash of 124 bits, which is
updated from letter to letter, so that a run of a million letters costs a million short rows and not their square.

Null and empty texts have no words; a null ``doc_id`` counts as an empty one in the checksum. Repeated rows count as often as
they come. Ties between neighbours go to the smallest word in code-point order. An empty table has no words; other columns
of any name are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.llm.common import small_batches, stored, tasks

DAMAGE = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
LONG_WORD = 48

# Runs of Latin letters in UTF-8 with A-Z in lower case: U+00C0 to U+00FF are the byte C3 and one from 80 to BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LETTERS = b"abcdefghijklmnopqrstuvwxyz\xc3" + bytes(range(0x80, 0xC0))
_TEXT_PIECE = 1 << 22
_HELD_WORDS = 200_000


def _runs(text: str) -> Iterator[list[bytes]]:
    """The runs of a text in pieces that end between runs."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = min(at + _TEXT_PIECE, len(data))
        while end < len(data) and data[end] in _LETTERS:
            end += 1
        yield _RUN.findall(data, at, end)
        at = end


def _damaged(word: bytes, checksum: int) -> bytes:
    letters = word.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int = DAMAGE, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: every word of at least ``min_length`` code points and ``min_count`` occurrences.

    A run of letters whose checksum with its document is divisible by ``damage`` loses one code point (0: none does).
    """
    small_batches(docs.sparkSession, 500)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def flushed() -> pd.DataFrame:
            words = [w.decode() for w in held]
            out = pd.DataFrame({"word": words, "n": list(held.values())}).astype({"n": "int64"})
            held.clear()
            # Shorter words are none, by definition.
            return out[out["word"].str.len() >= min_length] if words else out

        for batch in batches:
            for doc_id, whole in zip(batch["key"], batch["text"], strict=True):
                if not whole:
                    continue
                prefix = zlib.crc32(f"{doc_id or ''}:".encode())
                for runs in _runs(whole):
                    # The checksum of a run is the same throughout its document.
                    for run, n in Counter(runs).items():
                        if damage and (h := zlib.crc32(run, prefix)) % damage == 0:
                            run = _damaged(run, h)
                        held[run] += n
                    if len(held) > _HELD_WORDS:
                        yield flushed()
        if held:
            yield flushed()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _numbered(words: DataFrame) -> DataFrame:
    """``id, word, n`` with consecutive numbers in code-point order, from sorted slices and the sizes of earlier ones."""
    words = stored(words, "words")
    slices = words.repartitionByRange(tasks(words.sparkSession), "word").sortWithinPartitions("word").select(
        "word", "n", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    )
    slices = stored(slices, "sorted_words")
    sizes = slices.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice.
    starts = sizes.select("slice", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    return slices.join(F.broadcast(starts), "slice").select((F.col("start") + F.col("at")).alias("id"), "word", "n")


# Primes below 2^31 and bases of the polynomial hashes.
_FIELDS = [(2147483647, 1000003), (2147483629, 918273), (2147483587, 5772156), (2147483579, 31415926)]


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < count:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out[:count]


def _long_rotations(word: str) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """Places and hashes of a word's shortened rotations, and of its whole ones.

    A word's hash is the sum of its letters times powers of the base; without letter p, all later powers fall by one.
    """
    letters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    shortened, whole = [], []
    for prime, base in _FIELDS:
        p = np.uint64(prime)
        terms = letters * _powers(base, prime, len(letters)) % p
        upto = np.concatenate([[np.uint64(0)], np.cumsum(terms) % p])
        inverse = np.uint64(pow(base, -1, prime))
        later = (upto[-1] + p - upto[1:]) % p
        shortened.append((upto[:-1] + later * inverse) % p)
        whole.append(np.full(len(letters) + 1, upto[-1]))
    yield np.arange(len(letters)), shortened, False
    yield np.arange(len(letters) + 1), whole, True


def _long_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    step = 1 << 16
    for batch in batches:
        for number, word, n in zip(batch["id"], batch["word"], batch["n"], strict=True):
            letters = np.array(list(word))
            first = np.concatenate([[True], letters[1:] != letters[:-1]])
            for places, hashes, whole in _long_rotations(word):
                length = len(word) - (not whole)
                for at in range(0, len(places), step):
                    part = slice(at, at + step)
                    keys = [f"{p}:{length}:{a:x}:{b:x}:{c:x}:{d:x}" for p, a, b, c, d in zip(places[part], *(h[part] for h in hashes), strict=True)]
                    yield pd.DataFrame({"key": keys, "id": number, "n": n, "whole": whole, "first": True if whole else first[part]})


def rotations(words: DataFrame, long_word: int = LONG_WORD) -> DataFrame:
    """``key, id, n, whole, first``: for each word its whole rotations and those without the character in front.

    ``first`` tells whether that character begins a run of equal ones.
    """
    terminator = "$"
    # A word makes twice as many rows as it has letters: deal words by number, whatever the size of their table.
    words = words.repartition(tasks(words.sparkSession), "id")
    short = words.where(F.length("word") <= long_word)
    # Rotations are cut out of the word written twice.
    place = F.sequence(F.lit(0), F.length("word"))
    placed = short.select("id", "n", "word", F.concat("word", F.lit(terminator), "word").alias("twice"), F.length("word").alias("size"), F.explode(place).alias("p"))

    def cut(start: Column, length: Column) -> Column:
        return F.substring(F.col("twice"), start, length)

    whole = F.struct(cut(F.col("p") + 1, F.col("size") + 1).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first"))
    letter, before = F.substring("word", F.col("p") + 1, F.lit(1)), F.substring("word", F.col("p"), F.lit(1))
    shortened = F.struct(
        cut(F.col("p") + 2, F.col("size")).alias("key"), F.lit(False).alias("whole"), ((F.col("p") == 0) | (letter != before)).alias("first")
    )
    both = F.when(F.col("p") < F.col("size"), F.array(whole, shortened)).otherwise(F.array(whole))
    turned = placed.select("id", "n", F.inline(both)).select("key", "id", "n", "whole", "first")
    long = words.where(F.length("word") > long_word).select("id", "word", "n")
    return turned.unionByName(long.mapInPandas(_long_keys, "key string, id bigint, n bigint, whole boolean, first boolean"))


def neighbours(words: DataFrame, long_word: int = LONG_WORD) -> DataFrame:
    """``id, n_near, best``: how many words are one edit away, and the most frequent of them as ``(-n, id)``."""
    member = F.struct((-F.col("n")).alias("less"), "id", "whole", "first")
    groups = rotations(words, long_word).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("members"))
    groups = groups.where(F.size("members") > 1).select(
        F.filter("members", lambda m: ~m["whole"]).alias("shortened"), F.get(F.filter("members", lambda m: m["whole"]), F.lit(0)).alias("whole")
    )
    groups = groups.withColumn("firsts", F.filter("shortened", lambda m: m["first"]))

    def found(number: Column, near: Column, best: Column) -> Column:
        return F.struct(number.alias("id"), near.cast("bigint").alias("near"), F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("best"))

    def of_shortened(m: Column) -> Column:
        other = F.when(F.get("shortened", F.lit(0))["id"] == m["id"], F.get("shortened", F.lit(1))).otherwise(F.get("shortened", F.lit(0)))
        lacking = F.when(m["first"], F.col("whole"))
        # The lesser of the two is the more frequent one; null where there is neither.
        return found(m["id"], F.size("shortened") - 1 + F.when(lacking.isNotNull(), 1).otherwise(0), F.least(other, lacking))

    of_whole = F.when(F.col("whole").isNotNull(), F.array(found(F.col("whole")["id"], F.size("firsts"), F.get("firsts", F.lit(0))))).otherwise(F.array())
    each = groups.select(F.inline(F.concat(F.transform("shortened", of_shortened), of_whole))).where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form``: counts at least grow along a chain, so that doubling the steps ends."""
    steps = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = stored(steps.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int = DAMAGE, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO, long_word: int = LONG_WORD) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word, its more frequent spelling, and the last of that chain."""
    words = stored(_numbered(count_words(docs, key, text, damage, min_length, min_count)), "numbered_words")
    near = stored(neighbours(words, long_word), "neighbours")
    found = words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"),
    )
    formed = found.select("id", "word", "n", "n_near", F.col("best.id").alias("form_id"), (-F.col("best.less")).alias("form_n"))
    formed = stored(formed, "forms")
    roots = _roots(formed.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    # Only words that have a form look up two words more.
    named = formed.where("form_id is not null").join(roots, "id")
    named = named.join(words.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id")
    named = named.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    with_form = named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    without = formed.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return with_form.unionByName(without).select(columns)
