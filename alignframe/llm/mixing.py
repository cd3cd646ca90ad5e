"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue: its documents in shuffled order, the whole queue as often as repeats are allowed. A document's
virtual finish time is the number of its source's words up to its end, divided by the source's target. As in a network,
what is long is sent in packets, each with a finish time of its own. The mix is all queues merged by finish time and cut
at the total budget.

No queue and no sort meets in one task. A queue is dealt into ``BUCKETS`` slices of the shuffle order; running totals are
taken inside a slice and over the slices' sums. Packets, of which only finish time and words move, are range-sorted by
finish time; the slices' sums tell in which of them the budget ends. What finishes at one and the same time is taken or
left together.

Sizes: the words of a text (null: 0). A null source is a source of its own, last in order. Repeated rows are documents of
their own; those with equal id are ordered by size and then interchangeable. Sources without words have target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.llm.common import WORD, stored, tasks

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKETS = 512
# Words taken at once: a source's words in the mix are off its target by few packets at most.
PACKET = 64
SLICE_ROWS = 1 << 20
# Rows of the table that tells where each source's queue ends; with more sources it is shuffled in salted copies.
BROADCAST_SOURCES = 50_000
_SALTS = 32


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` from one row per source: ``source, source_size``.

    The budget is shared by weight, and what lies above ``repeats`` times a source's size is shared anew. With sources
    sorted by limit per weight, that ends at the first one whose limit is not below the level that the rest can have.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("limit", F.col("source_size") * repeats)
    )
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(after)
    )
    levelled = placed.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "place", "level")))
    final = levelled.withColumn("level", reached.over(everything)["level"])
    # Without such a source the budget exceeds all limits.
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double"))
    return final.select("source", "source_size", "weight", target.alias("target"))


def queue(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
          share: float = SHARE, repeats: int = REPEATS, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, source, size, place, source_size, target, before``: words of its source ahead of each document.

    ``place`` is the document's place in its queue, a value to be compared. Ids and sizes are stored first, so that the
    texts are read once.
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                        F.xxhash64(text).alias("content"))
    slot, order = _shuffled(F.col("doc_id"), seed, buckets)
    dealt = stored(sized, "sizes").withColumn("order", order).withColumn("bucket", slot)
    # A join needs a value for the null source; the flag keeps it apart from every real name.
    named = dealt.select("*", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"))
    slices = named.groupBy("name", "none", "bucket").agg(F.sum("size").alias("words"))
    totals = slices.groupBy("name", "none").agg(F.sum("words").alias("source_size"))
    targets = source_targets(
        totals.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size"), weights, share, repeats
    ).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "target")
    earlier = Window.partitionBy("name", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    placed = named.join(starts.join(targets, ["name", "none"]), ["name", "none", "bucket"])
    inside = Window.partitionBy("name", "none", "bucket").orderBy("order", "doc_id", "size", "content").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    place = F.struct("bucket", "order", "doc_id", "size", "content")
    return placed.select("doc_id", "source", "size", place.alias("place"), "source_size", "target", before.alias("before"))


def _shuffled(doc_id: Column, seed: int, buckets: int) -> tuple[Column, Column]:
    """Slice and order of a document in its queue."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") % buckets).cast("int"), order


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
        share: float = SHARE, repeats: int = REPEATS, seed: int = 0, budget: int | None = None,
        packet: int | None = PACKET, buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies, finish`` for every document.

    ``taken`` counts the words that the mix takes, repeats counted; ``copies`` the whole copies in it; ``finish`` is the
    virtual finish time of the first copy. Documents are taken in packets of at most ``packet`` words, or whole if that is
    None. ``budget`` (words, the sum of all targets at most and by default) ends the mix: what finishes later is not taken.
    """
    kept = _kept(docs, key, source, text, weights, share, repeats, seed, budget, packet, buckets, slice_rows)
    return kept.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, q: n + q["words"]).alias("taken"),
        F.size(F.filter("kept", lambda q: q["words"] == F.col("size"))).alias("copies"),
        F.get("queued", 0)["finish"].alias("finish"),
    )


def _kept(docs: DataFrame, key, source, text, weights, share, repeats, seed, budget, packet, buckets, slice_rows) -> DataFrame:
    """The queue with all its copies, ``queued``, and those in the mix, ``kept``."""
    # Several passes read this narrow table.
    queued = stored(queue(docs, key, source, text, weights, share, repeats, seed, buckets), "queue")
    # The last packet's number; a document without words has one that holds none.
    last = F.greatest(F.ceil(F.col("size") / packet), F.lit(1)).cast("bigint") if packet else F.lit(1).cast("bigint")
    upto = lambda number: F.least(number * packet, F.col("size")) if packet else F.col("size")
    finish = lambda start, number: F.try_divide(start + upto(number), F.col("target"))

    def copy(repeat: Column) -> Column:
        start = F.col("before") + repeat * F.col("source_size")
        return F.struct(repeat.alias("repeat"), start.alias("start"), finish(start, last).alias("finish"))

    copies = queued.withColumn("queued", F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), copy))
    numbered = copies.where("size > 0").select("size", "target", F.inline("queued")).select(
        "size", "target", "start", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("number")
    )
    ahead = (F.col("number") - 1) * packet if packet else F.lit(0).cast("bigint")
    items = numbered.select(finish(F.col("start"), F.col("number")).alias("finish"), (upto(F.col("number")) - ahead).alias("words"))
    # Exact sums, which do not depend on the order of addition; a target's fraction is no more than that of its division.
    sums = queued.groupBy("source").agg(F.max("target").cast("decimal(28,6)").alias("target"), F.sum(last).alias("items"))
    total = sums.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("items"), F.lit(0))).first()
    targets = int(round(total[0], 3))
    room = targets if budget is None else min(budget, targets)
    end = F.lit(_finish_time_at(items.where("finish is not null"), room, total[1] * repeats, slice_rows))

    def words(copy: Column) -> Column:
        taken = F.when(copy["finish"] <= end, F.col("size"))
        if packet:
            # Only where the end falls inside a document are its packets told apart.
            inside = F.transform(F.sequence(F.lit(1).cast("bigint"), last), lambda k: F.when(finish(copy["start"], k) <= end, upto(k)))
            taken = taken.when(F.try_divide(copy["start"], F.col("target")) < end, F.array_max(inside))
        return F.struct(copy["repeat"].alias("repeat"), F.coalesce(taken, F.lit(0).cast("bigint")).alias("words"))

    return copies.withColumn("kept", F.filter(F.transform("queued", words), lambda q: q["words"] > 0))


def _finish_time_at(items: DataFrame, room: int, count: int, slice_rows: int) -> float:
    """The last finish time up to which all words fit into the room.

    All items are range-sorted by finish time into slices of about ``slice_rows``. The driver gets single rows: the slice in
    which the running sum passes the room and the room before it, then the time inside that slice.
    """
    slices = max(tasks(items.sparkSession), -(-count // slice_rows))
    ordered = items.repartitionByRange(slices, "finish").sortWithinPartitions("finish")
    ordered = stored(ordered.withColumn("slice", F.spark_partition_id()), "finish")
    sums = ordered.groupBy("slice").agg(F.sum("words").alias("words"))
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = sums.withColumn("upto", F.sum("words").over(running)).where(F.col("upto") > room)
    row = past.orderBy("slice").select("slice", (F.col("upto") - F.col("words")).alias("before")).first()
    if row is None:
        return float("inf")
    upto = F.sum("words").over(Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ordered.where(F.col("slice") == row["slice"]).withColumn("upto", upto).agg(
        F.max(F.when(F.col("upto") <= room - row["before"], F.col("finish"))).alias("last"), F.min("finish").alias("next")
    ).first()
    return ends["last"] if ends["last"] is not None else math.nextafter(ends["next"], 0.0)


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
                    share: float = SHARE, repeats: int = REPEATS, seed: int = 0, budget: int | None = None,
                    buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it whole; columns as in ``docs``, whatever their names.

    A mix takes each queue from its start, so one place per source and repeat tells which documents are in it: that table
    goes to the texts, which stay where they are. Rows of one source with equal id, size and text share a place and are
    taken together. Documents without words are never taken.
    """
    kept = _kept(docs, key, source, text, weights, share, repeats, seed, budget, None, buckets, slice_rows)
    items = kept.select("source", "place", F.explode("kept").alias("item"))
    ends = items.groupBy("source", F.col("item.repeat").alias("repeat")).agg(F.max("place").alias("last"))
    ends = ends.groupBy(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")).agg(
        F.collect_list("last").alias("lasts")
    )
    # Beside the documents' own columns, which keep their names inside one struct.
    col = {name: F.col(f"doc.`{name}`") for name in (key, source, text)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).where(col[text].rlike(WORD)).select(
        "doc", F.coalesce(col[source], F.lit("")).alias("name"), col[source].isNull().alias("none")
    )
    ends = stored(ends, "ends")
    if ends.count() <= BROADCAST_SOURCES:
        found = rows.join(F.broadcast(ends), ["name", "none"])
    else:
        salted = ends.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
        found = rows.withColumn("salt", F.spark_partition_id() % _SALTS).join(salted, ["name", "none", "salt"])

    slot, order = _shuffled(col[key], seed, buckets)
    ahead = F.struct(slot.alias("bucket"), order.alias("order"), col[key].alias("doc_id"))
    size = F.coalesce(F.regexp_count(col[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    whole = F.struct(slot.alias("bucket"), order.alias("order"), col[key].alias("doc_id"), size.alias("size"), F.xxhash64(col[text]).alias("content"))

    def taken(last: Column) -> Column:
        end = F.struct(last["bucket"].alias("bucket"), last["order"].alias("order"), last["doc_id"].alias("doc_id"))
        # Sizes decide between rows of one id only.
        return F.when(ahead < end, True).when(ahead > end, False).otherwise(whole <= last)

    copies = F.filter("lasts", taken)
    return found.select("doc", F.explode(copies).alias("copy")).select("doc.*")
