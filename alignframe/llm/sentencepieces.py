"""SentencePiece encoding and decoding through a relational lattice.

Texts fall into units: a run of word marks with the characters up to the next one or to a line end. No piece crosses a unit's
edge. For the units that occur most, the lattice is built by Spark: explode
all substrings up to the longest piece, join them to the piece table (broadcast: its size is the vocabulary's), group the
edges by unit, and fold them with a higher-order aggregate. The fold depends on the model's kind. A unigram model
takes the Viterbi path. The path of highest score is not what a BPE model encodes to (it differs on most words of an
ordinary text), so for BPE the fold merges neighbours in order of score, the leftmost first.

Encoding a text then looks its units up. The table of frequent units has at most ``FREQUENT`` rows of at most ``LONGEST``
characters, so workers can hold it; all other units, of any length, go through the same fold where the text is. Texts
never move between machines.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike. Word marks that a text itself
holds decode to blanks, as the model defines.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignframe.llm.common import small_batches, stored
from alignframe.session import spread

MARK = "▁"
FREQUENT = 1 << 18
LONGEST = 32
_REMEMBERED = 150_000
_HISTOGRAM = 1 << 14

# Piece kinds and model kinds of the model file.
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model file."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bpe: bool
    byte_fallback: bool
    prefix: bool

    @staticmethod
    def read(path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type not in (_UNIGRAM, _BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models that leave characters and blanks as they are")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type == _NORMAL):
            raise ValueError("a piece holds a word mark behind another character")
        return Pieces(
            tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), tuple(p.type for p in model.pieces),
            model.trainer_spec.model_type == _BPE, model.trainer_spec.byte_fallback, spec.add_dummy_prefix,
        )

    def normal(self) -> dict[str, int]:
        return {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _NORMAL}

    def unknown(self) -> int:
        return self.kinds.index(_UNKNOWN)

    def byte_ids(self) -> list[int]:
        by_name = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _BYTE}
        return [by_name[f"<0x{b:02X}>"] for b in range(256)] if self.byte_fallback else []

    def unit_pattern(self) -> str:
        """A unit: word marks with what follows up to the next mark. Line ends and tabs are units if no piece holds them."""
        inner = {c for p in self.normal() if len(p) > 1 for c in p}
        apart = "".join(e for c, e in (("\n", "\\n"), ("\t", "\\t")) if c not in inner)
        alone = f"|[{apart}]" if apart else ""
        return f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+{alone}"


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    rows = [(n, i, float(pieces.scores[i])) for n, i in pieces.normal().items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), "piece string, id int, score double")


def frequent_units(docs: DataFrame, text: str = "text", most: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """``unit``: the units of at most ``longest`` characters that occur most, ``most`` of them at most.

    Counted are the words between blanks, which are units with the mark of the blank before them. The least count is read off a histogram of counts, so nothing is sorted and equal counts stay together.
    """
    words = docs.select(F.explode(F.split(F.col(text), " ")).alias("word")).where(F.length("word") < longest)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A word that holds a line end or a mark is more than one unit; its parts are encoded where they are.
    whole = counts.where(~F.col("word").rlike(f"[\\n\\t{MARK}]"))
    counted = stored(whole.select(F.concat(F.lit(MARK), "word").alias("unit"), "n"), "units")
    # At most as many rows as the histogram has bins.
    bins = counted.groupBy(F.least("n", F.lit(_HISTOGRAM)).alias("n")).agg(F.count(F.lit(1)).alias("units")).collect()
    least, room = _HISTOGRAM + 1, most
    for n, size in sorted(((r["n"], r["units"]) for r in bins), reverse=True):
        if size > room:
            break
        least, room = n, room - size
    return counted.where(F.col("n") >= least).select("unit")


def lattice(units: DataFrame, table: DataFrame, longest_piece: int) -> DataFrame:
    """``unit, edges``: per distinct unit the pieces found in it as ``start, len, id, score``, by start and length."""
    # Short rows, much work: a stated number of tasks, which the grouping below keeps.
    units = spread(units, "unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    spans = starts.select(
        "unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest_piece), F.length("unit") - F.col("start") + 1))).alias("len")
    )
    cut = spans.withColumn("piece", F.col("unit").substr(F.col("start"), F.col("len")))
    edges = cut.join(F.broadcast(table), "piece")
    found = edges.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("start", "len", "id", "score"))).alias("edges"))
    return units.join(found, "unit", "left").select("unit", F.coalesce("edges", F.expr("cast(array() AS array<struct<start:int,len:int,id:int,score:double>>)")).alias("edges"))


def merge_fold() -> Column:
    """Starts of the symbols of a unit after all merges of a BPE model.

    The state is the array of symbol starts, closed by the unit's end. Each step looks up the pieces that two neighbouring
    symbols make, and drops the start between the two whose piece has the highest score.
    """
    scores = "map_from_arrays(transform(edges, e -> e.start * 32 + e.len), transform(edges, e -> e.score))"
    joined = """array_max(transform(sequence(0, size(b) - 3), j -> named_struct(
        'score', try_element_at(m, b[j] * 32 + b[j + 2] - b[j]), 'left', -j)))"""
    step = f"""CASE WHEN size(b) < 3 THEN b ELSE transform(array({joined}), t -> CASE WHEN t.score IS NULL THEN b
        ELSE filter(b, (x, j) -> j <> 1 - t.left) END)[0] END"""
    fold = f"""aggregate(sequence(1, greatest(length(unit) - 1, 1)), sequence(1, length(unit) + 1), (b, i) -> {step},
        b -> slice(b, 1, size(b) - 1))"""
    return F.expr(f"transform(array({scores}), m -> {fold})[0]")


def viterbi_fold(unknown_penalty: float) -> Column:
    """Starts of the symbols on the path of highest total score; a character without a piece costs the penalty.

    The state holds the best score and the path up to each place of the unit.
    """
    into = "filter(edges, e -> e.start + e.len = i + 1)"
    from_edge = f"""transform({into}, e -> named_struct('score', s[e.start - 1].score + e.score,
        'path', concat(s[e.start - 1].path, array(e.start))))"""
    alone = f"named_struct('score', s[i - 1].score + {unknown_penalty}D, 'path', concat(s[i - 1].path, array(i)))"
    step = f"concat(s, array(array_max(concat({from_edge}, array({alone})))))"
    start = "array(named_struct('score', 0D, 'path', cast(array() AS array<int>)))"
    return F.expr(f"aggregate(sequence(1, length(unit)), {start}, (s, i) -> {step}, s -> element_at(s, -1).path)")


def unit_ids(units: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, pieces``: the symbols of each distinct unit, as texts."""
    longest = max(map(len, pieces.normal()))
    penalty = min(s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == _NORMAL) - 10
    fold = merge_fold() if pieces.bpe else viterbi_fold(penalty)
    starts = lattice(units, table, longest).withColumn("starts", fold)
    return starts.select(
        "unit",
        F.transform(
            "starts",
            lambda s, i: F.col("unit").substr(s, F.coalesce(F.get("starts", i + 1), F.length("unit") + 1) - s),
        ).alias("pieces"),
    )


class UnitEncoder:
    """The same fold for one unit of any length, where the text is."""

    def __init__(self, pieces: Pieces):
        self.ids, self.scores, self.bpe = pieces.normal(), pieces.scores, pieces.bpe
        self.bytes, self.unknown = pieces.byte_ids(), pieces.unknown()
        # Higher scores come first; all ranks are below 1.
        top, span = max(self.scores), max(self.scores) - min(self.scores) + 1
        self.rank = {p: (top - self.scores[i]) / span for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.penalty = min(self.scores[i] for i in self.ids.values()) - 10

    def symbols(self, unit: str) -> list[str]:
        if not self.bpe:
            return self._best_path(unit)
        return self._merged(unit) if len(unit) <= 2 * LONGEST else self._merged_long(unit)

    def _merged(self, unit: str) -> list[str]:
        rank, none = self.rank.get, 1.0
        out = list(unit)
        ranks = [rank(a + b, none) for a, b in zip(out, out[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            out[at] += out.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(out[at] + out[at + 1], none)
            if at:
                ranks[at - 1] = rank(out[at - 1] + out[at], none)
        return out

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a queue of offers, for units whose every step should not scan them."""
        ids, scores, n = self.ids, self.scores, len(unit)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (found := ids.get(unit[left : ends[right]])) is not None:
                heapq.heappush(queue, (-scores[found], left, ends[right]))

        for left in range(n - 1):
            offer(left)
        while queue:
            _, left, end = heapq.heappop(queue)
            right = after[left] if ends[left] else n
            # Stale unless both symbols are still the ones that the offer was made for.
            if right >= n or ends[right] != end:
                continue
            ends[left], ends[right], after[left] = end, 0, after[right]
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [unit[i : ends[i]] for i in range(n) if ends[i]]

    def _best_path(self, unit: str) -> list[str]:
        score, back = [0.0], [0]
        for end in range(1, len(unit) + 1):
            best = (score[end - 1] + self.penalty, end - 1)
            for start in range(max(0, end - self.longest), end):
                if (found := self.ids.get(unit[start:end])) is not None:
                    # A tie goes to the later start, as in the fold.
                    best = max(best, (score[start] + self.scores[found], start))
            score.append(best[0])
            back.append(best[1])
        out, end = [], len(unit)
        while end:
            out.append(unit[back[end] : end])
            end = back[end]
        return out[::-1]

    def numbers(self, symbols: list[str]) -> np.ndarray:
        out: list[int] = []
        for s in symbols:
            if (found := self.ids.get(s)) is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<i4")


def encoder(docs: DataFrame, pieces: Pieces, text: str = "text", frequent: int = FREQUENT):
    """A UDF from text to ids. The frequent units of ``docs`` are encoded by the lattice when this is called."""
    spark = docs.sparkSession
    units = frequent_units(docs, text, frequent)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = UnitEncoder(pieces)
        for batch in batches:
            ids = [one.numbers(p).tobytes() for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(ids, type=pa.binary())], ["unit", "ids"])

    known = unit_ids(units, piece_table(spark, pieces), pieces).mapInArrow(numbered, "unit string, ids binary").toArrow()
    # Bounded by FREQUENT rows of LONGEST characters; it stays in Arrow's form until a worker needs it.
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as writer:
        writer.write_table(known)
    table = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    pattern, prefix = pieces.unit_pattern(), MARK if pieces.prefix else ""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.ipc.open_stream(table.value).read_all()
        frequent_ids = dict(zip(known["unit"].to_pylist(), known["ids"].to_pylist(), strict=True))
        rest, units_of = UnitEncoder(pieces), re.compile(pattern)

        class Remembered(dict):
            def __missing__(self, unit: str) -> bytes:
                found = frequent_ids.get(unit)
                if found is None:
                    found = rest.numbers(rest.symbols(unit)).tobytes()
                    if len(self) >= _REMEMBERED:
                        self.clear()
                if len(unit) <= LONGEST:
                    self[unit] = found
                return found

        ids_of = Remembered().__getitem__
        for batch in texts:
            blobs = [b"".join(map(ids_of, units_of.findall(prefix + t.replace(" ", MARK)))) if t else b"" for t in batch.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"))
            yield pa.ListArray.from_arrays(pa.array(offsets), values)

    return encode


def decoder(pieces: Pieces):
    """A UDF from ids to text."""
    joined = [
        bytes([int(n[3:5], 16)]) if k == _BYTE else n.replace(MARK, " ").encode() if k == _NORMAL else b""
        for n, k in zip(pieces.names, pieces.kinds, strict=True)
    ]
    joined[pieces.unknown()] = " ⁇ ".encode()
    skip = 1 if pieces.prefix else 0

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        numbers = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
        out, at = [], 0
        for end in ends:
            raw = b"".join([joined[i] for i in numbers[at:end].tolist()])
            out.append((raw[skip:] if raw[:1] == b" " else raw).decode(errors="replace"))
            at = end
        return pa.array(out, type=pa.string())

    return decode


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids", frequent: int = FREQUENT) -> DataFrame:
    """Adds the ids of every whole text as ``array<int>``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, encoder(docs, pieces, text, frequent)(F.col(text)))


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return encoded.withColumn(out, decoder(pieces)(F.col(ids)))
