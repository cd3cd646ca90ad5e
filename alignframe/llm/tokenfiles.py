"""Token ids in binary files, compressed by a grammar.

Documents are range-partitioned and sorted by id; every task writes its documents as shards of some million ids. A shard is
compressed by Re-Pair: frequent pairs of ids become new symbols, again and again until no pair is met ``LEAST_COUNT`` times, so
a shard is a short sequence of symbols and a list of rules. The expansion length of every rule is stored, so that any run of ids can be decoded by
itself: sums of lengths tell where it starts. Pairs never reach over a document's end.

File layout (little-endian): ``RPT1``, four 64-bit counts (documents, rules, symbols, first rule's number), then per
document: has an id (1 byte), id (8), first symbol (8), ids (8); per rule: two symbols (4 + 4), expansion length (4); then the
symbols, 2 bytes each while they fit, else 3 or 4.

A null text is an empty one and holds the end mark only. Documents without an id come first; those with equal ids are in
order of a hash of their texts and of the texts. An empty table makes no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alignframe.llm.common import ragged_take, stored, tasks, write_file
from alignframe.session import fresh_path

END_ID = 1
SHARD_IDS = 1 << 21
LEAST_COUNT = 16
_SLOTS = 20
_BATCH_BYTES = 8 << 20
_REMEMBERED = 500_000
_WORDS_A_CALL = 4096
# Letters that stay one letter in lower case and in normal form; marks without apostrophes and parts of special tokens.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:;=>?@\[-`{}~]"
_HEADER = struct.Struct("<4s4q")


def compress(ids: np.ndarray, first: int, end_id: int = END_ID, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """``symbols, rules``. Rule k is symbol ``first + k`` and stands for two symbols with smaller numbers.

    Rounds go on until no pair occurs ``least`` times. Each takes many pairs at once, the most frequent first. A symbol is the
    left part of a round's rules or the right part of them, not both, so no two pairs overlap and all of them can be
    replaced in one pass; a pair of equal symbols shares its symbol with no other pair, and of a run every second place is
    replaced. Of two pairs with one hash the rarer one waits for the next round.
    """
    seq, rules, made = ids.astype(np.uint32), [np.zeros((0, 2), dtype=np.uint32)], 0
    live = np.arange(max(len(seq) - 1, 0))
    rule_of = np.empty(1 << _SLOTS, dtype=np.int32)
    while True:
        live, slots, pairs = _frequent(seq, live, end_id, least)
        if not len(pairs):
            return seq, np.concatenate(rules)
        lefts, rights, chosen = set(), set(), []
        for x, y in pairs.tolist():
            if x in rights or y in lefts or (x == y and (x in lefts or x in rights)):
                continue
            lefts.add(x)
            rights.add(y)
            chosen.append((x, y))
        new = np.array(chosen, dtype=np.uint32)
        new = new[np.sort(np.unique(_slots(new[:, 0], new[:, 1]), return_index=True)[1])]
        rule_of.fill(-1)
        rule_of[_slots(new[:, 0], new[:, 1])] = np.arange(len(new))
        rule = rule_of[slots]
        some = np.flatnonzero(rule >= 0)
        at, rule = live[some], rule[some]
        hit = (seq[at] == new[rule, 0]) & (seq[at + 1] == new[rule, 1])
        at, rule = at[hit], rule[hit]
        # Neighbouring places occur inside runs of one symbol only: every second one of them counts.
        head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        even = (np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))) % 2 == 0
        at, rule = at[even], rule[even]
        seq[at] = first + made + rule
        rules.append(new)
        made += len(new)
        # A pair that is rare stays rare; only places beside a new symbol hold other pairs than before.
        beside, keep = np.zeros(len(seq), dtype=bool), np.ones(len(seq), dtype=bool)
        beside[live], beside[at], beside[at[at > 0] - 1] = True, True, True
        keep[at + 1] = False
        seq, live = seq[keep], np.flatnonzero(beside[keep])
        live = live[live < len(seq) - 1]


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _SLOTS)


def _frequent(seq: np.ndarray, at: np.ndarray, end_id: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places ``at``: those that may hold a pair met ``least`` times, ends aside, their hashes, and such pairs,
    most frequent first.

    Hashes leave out most rare pairs, the others are counted exactly. A run counts with its overlapping places.
    """
    a, b = seq[at], seq[at + 1]
    slots = _slots(a, b)
    kept = np.flatnonzero((np.bincount(slots, minlength=1 << _SLOTS) >= least)[slots] & (a != end_id) & (b != end_id))
    keys = np.sort((a[kept].astype(np.int64) << 32) | b[kept])
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(heads, append=len(keys))
    order = np.argsort(-counts, kind="stable")
    found = keys[heads[order[: np.count_nonzero(counts >= least)]]]
    return at[kept], slots[kept], np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    lengths: list[int] = []
    of = lambda s: 1 if s < first else lengths[s - first]
    for x, y in rules.tolist():
        lengths.append(of(x) + of(y))
    return np.array(lengths, dtype=np.uint32)


def _width(symbols: int) -> int:
    """Bytes of a symbol in a file with so many different ones."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


class Shard:
    """A file's content, decoded as far as it is asked for."""

    def __init__(self, blob: bytes):
        magic, docs, rules, symbols, self.first = _HEADER.unpack_from(blob)
        if magic != b"RPT1":
            raise ValueError("not a token file")
        at = _HEADER.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        self.has_id, self.doc_id = take("<u1", docs), take("<i8", docs)
        self.doc_symbol, self.doc_ids = take("<i8", docs), take("<i8", docs)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        width = _width(self.first + rules)
        self.symbols = np.zeros((symbols, 4), dtype=np.uint8)
        self.symbols[:, :width] = take("<u1", symbols * width).reshape(symbols, width)
        self.symbols = self.symbols.reshape(-1).view("<u4")
        # Every symbol's ids one after the other; a symbol below ``first`` is its own id.
        parts: list[np.ndarray] = []
        of = lambda s: np.array([s], dtype=np.uint32) if s < self.first else parts[s - self.first]
        for x, y in self.rules.tolist():
            parts.append(np.concatenate([of(x), of(y)]))
        self.flat = np.concatenate([np.arange(self.first, dtype=np.uint32), *parts])
        self.size = np.concatenate([np.ones(self.first, dtype=np.int64), self.lengths.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size

    def ids(self, symbols: np.ndarray | None = None) -> np.ndarray:
        symbols = self.symbols if symbols is None else symbols
        return self.flat[ragged_take(self.start[symbols], self.size[symbols])]

    def document(self, n: int) -> np.ndarray:
        end = self.doc_symbol[n + 1] if n + 1 < len(self.doc_symbol) else len(self.symbols)
        return self.ids(self.symbols[self.doc_symbol[n] : end])

    def run(self, start: int, count: int) -> np.ndarray:
        """Ids ``start .. start + count`` of the shard; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.size[self.symbols])
        first, last = np.searchsorted(ends, [start, start + count - 1], side="right")
        before = ends[first - 1] if first else 0
        return self.ids(self.symbols[first : last + 1])[start - before : start - before + count]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    """The file of a shard; ``counts`` are the documents' numbers of ids."""
    symbols, rules = compress(ids, first)
    lengths = rule_lengths(rules, first)
    sizes = np.concatenate([np.ones(first, dtype=np.int64), lengths.astype(np.int64)])
    ends = np.cumsum(sizes[symbols])
    starts = np.searchsorted(ends, np.cumsum(counts) - counts, side="right")
    return b"".join([
        _HEADER.pack(b"RPT1", len(doc_ids), len(rules), len(symbols), first),
        np.array([d is not None for d in doc_ids], dtype="<u1").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        starts.astype("<i8").tobytes(), counts.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : _width(first + len(rules))].tobytes(),
    ])


class TextEncoder:
    """Ids of whole texts by a tokenizer that splits at white space: each distinct part of a word is encoded once.

    Such a tokenizer lowers letters and cuts them from marks. So a word of plain letters with plain marks behind falls
    into two parts that recur in many words; any other word is a part of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # Parts met lately and their ids as bytes.
        self.parts = pa.array([], type=pa.large_string())
        self.ids = pa.array([], type=pa.large_binary())

    def _ids_of_parts(self, parts: pa.Array) -> pa.Array:
        at = pc.index_in(parts, value_set=self.parts)
        missing = parts.filter(pc.is_null(at)).to_pylist()
        blobs: list[bytes] = []
        for i in range(0, len(missing), _WORDS_A_CALL):
            # A call's results take far more memory than the ids in them.
            call = self.tokenizer.encode_batch_fast(missing[i : i + _WORDS_A_CALL], add_special_tokens=False)
            blobs += [array("I", e.ids).tobytes() for e in call]
        places = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = len(self.parts) + np.arange(len(missing))
        self.parts = pa.concat_arrays([self.parts, pa.array(missing, type=pa.large_string())])
        self.ids = pa.concat_arrays([self.ids, pa.array(blobs, type=pa.large_binary())])
        found = self.ids.take(pa.array(places))
        if len(self.parts) > _REMEMBERED:
            # What the last texts used stays.
            kept = pa.array(np.unique(places))
            self.parts, self.ids = self.parts.take(kept), self.ids.take(kept)
        return found

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        simple = pc.match_substring_regex(words, f"^{_LETTERS}+{_MARKS}*$")
        plain, other = words.filter(simple), words.filter(pc.invert(simple))
        heads = pc.utf8_lower(pc.replace_substring_regex(plain, f"{_MARKS}+$", ""))
        tails = pc.replace_substring_regex(plain, f"^{_LETTERS}+", "")
        coded = pa.concat_arrays([heads, tails, other]).dictionary_encode()
        ids = self._ids_of_parts(coded.dictionary)
        codes, n = coded.indices.to_numpy(), len(plain)
        of = lambda which: ids.take(pa.array(which))
        both = pc.binary_join_element_wise(of(codes[:n]), of(codes[n : 2 * n]), pa.scalar(b"", pa.large_binary()))
        is_simple = simple.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(is_simple), np.flatnonzero(~is_simple)])] = np.arange(len(words))
        return pa.concat_arrays([both, of(codes[2 * n :])]).take(pa.array(place))

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """``counts, ids`` with the end mark behind every text."""
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets, dtype=np.int64)[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        # White space at either end of a text leaves an empty word there, which has no ids.
        blobs = pa.concat_arrays([self._ids_of_words(coded.dictionary), pa.array([array("I", [end_id]).tobytes()], type=pa.large_binary())])
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(blobs) - 1)
        taken = blobs.take(pa.array(codes))
        bounds = np.frombuffer(taken.buffers()[1], dtype="<i8")[1 : len(taken) + 1] // 4
        ids = np.frombuffer(taken.buffers()[2], dtype="<u4", count=int(bounds[-1]) if len(bounds) else 0)
        return np.diff(bounds[ends + np.arange(len(ends))], prepend=0), ids


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """This worker's encoder; its vocabulary and the words it remembers serve one task after the other."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, however they come."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield from pieces_of(pa.concat_batches(held), column, limit)
            held, size = [], 0
    if held:
        yield from pieces_of(pa.concat_batches(held), column, limit)


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(int(np.searchsorted(sizes, before + limit, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                 shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids and return ``shard, ids``, one row per file, as a stored table.

    ``tokenizer`` is the path of a vocabulary file that splits at white space. A file's name gives its place in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        pending: list[tuple[list, np.ndarray, np.ndarray]] = []
        written = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal pending, written, held
            name = f"ids-{part:06d}-{written:06d}.rpt"
            ids = np.concatenate([p[2] for p in pending])
            blob = pack([d for p in pending for d in p[0]], np.concatenate([p[1] for p in pending]), ids, encoder.size)
            write_file(f"{folder}/{name}", blob)
            pending, written, held = [], written + 1, 0
            return pa.RecordBatch.from_pydict({"shard": [name], "ids": pa.array([len(ids)], type=pa.int64())})

        for piece in gathered(batches, "text", _BATCH_BYTES):
            counts, ids = encoder.encode(piece.column("text").cast(pa.large_string()), end_id)
            pending.append((piece.column("doc_id").to_pylist(), counts, ids))
            held += len(ids)
            if held >= shard_ids:
                yield flush()
        if pending:
            yield flush()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return stored(ordered.mapInArrow(run, "shard string, ids bigint"), "shards")


def read_shards(spark, folder: str, shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                shard = Shard(blob)
                raw, ends = shard.ids().astype("<u4").tobytes(), np.cumsum(shard.doc_ids)
                starts = ends - shard.doc_ids
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pd.array(shard.doc_id, dtype="Int64")
                ids[shard.has_id == 0] = pd.NA
                yield pd.DataFrame({
                    "shard": path.rpartition("/")[2], "doc_id": ids, "inside": starts, "n_tokens": shard.doc_ids, "ids_crc32": crcs,
                })

    # One row per file. A file holds millions of ids, so this order is over few rows.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpt").load(folder).select("path", "content")
    read = files.mapInPandas(run, "shard string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(placed, "shard").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents into ``folder`` (default: a fresh one in the shared folder) and read them back."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    shards = write_shards(docs, folder, tokenizer)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, folder, shards)
