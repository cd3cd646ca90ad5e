"""Interpolated modified Kneser-Ney bigram model: counted by Spark, kept as sorted arrays, mapped into workers' memory.

Words become numbers by their place in a sorted array of word hashes, and a bigram is one 64-bit key of two numbers. Spark
counts: each task counts the words or keys of its texts and sends sorted, delta-coded blocks to the parts they belong to, where blocks are
merged. A part is a range of the key space that holds an equal share of all training tokens; a word that a third
of all tokens follow is cut into many parts. Parts are files in the shared folder; scoring maps them and touches only what it looks up.

Base: p(v|u) = max(c(uv) - D, 0) / c(u) + b(u) p(v), and p(v) likewise from the number of different words before v, interpolated
with a uniform share for each known token and one for all unknown ones. D is D1, D2 or D3 by count 1, 2 or more, from the
counts of counts (Chen and Goodman 1998). The first word follows a start mark; every text ends with an end token.

Why two words: three-word keys of texts whose words hardly repeat in threes would make a model larger than the texts.

Null and empty texts consist of their end token. Repeated rows count as often as they occur. Without training rows every
probability is 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignframe.llm.common import WordCodes, local_path, stored, tasks, write_file
from alignframe.llm.tokenfiles import gathered, pieces_of
from alignframe.session import fresh_path

_SHIFT = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, compressed; planes of equal bytes compress best."""
    n = len(keys)
    deltas = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = deltas.view(np.uint8).reshape(n, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(n, 4).T.tobytes()
    return n.to_bytes(8, "little") + zlib.compress(planes, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, planes = int.from_bytes(blob[:8], "little"), zlib.decompress(blob[8:])
    deltas = np.frombuffer(planes[: 8 * n], dtype=np.uint8).reshape(8, n).T.copy().view("<u8").ravel()
    counts = np.frombuffer(planes[8 * n :], dtype=np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(deltas, dtype=np.uint64), counts.astype(np.int64)


def merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several blocks with their summed counts."""
    parts = [unpack(b) for b in blobs]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def hashes_of(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)


def save(uri: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    write_file(uri, out.getvalue())


def load(uri: str) -> np.ndarray:
    """The array, mapped where the shared folder is mounted; another store's file is read whole."""
    path = local_path(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that are not arrays.

    ``bounds`` delimit the word numbers of the vocabulary's parts; part ``i`` of the bigrams holds the keys from ``edges[i]`` on.
    """

    folder: str
    bounds: list[int]
    edges: list[int]
    tokens: int
    texts: int
    discounts: dict[str, list[float]]
    kinds: dict[str, float]

    @property
    def end(self) -> int:
        return self.bounds[-1]

    @property
    def start(self) -> int:
        return self.bounds[-1] + 1

    @property
    def types(self) -> int:
        """Distinct training tokens, the end token included."""
        return self.bounds[-1] + (self.texts > 0)


class Vocabulary:
    def __init__(self, model: Model):
        self.parts = len(model.bounds) - 1
        self.bounds = np.array(model.bounds, dtype=np.int64)
        self.hashes = [load(f"{model.folder}/words-{i:06d}.npy") for i in range(self.parts)]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words; -1 for unknown ones."""
        found, out = hashes_of(words), np.full(len(words), -1, dtype=np.int64)
        part = word_part(found, self.parts)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            known = self.hashes[p]
            if len(known):
                at = np.minimum(np.searchsorted(known, found[mine]), len(known) - 1)
                out[mine] = np.where(known[at] == found[mine], at + self.bounds[p], -1)
        return out


def word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of hashes, so their sizes are nearly equal."""
    return ((hashes >> _SHIFT) * np.uint64(parts) >> _SHIFT).astype(np.int64)


def _blocks(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One row per part with its block; ``part`` ascends with the keys."""
    parts, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(keys))
    blobs = [pack(keys[a:b], counts[a:b]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_pydict({"part": pa.array(parts.astype(np.int32)), "block": pa.array(blobs, type=pa.binary())})


_PIECE = 24 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[WordCodes]:
    for piece in gathered(batches, "text", _PIECE):
        yield WordCodes(piece.column("text").cast(pa.large_string()), lower=True)


def _vocabulary(texts: DataFrame, folder: str, parts: int) -> tuple[list[int], int, int]:
    """Write the sorted word hashes and their counts; return bounds, tokens and texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for codes in _texts(batches):
            n += len(codes.starts) - 1
            found, counts = hashes_of(codes.words), np.bincount(codes.codes, minlength=len(codes.words))
            order = np.argsort(found)
            order = order[counts[order] > 0]
            if len(order):
                yield _blocks(found[order], counts[order], word_part(found[order], parts))
        # Texts are counted along: a block of their own under part -1.
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1], type=pa.int32()), "block": pa.array([str(n).encode()], type=pa.binary())})

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        if part < 0:
            return pd.DataFrame({"part": [part], "words": [0], "tokens": [sum(int(b) for b in rows["block"])]})
        keys, counts = merge(rows["block"].tolist())
        save(f"{folder}/words-{part:06d}.npy", keys)
        save(f"{folder}/counts-{part:06d}.npy", counts)
        return pd.DataFrame({"part": [part], "words": [len(keys)], "tokens": [int(counts.sum())]})

    blocks = texts.mapInArrow(count, "part int, block binary")
    written = blocks.groupBy("part").applyInPandas(write, "part int, words bigint, tokens bigint")
    sizes = {r["part"]: (r["words"], r["tokens"]) for r in written.collect()}
    for part in range(parts):
        if part not in sizes:
            save(f"{folder}/words-{part:06d}.npy", np.zeros(0, dtype=np.uint64))
            save(f"{folder}/counts-{part:06d}.npy", np.zeros(0, dtype=np.int64))
    bounds = np.cumsum([0, *(sizes.get(p, (0, 0))[0] for p in range(parts))]).tolist()
    texts_seen = sizes.get(-1, (0, 0))[1]
    return bounds, sum(t for p, (_, t) in sizes.items() if p >= 0) + texts_seen, texts_seen


def _edges(model: Model, parts: int) -> list[int]:
    """First keys of bigram parts with nearly equal numbers of training tokens.

    Contexts come in order of their numbers, each as heavy as its count. An edge inside a heavy context falls at the
    matching share of its next words, whose numbers are as good as random.
    """
    goals = [model.tokens * i / parts for i in range(1, parts)]
    edges, before, at = [0], 0, 0
    for p in range(len(model.bounds) - 1):
        # One part of the vocabulary at a time.
        counts = load(f"{model.folder}/counts-{p:06d}.npy")
        running = np.cumsum(counts) + before
        while at < len(goals) and len(running) and goals[at] < running[-1]:
            i = int(np.searchsorted(running, goals[at], side="right"))
            share = 1 - (running[i] - goals[at]) / counts[i]
            edges.append((model.bounds[p] + i) << 32 | int(share * (model.end + 1)))
            at += 1
        before = running[-1] if len(running) else before
    for goal in goals[at:]:
        share = min((goal - before) / max(model.texts, 1), 1.0)
        edges.append(model.start << 32 | int(share * (model.end + 1)))
    return sorted(set(edges))


def _sequences(codes: WordCodes, numbers: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers with ends, the numbers of their contexts, and each text's first token."""
    words = numbers[codes.codes]
    tokens = np.insert(words, codes.starts[1:], model.end)
    first = codes.starts[:-1] + np.arange(len(codes.starts) - 1)
    before = np.concatenate([[model.start], tokens[:-1]])
    before[first] = model.start
    return tokens, before, first


def _bigrams(texts: DataFrame, model: Model) -> None:
    """Write the bigram parts, then per-word totals of contexts and predecessors; sets the discounts."""
    folder = model.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, edges = Vocabulary(model), np.array(model.edges, dtype=np.uint64)
        for codes in _texts(batches):
            tokens, before, _ = _sequences(codes, vocabulary.numbers(codes.words), model)
            keys, counts = np.unique(before.astype(np.uint64) << _SHIFT | tokens.astype(np.uint64), return_counts=True)
            yield _blocks(keys, counts, np.searchsorted(edges, keys, side="right") - 1)

    def slots(numbers: np.ndarray) -> np.ndarray:
        # Words by their part of the vocabulary, then the end and the start mark by themselves.
        return np.searchsorted(np.array([*model.bounds[1:], model.end + 1]), numbers, side="right")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge(rows["block"].tolist())
        save(f"{folder}/bigrams-{key[0]:06d}.npy", keys)
        save(f"{folder}/bigram-counts-{key[0]:06d}.npy", counts.astype(_narrow(counts)))
        out = [("kinds", -1, json.dumps([int((counts == k).sum()) for k in range(1, 5)]).encode())]
        # Contexts ascend; sums over those of this part.
        left = (keys >> _SHIFT).astype(np.int64)
        context, first = np.unique(left, return_index=True)
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        right, before = np.unique((keys & _LOW).astype(np.int64), return_counts=True)
        for kind, number, columns in (("contexts", context, sums), ("predecessors", right, [before])):
            slot = slots(number)
            for s in np.unique(slot):
                mine = slot == s
                block = np.stack([number[mine], *(c[mine] for c in columns)])
                out.append((kind, int(s), zlib.compress(block.astype("<i8").tobytes(), 1)))
        return pd.DataFrame(out, columns=["kind", "slot", "block"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, slot = key
        if kind == "kinds":
            sums = np.sum([json.loads(bytes(b)) for b in rows["block"]], axis=0)
            return pd.DataFrame({"kind": [kind], "numbers": [sums.astype(float).tolist()]})
        low = model.bounds[slot] if slot < len(model.bounds) - 1 else model.end + slot - len(model.bounds) + 1
        size = model.bounds[slot + 1] - low if slot < len(model.bounds) - 1 else 1
        columns = 4 if kind == "contexts" else 1
        dense = np.zeros((columns, size), dtype=np.int64)
        for b in rows["block"]:
            block = np.frombuffer(zlib.decompress(b), dtype="<i8").reshape(columns + 1, -1)
            dense[:, block[0] - low] += block[1:]
        save(f"{folder}/{kind}-{slot:06d}.npy", dense)
        values = dense[0]
        seen = [int((values == k).sum()) for k in range(1, 5)] + [int((values >= 3).sum()), int(values.sum())]
        return pd.DataFrame({"kind": [kind], "numbers": [[float(x) for x in seen]]})

    blocks = texts.mapInArrow(count, "part int, block binary")
    written = stored(blocks.groupBy("part").applyInPandas(write, "kind string, slot int, block binary"), "bigram-sums")
    totals = written.groupBy("kind", "slot").applyInPandas(total, "kind string, numbers array<double>").collect()
    counted = np.sum([r["numbers"] for r in totals if r["kind"] == "kinds"], axis=0)
    seen = np.sum([r["numbers"] for r in totals if r["kind"] == "predecessors"], axis=0)
    model.discounts = {"bigram": discounts(counted[:4]), "word": discounts(seen[:4])}
    model.kinds = {"one": seen[0], "two": seen[1], "more": seen[4], "all": seen[5]}


def _narrow(counts: np.ndarray) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(t).max)


def discounts(kinds: np.ndarray) -> list[float]:
    """D1, D2, D3 from how many n-grams occur 1, 2, 3 and 4 times; a fixed half where these leave one undefined."""
    n1, n2, n3, n4 = (float(x) for x in kinds)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1)]


def train(texts: DataFrame, text: str = "text", folder: str | None = None, parts: int | None = None) -> Model:
    """Count the texts and write the model's arrays into ``folder`` (default: a fresh one in the shared folder)."""
    spark: SparkSession = texts.sparkSession
    folder, parts = folder or fresh_path(spark, "language-model"), parts or tasks(spark)
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds, tokens, seen = _vocabulary(rows, folder, parts)
    model = Model(folder, bounds, [0], tokens, seen, {}, {})
    if seen:
        model.edges = _edges(model, 2 * parts)
        _bigrams(rows, model)
    return model


class Scorer:
    """A worker's view of the model."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model)
        self.edges = np.array(model.edges, dtype=np.uint64)
        self.slots = np.array([*model.bounds[1:], model.end + 1])
        self.lows = np.array([*model.bounds[:-1], model.end, model.start])
        self.arrays: dict[str, np.ndarray | None] = {}

    def _array(self, name: str) -> np.ndarray | None:
        if name not in self.arrays:
            try:
                self.arrays[name] = load(f"{self.model.folder}/{name}.npy")
            except FileNotFoundError:
                # A part without any entry has no file.
                self.arrays[name] = None
        return self.arrays[name]

    def _per_number(self, kind: str, numbers: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((columns, len(numbers)), dtype=np.int64)
        slot = np.searchsorted(self.slots, numbers, side="right")
        for s in np.unique(slot[numbers >= 0]):
            mine = np.flatnonzero((slot == s) & (numbers >= 0))
            dense = self._array(f"{kind}-{s:06d}")
            if dense is not None:
                out[:, mine] = dense[:, numbers[mine] - self.lows[s]]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of tokens."""
        out = np.where(numbers == self.model.end, self.model.texts, 0)
        slot = np.searchsorted(self.slots, numbers, side="right")
        for s in np.unique(slot[(numbers >= 0) & (numbers < self.model.end)]):
            mine = np.flatnonzero((slot == s) & (numbers >= 0))
            out[mine] = self._array(f"counts-{s:06d}")[numbers[mine] - self.lows[s]]
        return out

    def bigrams(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), dtype=np.int64)
        known = np.flatnonzero((context >= 0) & (token >= 0))
        keys = context[known].astype(np.uint64) << _SHIFT | token[known].astype(np.uint64)
        part = np.searchsorted(self.edges, keys, side="right") - 1
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            stored_keys = self._array(f"bigrams-{p:06d}")
            if stored_keys is not None:
                at = np.minimum(np.searchsorted(stored_keys, keys[mine]), len(stored_keys) - 1)
                hit = stored_keys[at] == keys[mine]
                out[known[mine]] = np.where(hit, self._array(f"bigram-counts-{p:06d}")[at], 0)
        return out

    def word_probability(self, token: np.ndarray) -> np.ndarray:
        model = self.model
        if not model.texts:
            return np.full(len(token), 1.0)
        d, kinds = model.discounts["word"], model.kinds
        before = self._per_number("predecessors", token, 1)[0]
        spare = (d[0] * kinds["one"] + d[1] * kinds["two"] + d[2] * kinds["more"]) / kinds["all"]
        taken = np.array([0.0, *d])[np.minimum(before, 3)]
        return (before - taken) / kinds["all"] + spare / (model.types + 1)

    def probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        word = self.word_probability(token)
        if not self.model.texts:
            return word
        d = self.model.discounts["bigram"]
        count, (total, one, two, more) = self.bigrams(context, token), self._per_number("contexts", context, 4)
        known = np.maximum(total, 1)
        direct = (count - np.array([0.0, *d])[np.minimum(count, 3)]) / known
        weight = (d[0] * one + d[1] * two + d[2] * more) / known
        return np.where(total > 0, direct + weight * word, word)

    def texts(self, codes: WordCodes) -> dict[str, np.ndarray]:
        """``n_tokens, n_known, base_score, score`` of each text."""
        model = self.model
        numbers = self.vocabulary.numbers(codes.words)
        tokens, before, first = _sequences(codes, numbers, model)
        # Each distinct bigram of the batch is looked up once, in order of its key.
        keys, inverse = np.unique((before + 1).astype(np.uint64) << _SHIFT | (tokens + 1).astype(np.uint64), return_inverse=True)
        logs = np.log10(self.probability((keys >> _SHIFT).astype(np.int64) - 1, (keys & _LOW).astype(np.int64) - 1))
        by_word = np.append(self.counts(numbers), model.texts)
        codes_with_ends = np.insert(codes.codes, codes.starts[1:], len(numbers))
        base = np.log10((by_word + 1) / (model.tokens + model.types + 1))
        sums = lambda per_token: np.add.reduceat(per_token, first)
        return {
            "n_tokens": np.diff(np.append(first, len(tokens))),
            "n_known": sums((by_word[codes_with_ends] > 0).astype(np.int64)),
            "base_score": sums(base[codes_with_ends]),
            "score": sums(logs[inverse]),
        }


def score(docs: DataFrame, model: Model, text: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, then ``n_tokens, n_known, train_tokens, base_score, score`` of each whole text."""
    kind = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            parts = []
            for piece in pieces_of(pa.RecordBatch.from_arrays([batch], ["text"]), "text", _PIECE):
                found = scorer.texts(WordCodes(piece.column("text").cast(pa.large_string()), lower=True))
                parts.append(pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found)))
            yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct(
                [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    scored = docs.select(*keep, of(F.coalesce(text, F.lit(""))).alias("_s"))
    names = [c for c in scored.columns if c != "_s"]
    return scored.select(
        *names, "_s.n_tokens", "_s.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "_s.base_score", "_s.score"
    )
