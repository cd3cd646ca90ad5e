"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignframe.llm import crosspolytope, labelled, mixing, quality, sentencepieces, simhash, tokenfiles, topk, toxicity, warc
from alignframe.llm.queries import tokenizer_path

HARD = [
    "", None, " ", "a  b", "  lead", "trail  ", "x\ny\n\nz", "▁a", "日本語テキスト👍🏽", "a" * 5000, "<s></s><0x0A>", " \t tab",
    "é́" * 5, "l'été $$$ %%% foo@bar.com 12345678", "<|endoftext|>x", "don't I'll 's", "ΣΑΣ ΟΔΟΣ", "It’s 12345 a_b", "word " * 3000,
]


def documents(spark, rows):
    """Extra columns bear names that operators use inside."""
    return spark.createDataFrame(
        [(i, t, s, "x", i, "y") for i, t, s in rows],
        "doc_id bigint, text string, source string, fp string, size bigint, component string",
    )


# --- 1, SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces.read(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab  eth\n\rt▁é$%1日😀") for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts * 2)])
    coded = sentencepieces.decode(sentencepieces.encode(docs, pieces, frequent=50), pieces)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    rows = coded.select("doc_id", "ids", "decoded").collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        text = texts[r["doc_id"] % len(texts)] or ""
        assert list(r["ids"]) == library.encode(text)
        assert r["decoded"] == library.decode(list(r["ids"]))
    assert sentencepieces.encode(docs.limit(0), pieces).count() == 0


def test_lattice_folds_equal_the_unit_encoder(spark, pieces):
    units = ["▁", "▁the", "▁thanedble", "xyzé日", "▁▁▁▁", "▁aaaaaaaaaaaaaaaa", "q"]
    table = sentencepieces.piece_table(spark, pieces)
    for bpe in (True, False):
        own = sentencepieces.Pieces(pieces.names, pieces.scores, pieces.kinds, bpe, pieces.byte_fallback, pieces.prefix)
        encoder = sentencepieces.UnitEncoder(own)
        found = sentencepieces.unit_ids(spark.createDataFrame([(u,) for u in units], "unit string"), table, own).collect()
        assert {r["unit"]: list(r["pieces"]) for r in found} == {u: encoder.symbols(u) for u in units}


def test_long_units_merge_like_short_ones(pieces):
    encoder, rng = sentencepieces.UnitEncoder(pieces), random.Random(5)
    for _ in range(200):
        unit = "▁" + "".join(rng.choice("theraniodx") for _ in range(rng.randrange(1, 60)))
        assert encoder._merged(unit) == encoder._merged_long(unit)


# --- 2, mixing


def brute_mix(rows):
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(sizes), set(names), {}
    while open_:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * total[s] for s in full}
        open_ -= full
    return sizes, total, target


def brute_packets(rows, packet, total, target, room):
    """Words taken of every row: all packets of both copies of all queues, merged by finish time."""
    ahead, packets = {}, []
    def place(n):
        i, text, _ = rows[n]
        order = hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()
        return int(order[:8], 16) % 512, order, i is not None, i or 0, len((text or "").split())

    for n in sorted(range(len(rows)), key=place):
        _, text, s = rows[n]
        size = len((text or "").encode().split())
        for repeat in (0, 1):
            start = ahead.get(s, 0) + repeat * total[s]
            for at in range(0, size, packet or max(size, 1)):
                words = min(packet or size, size - at)
                packets.append(((start + at + words) / target[s], words, n))
        ahead[s] = ahead.get(s, 0) + size
    taken, sent = [0] * len(rows), 0
    for _, group in itertools.groupby(sorted(packets), key=lambda p: p[0]):
        group = list(group)
        sent += sum(words for _, words, _ in group)
        if sent > room:
            break
        for _, words, n in group:
            taken[n] += words
    return taken


def check_mix(spark, rows, packet):
    sizes, total, target = brute_mix(rows)
    room = math.floor(round(sum(target.values()), 3))
    for budget in (None, room // 3) if packet == 3 else (None,):
        got = mixing.mix(documents(spark, rows), packet=packet, budget=budget, slice_rows=500).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert packet or r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        want = brute_packets(rows, packet, total, target, room if budget is None else budget)
        assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((i or -1, n, t) for (i, *_), n, t in zip(rows, sizes, want))
        if budget is None and packet:
            assert all(abs(taken[s] - target[s]) <= packet * (len(target) + 1) for s in taken)
            assert room - packet * len(target) <= sum(taken.values()) <= room
    if packet == 3:
        again = mixing.mix(documents(spark, rows), packet=packet, budget=budget).collect()
        assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "c", "d", None, ""])) for i in range(300)]
    for packet in (mixing.PACKET, 3, None):
        check_mix(spark, rows, packet)
    check_mix(spark, [(1, "x y", "a"), (1, "x y", "a"), (None, None, None), (3, "", "z"), (4, "w " * 20000, "b")], mixing.PACKET)


def test_the_merged_order_ends_the_mix(spark, monkeypatch):
    """With the whole budget, too, the cut falls inside the merged queues."""
    ends = []
    find = mixing._finish_time_at
    monkeypatch.setattr(mixing, "_finish_time_at", lambda *a: ends.append(find(*a)) or ends[-1])
    rows = [(i, "w " * (i % 90), "abc"[i % 3]) for i in range(300)]
    mixing.mix(documents(spark, rows)).collect()
    assert len(ends) == 1 and 0.9 < ends[0] < 1.1


def test_mix_budget_and_empty_table(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)]
    for packet in (5, None):
        taken = sum(r["taken"] for r in mixing.mix(documents(spark, rows), budget=300, packet=packet, slice_rows=20).collect())
        assert 290 <= taken <= 300
    empty = documents(spark, rows).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(documents(spark, [(1, None, "a"), (2, " ", None)])).agg(F.sum("taken")).first()[0] == 0
    mixed = mixing.mixed_documents(documents(spark, rows))
    assert mixed.columns == documents(spark, rows).columns
    assert {r["count"] for r in mixed.groupBy("doc_id").count().collect()} <= {1, 2}


@pytest.mark.parametrize("broadcast", [0, mixing.BROADCAST_SOURCES])
def test_mixed_documents_are_the_copies_of_the_mix(spark, monkeypatch, broadcast):
    """Ids that repeat with other texts are documents of their own; columns may bear any name."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i // 3, 5]), "w " * rng.randrange(0, 30) + f"x{i}" * (i % 5 > 0), rng.choice(["a", "b", "c", None, ""])) for i in range(200)]
    docs = documents(spark, rows).selectExpr("*", "size AS doc", "size AS name", "size AS none", "size AS copy", "size AS lasts")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    size = lambda t: len(t.split())
    got = sorted(repr((r["doc_id"], r["source"], size(r["text"]))) for r in mixed.collect())
    want = [(r["doc_id"], r["source"], r["size"], r["copies"]) for r in mixing.mix(docs, packet=None).collect()]
    assert got == sorted(repr(w[:3]) for w in want for _ in range(w[3]))


# --- 3, exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 8).astype(float).tolist(), int(i) % 3 if i % 11 else None, "x") for i in range(400)]
    rows += [(500, None, 1, "x"), (600, [1.0, None] + [0.0] * 6, 1, "x"), (700, [math.nan] + [0.0] * 7, 1, "x"), (800, [math.inf] + [0.0] * 7, 1, "x"),
             (None, [1.0] * 8, 1, "x"), (401, [0.5] * 8, None, "x"), (402, [0.5] * 8, None, "x"), (900, [0.0] * 8, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, score string")
    good = {i: np.floor(np.array(v) * 1024).astype(int) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = [
        (q, n, i, s) for q in good if q % 100 == 0
        for n, (s, i) in enumerate(sorted(((int(good[q] @ good[i]), i) for i in good if i != q), key=lambda p: (-p[0], p[1]))[:10], 1)
    ]
    for seeds, block, slab in ((2, 64, 2), (1, 4096, 16)):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, seeds=seeds, block_ids=block, slab_blocks=slab, chunk_queries=2)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_travel_only_where_bounds_reach(spark):
    """Ten far apart groups, each with a label: however many chunks, a block goes to the chunks of its group."""
    rng = np.random.default_rng(4)
    centres = np.eye(10, 16) * 8
    rows = [(i, (centres[i % 10] + rng.normal(0, 0.05, 16)).tolist(), i % 10) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = np.floor(1024 * np.array([r[1] for r in rows])).astype(int)
    scores = whole @ whole.T
    want = {q: sorted((-int(scores[q, i]), i) for i in range(1200) if i != q)[:10] for q in range(0, 1200, 4)}
    copies = []
    for chunk_queries in (300, 30, 10):
        sent = []
        plain, topk._needed = topk._needed, lambda *args: sent.append(plain(*args)) or sent[-1]
        try:
            got = topk.top_k(df, F.col("vec_id") % 4 == 0, chunk_queries=chunk_queries, block_ids=400).collect()
        finally:
            topk._needed = plain
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert found == want
        copies.append(sent[0].count())
    # Queries of 15 best blocks, cut in two with the smallest chunks, need the three blocks of their group: at most 90 of 900 pairs.
    assert copies[0] <= 15 and copies[1] <= 45 and copies[2] <= 90


def test_search_of_odd_rows(spark):
    big = 2.0**50
    rows = [(0, [1.0, 2.0], 1), (0, [0.5, 9.0], 2), (100, [], 1), (200, [big, 1.0], 1), (201, [big, -1.0], 1), (202, [-big, 0.0], 1), (3, [], 1),
            (4, [1e300, 1.0], 1), (5, [3.0, 3.0], None), (5, [3.0, 3.0], None), (300, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("block", F.lit("x")).withColumn("width", F.lit(9))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    limit = (1 << 63) - 1
    whole = lambda v: [max(-limit - 1, min(limit, math.floor(1024 * x))) for x in v]
    want = []
    for q in (0, 200):
        own = min(whole(v) for i, v, _ in rows if i == q)
        scored = [(sum(a * b for a, b in zip(own, whole(v), strict=True)), i) for i, v, _ in rows if i != q and len(v) == 2]
        scored = sorted(((max(-limit - 1, min(limit, s)), i) for s, i in scored), key=lambda p: (-p[0], p[1]))
        want += [(q, n, i, s) for n, (s, i) in enumerate(scored, 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == want


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (30, 6))
    bound = topk.bounds(q, x.max(axis=0, keepdims=True), x.min(axis=0, keepdims=True))[:, 0]
    assert (bound >= (q @ x.T).max(axis=1)).all()


# --- 4, token files


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(1000 - i, t, None) for i, t in enumerate(HARD)] + [(None, "no id", None), (None, None, None), (7, "b", None), (7, "a", None), (7, "a", None)]
    got = tokenfiles.token_files(documents(spark, rows), path).orderBy("start").collect()
    assert len(got) == len(rows)
    ids_of = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    want = sorted(("" if i is None else f"{i:09d}", len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t, _ in rows)
    assert sorted(("" if r["doc_id"] is None else f"{r['doc_id']:09d}", r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r, before in zip(got, [None, *got]):
        assert r["start"] == at
        assert before is None or before["doc_id"] is None or before["doc_id"] <= r["doc_id"]
        at += r["n_tokens"]
    assert tokenfiles.token_files(documents(spark, rows).limit(0), path).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    words = [rng.integers(2, 500, n) for n in rng.integers(1, 6, 300)]
    docs = [np.append(np.concatenate([words[i] for i in rng.integers(0, 300, n)]), 1) for n in rng.integers(1, 300, 200)]
    docs += [np.array([1]), np.full(400, 9), np.array([5, 5, 5, 1])]
    ids, counts = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    blob = tokenfiles.pack([*range(len(docs) - 1), None], counts, ids, 500)
    shard = tokenfiles.Shard(blob)
    assert (shard.ids() == ids).all() and len(shard.rules) and len(shard.symbols) < len(ids)
    assert shard.has_id.tolist() == [1] * (len(docs) - 1) + [0]
    for n, d in enumerate(docs):
        assert (shard.document(n) == d).all()
    for start, count in ((0, 1), (17, 333), (len(ids) - 5, 5)):
        assert (shard.run(start, count) == ids[start : start + count]).all()
    assert (tokenfiles.rule_lengths(shard.rules, 500) == shard.lengths).all()


def replaced(symbols, rules, first):
    """Rules undone one by one, the last first."""
    seq = symbols.tolist()
    for k in reversed(range(len(rules))):
        seq = [t for s in seq for t in (rules[k].tolist() if s == first + k else [s])]
    return seq


def most_met(symbols, end=1):
    """The most frequent pair's count, taking every second place of a run."""
    met, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if end not in pair and not (pair[0] == pair[1] and last.get(pair) == i - 1):
            met[pair] = met.get(pair, 0) + 1
            last[pair] = i
    return max(met.values(), default=0)


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    copies = np.tile(np.append(rng.integers(2, 40_000, 200), 1), 3000)
    symbols, rules = tokenfiles.compress(copies, 40_000)
    assert len(symbols) == 6000 and len(rules) == 199
    run, _ = tokenfiles.compress(np.full(100_000, 9), 10)
    assert len(run) < 100
    runs = np.concatenate([np.append(np.full(n, rng.integers(2, 5)), 1) for n in rng.integers(0, 40, 300)])
    for ids, first in ((rng.integers(2, 30, 20_000), 30), (runs, 30), (np.full(33, 7), 30), (np.array([], dtype=int), 30)):
        symbols, rules = tokenfiles.compress(ids, first)
        assert replaced(symbols, rules, first) == ids.tolist()
        assert most_met(symbols.tolist()) < tokenfiles.LEAST_COUNT


@pytest.mark.parametrize("first", [500, 1 << 16, 1 << 24])
def test_symbols_of_any_width(first):
    ids = np.append(np.random.default_rng(2).integers(2, 500, 400), 1).astype(np.uint32)
    ids = np.tile(ids, 20)
    shard = tokenfiles.Shard(tokenfiles.pack([*range(20)], np.full(20, 401), ids, first))
    assert len(shard.rules) and (shard.document(7) == ids[:401]).all() and (shard.run(399, 300) == ids[399:699]).all()


# --- 5, near-duplicate vectors


def brute_vectors(rows):
    good = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[n] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a, b in itertools.combinations(good, 2)
             if rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    least = {}
    for n, r in enumerate(rows):
        least[find(n)] = min(least.get(find(n), r[0]), r[0]) if r[0] is not None else None
    degree = [sum(n in p for p in links) for n in range(len(rows))]
    return sorted((str(r[0]), degree[n], str(least[find(n)])) for n, r in enumerate(rows))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)] + [(0, rows[0][1], 0)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [math.nan] * 16, 0), (903, [1.0, None] * 8, 0), (904, rows[0][1], None),
             (905, rows[0][1][:8], 0), (906, [x * 1e30 for x in rows[0][1]], 0), (907, [x * 1e-30 for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, size int")
    for tile in (512, 16):
        got = crosspolytope.near_duplicates(df, tile=tile).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_vectors(rows)
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert crosspolytope.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = crosspolytope.hadamard(x)
    assert np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1)) and np.allclose(crosspolytope.hadamard(y), x)


@pytest.mark.parametrize("cosine, least", [(0.93, 0.998), (0.94, 0.999), (0.95, 0.9995)])
def test_buckets_find_pairs_near_the_threshold_in_64_dimensions(cosine, least):
    rng = np.random.default_rng(int(100 * cosine))
    x, away = rng.normal(size=(2, 20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    bx, by = crosspolytope.buckets(x), crosspolytope.buckets(y)
    met = (bx == by[:, :, :1]).any(axis=(1, 2)) | (by == bx[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= least


# --- 6 and 10, classifiers


def labelled_documents(spark, n=600):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120)))
        toxic, bad = i % 6 == 0, i % 5 == 1
        group = rng.choice(["women", "muslims", "immigrants", "people"]) if i % 2 else ""
        if toxic:
            # One group is named in toxic texts far more often than in others.
            text += f" you {rng.choice(['idiot', 'moron', 'scum'])} and {rng.choice(['muslims', 'muslims', 'women'])}"
        elif group:
            text += f" about {group if group != 'muslims' else 'people'}"
        if bad:
            text = " ".join(w + "%%%" for w in text.split()) if i % 2 else text.upper() + "!!!"
        rows.append((i, text, "s"))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where(labelled.crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(rows) > 50
    return sum((r["score"] >= threshold) == (r[label] == 1) for r in rows) / len(rows)


def test_toxicity_on_held_out_rows_and_group_names(spark):
    docs, labels = labelled_documents(spark)
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score"))
    assert accuracy(scored, labels, "toxic", 0.5) >= 0.97
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    neutral = "a long talk about {} in the town"
    spread = lambda m: max(abs(m.score(neutral.format(g)) - m.score(neutral.format("people"))) for g in ("women", "muslims", "immigrants"))
    assert spread(model) < 0.05 and spread(model) <= spread(plain)
    assert model.score(neutral.format("muslims")) < 0.5
    # The column and the model agree, on empty texts too.
    odd = documents(spark, [(1, None, "a"), (2, "", "a"), (3, "you idiot", "a"), (3, "you idiot", "a"), (4, "idiot " * 20000, "a")])
    got = {r["doc_id"]: r["score"] for r in odd.select("doc_id", toxicity.score(F.col("text"), model).alias("score")).collect()}
    assert got == {1: model.score(None), 2: model.score(""), 3: model.score("you idiot"), 4: model.score("idiot")}
    assert got[1] < 0.5


def test_rewritings_swap_one_family():
    swapped = toxicity.rewritings({"the", "muslims", "eat"})
    assert swapped and all({"the", "eat"} < w and "muslims" not in w and len(w) == 3 for w in swapped)
    assert {"the", "eat", "believers"} in swapped
    assert toxicity.rewritings({"the"}) == []


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_documents(spark)
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", quality.score(F.col("text"), model).alias("score"))
    assert accuracy(scored, labels, "quality", quality.THRESHOLD) >= 0.97
    odd = documents(spark, [(1, None, "a"), (2, "", "a"), (3, "w " * 50000, "a")])
    got = [r["score"] for r in odd.select(quality.score(F.col("text"), model).alias("score")).collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1]


def test_classifiers_without_training_rows(spark):
    docs, labels = labelled_documents(spark, 60)
    for none in (labels.limit(0), labels.where("doc_id = 1"), labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))):
        assert toxicity.fit(docs, none).score("anything") < 0.5
        assert quality.fit(docs, none).scores(np.zeros((1, 3)))[0] == quality.NO_EVIDENCE or none.count()
    model = quality.fit(docs.limit(0), labels)
    assert docs.limit(0).select(quality.score(F.col("text"), model)).count() == 0


def test_training_rows_are_bounded_and_repeatable(spark):
    docs, labels = labelled_documents(spark)
    twice = [labelled.training_rows(docs, labels, "toxic", 20) for _ in range(2)]
    ids = [sorted(r["doc_id"] for r in sample.collect()) for sample, _ in twice]
    assert ids[0] == ids[1] and len(ids[0]) == 40
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids[0])


# --- 7, SimHash


def brute_simhash(rows):
    import xxhash

    prints = []
    for _, text, _ in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            group[find(a)] = find(b)
    least = {}
    for n, (i, *_) in enumerate(rows):
        known = least.get(find(n))
        least[find(n)] = i if known is None else known if i is None else min(known, i)
    return sorted((str(i), f"{prints[n]:016x}", str(least[find(n)])) for n, (i, *_) in enumerate(rows))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(6)
    base = " ".join(rng.choice(["alpha", "beta", "Gamma", "délta", "eps"]) + str(rng.randrange(60)) for _ in range(400)).split()
    rows = [(i, t, None) for i, t in enumerate(HARD)]
    for i in range(160):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((1000 - i, " ".join(words), "s"))
    rows += [(2000, "one two", None), (2000, "one two", None), (None, "One\tTWO", None), (None, "lonely words without id here", None)]
    want = brute_simhash(rows)
    for long_list in (128, 1):
        got = simhash.near_duplicates(documents(spark, rows), long_list=long_list).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_long_and_short_lists_give_the_same_links(spark):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for s in seeds for _ in range(15)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from alignframe.llm.common import components

    found = [{r["node"]: r["component"] for r in components(simhash.links(df, n)).collect()} for n in (1000, 1)]
    assert found[0] == found[1] and found[0]


# --- 8, WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a.b/c", "x"), (2, "http://A.b/c", "x"), (3, None, None), (4, "http://www.z.org:8080/q?x=1", ""), (5, "bad url\r\nX: y", "é" * 10),
            (6, "http://a.b/c", "<html>\r\n\r\n" * 30000), (7, "http://[bad", "x"), (8, "https://a.b/c?d", "unique"), (1, "http://a.b/c", "x"), (None, "http://n/", "x")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id bigint, url string, html string, offset int")
    got = warc.archive(pages, F.timestamp_seconds(F.lit(100) - F.coalesce("page_id", F.lit(0)))).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = largest[html or ""]
        refers = top if i is not None and i != top else None
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", str(refers)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    history = sorted(got, key=lambda r: r["history_position"])
    assert [r["history_position"] for r in history] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured"], r["page_id"] or -1) for r in history]
    assert keys == sorted(keys)
    assert warc.archive(pages.limit(0), F.timestamp_seconds(F.lit(0))).count() == 0


def test_loser_tree_merges_runs_of_any_number():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(30), i) for _ in range(rng.randrange(0, 20))) for i in range(n)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/a?b=1") == "org,example)/a?b=1"
    assert warc.url_key("https://x.y.z:8443") == "z,y,x:8443)/"
    assert warc.url_key(None) == ""
