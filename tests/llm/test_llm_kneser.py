"""The bigram model against a direct implementation over dictionaries."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from alignframe.llm import kneser
from alignframe.llm.common import crc_mod

START, END = "\0start", "\0end"


def sequence(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def brute(train, texts):
    pairs, words = Counter(), Counter()
    for t in train:
        seq = sequence(t)
        words.update(seq)
        pairs.update(zip([START, *seq], seq))
    total, types = sum(words.values()), len(words)
    context, kinds, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, v), n in pairs.items():
        context[u] += n
        kinds[u][min(n, 3) - 1] += 1
        before[v] += 1

    def cuts(values):
        n = [sum(1 for x in values if x == k) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [
            1 - 2 * y * n[1] / n[0] if n[0] else 0.5,
            2 - 3 * y * n[2] / n[1] if n[1] else 1.0,
            3 - 4 * y * n[3] / n[2] if n[2] else 1.5,
        ]
        return [min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1)]

    d2, d1 = cuts(pairs.values()), cuts(before.values())
    all_before = sum(before.values())
    spare = sum(d1[min(n, 3) - 1] for n in before.values())

    def p1(v):
        if not train:
            return 1.0
        n = before.get(v, 0)
        return (n - (d1[min(n, 3) - 1] if n else 0)) / all_before + spare / all_before / (types + 1)

    def p2(u, v):
        if not context.get(u):
            return p1(v)
        n = pairs.get((u, v), 0)
        weight = sum(d * k for d, k in zip(d2, kinds[u])) / context[u]
        return (n - (d2[min(n, 3) - 1] if n else 0)) / context[u] + weight * p1(v)

    out = []
    for t in texts:
        seq = sequence(t)
        out.append((
            len(seq), sum(words.get(w, 0) > 0 for w in seq), total,
            sum(math.log10((words.get(w, 0) + 1) / (total + types + 1)) for w in seq),
            sum(math.log10(p2(u, v)) for u, v in zip([START, *seq], seq)),
        ))
    mass = sum(p2(next(iter(context)), v) for v in words) + p2(next(iter(context)), "\0new") if train else 1.0
    return out, mass


def compare(spark, rows, parts):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    held = crc_mod(F.col("doc_id"), 7) == 2
    model = kneser.train(docs.where(~held), parts=parts)
    got = {r["doc_id"]: r for r in kneser.score(docs, model, F.col("text"), [F.col("doc_id"), held.alias("held_out")]).collect()}
    out = {i: crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows}
    want, mass = brute([t for i, t, _ in rows if not out[i]], [t for _, t, _ in rows])
    assert mass == pytest.approx(1)
    assert len(got) == len(rows)
    for (i, *_), w in zip(rows, want):
        r = got[i]
        assert r["held_out"] == out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6)
        assert r["score"] == pytest.approx(w[4], abs=1e-6)


def test_documents_match_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source").collect()]
    compare(spark, rows, 3)


def test_edge_cases_match_brute_force(spark):
    rows = [(0, None, "a"), (1, "", "a"), (2, "  \t", None), (3, "the the THE The é É", "a"), (4, "a b a b a b c", "b"), (5, "x", "b"),
            (6, "the a " * 500, "c"), (7, "new words here", "c"), (8, "a b a\u000bb", "c"), (None, "the b", "d")]
    compare(spark, rows, 4)
    compare(spark, rows[:1], 2)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    model = kneser.train(docs.limit(0))
    row = kneser.score(docs, model, F.col("text"), [F.col("doc_id")]).first()
    assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (3, 0, 0.0, 0.0)
    assert kneser.score(docs.limit(0), model, F.col("text"), [F.col("doc_id")]).count() == 0


def test_blocks_round_trip():
    import numpy as np

    keys = np.array([0, 5, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    counts = np.array([1, 2, 3, 1 << 31])
    got = kneser.unpack(kneser.pack(keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()
