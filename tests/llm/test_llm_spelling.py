"""Spelling variants against all edits of every word."""

import random
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
from alignframe.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, key string, id int"


def documents(spark, rows):
    """Extra columns bear names that the operator uses inside."""
    return spark.createDataFrame([(i, t, "w", 1, "k", 2) for i, t in rows], SCHEMA)


def brute(rows, damage=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + a + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for a in letters}
        found = {v for v in edits if v in n and v != w}
        best = min(found, key=lambda v: (-n[v], v), default=None)
        near[w], form[w] = len(found), best if best and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], near[w], n.get(form[w])))
    return rows


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("aabÀ") for _ in range(rng.randrange(4, 8))) + rng.choice("ÿ×é") for _ in range(150)]
    # The first words are the most frequent ones.
    rows = [(rng.choice([None, i, 5]), " ".join(words[int(150 * rng.random() ** 4)] + rng.choice(["", ",", "1", "日"]) for _ in range(120))) for i in range(30)]
    long = "ab" * 40 + "c"
    rows += [(i, f"{long} {long[:9]}{long[10:]} {long}a {long[:30]}z{long[31:]}") for i in range(5)]
    rows += [(10, f"{long} " * 8), (8, None), (7, ""), (6, "1 2"), (9, "Aaaaa aaaaa AAAAA aaaaaa Aaaaaa aaaaaA ÉÉÉÉÉ ééééé ééééé ééééé"), (9, "Aaaaa")]
    return rows


def test_variants_equal_all_edits(spark):
    rows = odd_rows()
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(len(r[0]) > 80 and r[1] for r in want)
    assert found(spelling.variants(documents(spark, rows))) == want
    # Every word by hashes instead of rotations; more damage; many pieces.
    assert found(spelling.variants(documents(spark, rows), long_word=0)) == want
    assert found(spelling.variants(documents(spark, rows), damage=3)) == brute(rows, 3)


def test_pieces_of_long_texts_end_between_words(monkeypatch, spark):
    monkeypatch.setattr(spelling, "_TEXT_PIECE", 7)
    text = "Àbcÿ,defgh日ijkl mnopqrstuvwxyz ã"
    assert [w for part in spelling._runs(text) for w in part] == [w.encode() for w in re.findall("[a-zÀ-ÿ]+", text)]


def test_very_long_runs_and_empty_tables(spark):
    rows = [(i, "a" * 20000 + " " + "a" * 19999) for i in range(3)] + [(i, "a" * 20000) for i in range(3, 9)]
    got = {(len(r["word"]), r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(documents(spark, rows), damage=0).collect()}
    assert got == {(20000, 9, 1, None), (19999, 3, 1, 9)}
    assert spelling.variants(documents(spark, rows).limit(0)).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "abcd "), (None, "")])).count() == 0


def test_query_over_all_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert found(entry.queries()["op12_spelling"](spark, tiny)) == brute(rows)
