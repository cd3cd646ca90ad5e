"""Word codes, slices and components."""

import pyarrow as pa
import pytest

from alignframe.llm.common import WordCodes, components, ragged_take
from alignframe.llm.tokenfiles import gathered, pieces_of


@pytest.mark.parametrize("lower", [False, True])
def test_word_codes_of_slices(lower):
    texts = [None if i % 7 == 0 else "" if i % 5 == 0 else f" Wörd{i} É x{i % 3}\n\tABC  " for i in range(400)]
    array = pa.array([t or "" for t in texts]).slice(101, 150).cast(pa.large_string())
    codes = WordCodes(array, lower)
    for i, text in enumerate(texts[101:251]):
        words = [w.decode() for w in ((text or "").encode().lower() if lower else (text or "").encode()).split()]
        assert [codes.words[c] for c in codes.codes[codes.starts[i] : codes.starts[i + 1]]] == words


def test_batches_are_cut_and_joined_without_loss():
    rows = [{"n": i, "text": "x" * (i % 50) if i % 9 else None} for i in range(500)]
    batch = pa.RecordBatch.from_pylist(rows)
    for pieces in (pieces_of(batch, "text", 300), gathered(iter([batch.slice(0, 250), batch.slice(250)]), "text", 300)):
        assert [r for p in pieces for r in p.to_pylist()] == rows


def test_ragged_take():
    import numpy as np

    assert ragged_take(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = chain + star + [(5, 5), (7, 3), (3, 7), (7, 9), (None, 4), (4, None)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1000 for i in range(1000, 1300)} | {3: 3, 7: 3, 9: 3}
    assert got == want
    assert components(df.limit(0)).count() == 0
