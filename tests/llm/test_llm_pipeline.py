"""The stages against direct versions of their decisions, and the registered queries' rows."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from alignframe.llm import mixing, quality, sentencepieces, simhash, toxicity
from alignframe.llm.queries import LLM_ORACLES, tokenizer_path


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    got = entry.queries()[name](spark, tiny)
    want = con.execute(LLM_ORACLES[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(got.columns) == names
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_stages_decide_as_their_operators(spark, tiny, docs):
    kept = docs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    ids = set(texts)
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, tiny)
        assert after.columns == docs.columns
        found = {r["doc_id"] for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(kept, labels)
            want = {i for i in ids if model.score(texts[i]) < 0.5}
        elif name == "quality":
            model = quality.fit(kept, labels)
            want = {i for i, s in zip(ids, model.scores(quality._matrix([texts[i] for i in ids]))) if s >= quality.THRESHOLD}
        else:
            prints = {i: simhash.fingerprint(texts[i]) & (2**64 - 1) for i in ids}
            want, left = set(), sorted(ids)
            while left:
                group, todo = {left[0]}, [left[0]]
                while todo:
                    near = {j for j in left if (prints[todo[-1]] ^ prints[j]).bit_count() <= 2} - group
                    todo.pop()
                    group |= near
                    todo += near
                want.add(min(group))
                left = [i for i in left if i not in group]
        assert found == want and after.count() == len(want)
        kept, ids = after, found
    mixed = mixing.mixed_documents(kept)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= ids
    encoded = corpus_pipeline.encode_pieces(spark, mixed, tiny).collect()
    assert len(encoded) == mixed.count()
    one = sentencepieces.UnitEncoder(sentencepieces.Pieces.read(tokenizer_path("piece_bpe_32k.model")))
    import re

    for r in encoded[:20]:
        text = "▁" + texts[r["doc_id"]].replace(" ", "▁")
        units = re.findall(sentencepieces.Pieces.read(tokenizer_path("piece_bpe_32k.model")).unit_pattern(), text)
        assert list(r["ids"]) == [i for u in units for i in one.numbers(one.symbols(u)).tolist()] and r["n_tokens"] == len(r["ids"])


def test_whole_run(spark, tiny, docs):
    rows = corpus_pipeline.run(spark, tiny)
    assert rows.count() > 0 and rows.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark, tiny, docs):
    schema = docs.schema
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the word here " * 9000, "en", "a", 9), (3, "the word here " * 9000, "en", "a", 9), (None, "no id", None, "b", 5)],
        schema,
    )
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, tiny)
            ids = sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
            if name != "sentencepiece":
                assert out.columns == docs.columns
            if table is not odd:
                assert ids == [], name
            elif name == "sentencepiece":
                assert ids == ["1", "2", "3", "3", "None"]
            elif name == "simhash":
                # The two empty texts are one group, the repeated row is one document, the one without id stays.
                assert ids == ["1", "3", "None"]
            elif name == "mixing":
                # Source a has all but two words: 1.5 times all, less what b takes twice, is one and a half of its rows.
                assert ids == ["3", "3", "None", "None"]
            else:
                # The one labelled document is good and not toxic, so nothing speaks against any.
                assert ids == ["1", "2", "3", "3", "None"], name


def test_one_document_stays_of_each_group(spark, tiny):
    """Ids that repeat, copies without an id, columns with names that operators use."""
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (7, base, "a", 1), (5, base, "a", 2), (None, base, "a", 3), (5, "another text of its own", "b", 4),
        (5, "another text of its own", "b", 4), (5, "another text of its own", "a", 5), (None, "only without an id here", "a", 6),
        (None, "only without an id here", "a", 7), (8, "wholly different words stand here", None, 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, h int").selectExpr("*", "h AS doc", "h AS row", "h AS key", "h AS fp")
    once, again = (corpus_pipeline.one_of_each_group(spark, docs, tiny) for _ in range(2))
    assert once.columns == docs.columns
    kept = [tuple(r) for r in once.collect()]
    assert sorted((str(r[0]), r[1][:8]) for r in kept) == [("5", "another "), ("5", base[:8]), ("8", "wholly d"), ("None", "only wit")]
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in again.collect())


def test_import_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; assert 'pipeline' in e.queries() and 'op1_sentencepiece' in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=root, check=True, timeout=120)
