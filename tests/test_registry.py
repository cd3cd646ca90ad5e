"""Every registered query against its check SQL on the smallest tables, and rules for the plans."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alignframe.operators import equivalence, policy, rollouts
from alignframe.plans import fixtures as fx

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def canonical(columns, rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_check(spark, tiny, duck, name):
    got = entry.queries()[name](spark, tiny)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, want.fetchall())


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The optional operators and their pipeline have tests of their own.
    unchecked = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not n.startswith("op")}
    assert unchecked == set()


def test_flagship_entry(spark, tiny):
    rows = entry.entry(spark).groupBy("prompt_id").agg(F.abs(F.sum("advantage")).alias("s"), F.count("*").alias("n"))
    assert rows.count() > 0 and rows.where("s > 0.01 * n").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_columns_and_stay_in_the_jvm(spark, tiny):
    pairs = fx.formula_pairs(spark, tiny)
    queries = [
        rollouts.group_advantages(rollouts.combine_rewards(fx.rollouts(spark, tiny), {"reward_a": 1.0}), "prompt_id", "reward"),
        policy.clipped_objective(fx.token_stats(spark, tiny), beta=0.1),
        policy.high_entropy_mask(fx.token_stats(spark, tiny), 0.2),
        equivalence.logical_equivalence(pairs, equivalence.formula_similarity(pairs, method="edit")),
    ]
    for df in queries:
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text
        assert "Exchange SinglePartition" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "l_shipdate" not in text and "p_retailprice" not in text
