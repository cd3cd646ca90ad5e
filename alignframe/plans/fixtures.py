"""Input tables in the shapes the operators expect, derived lazily from the given Parquet tables.

Expressions that Spark and DuckDB read alike are kept as SQL text, so that the check queries use the same inputs.
No fixture needs a rank over a whole table or over a group of unknown size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignframe.functions import logic
from alignframe.functions.text import hash_bucket, words
from alignframe.session import joined_rows, spread

ROLLOUTS = {
    "prompt_id": "l_orderkey",
    "part_id": "l_partkey",
    "supp_id": "l_suppkey",
    "line_no": "l_linenumber",
    "reward_a": "l_discount * 10",
    "reward_b": "case when l_returnflag = 'N' then cast('NaN' as double) else l_tax end",
}

TOKEN_STATS = {
    "seq_id": "l_orderkey",
    "pos": "l_linenumber",
    "part_id": "l_partkey",
    "batch_id": "l_orderkey % 16",
    "logp": "-(l_discount * 20 + l_tax * 5 + 0.05)",
    "old_logp": "-(l_discount * 19 + l_tax * 6 + 0.04)",
    "ref_logp": "-(l_discount * 18 + l_tax * 7 + 0.06)",
    "entropy": "l_quantity / 10 + l_tax",
    "mask": "case when l_linestatus = 'F' and l_linenumber % 2 = 0 then 0 else 1 end",
    "advantage": "cast(l_orderkey % 3 as double) - 1",
}

VERDICTS = {
    "idx": "cast(floor(o_orderkey / 2) as bigint)",
    "target": "case when o_orderkey % 2 = 0 then 'A' else 'B' end",
    "raw": """case substr(o_orderpriority, 1, 1)
        when '1' then '{"better_answer": "A"}' when '2' then '{"better_answer": "B"}'
        when '3' then '{"better_answer": "C"}' when '4' then '{"better_answer": "D"}'
        else '{"better_answer": ' end""",
    "short_raw": """case substr(o_orderpriority, 1, 1)
        when '1' then 'Output (a)' when '2' then 'Output (b)' when '3' then '(c)' else 'neither' end""",
}

JUDGED = {"idx": "cast(floor(o_orderkey / 2) as bigint)", "subset": "o_orderstatus"}


def _op(k: int) -> str:
    return f"substr('∧∨→↔⊕', cast(1 + (p_partkey + {k}) % 5 as int), 1)"


_G = [
    "replace(p_brand, '#', '') || '(x)'",
    "p_type || '(x)'",
    "'Size' || cast(p_size as varchar(10)) || '(x, y)'",
    "'Heavy(y)'",
    "'big item(y)'",
    "'Q(z)'",
]
_B2 = f"{_G[0]} || ' ' || {_op(0)} || ' ' || {_G[1]}"
_B3 = f"'(' || {_B2} || ') ' || {_op(1)} || ' ¬' || {_G[2]}"
_B4 = f"'(' || {_B3} || ') ' || {_op(2)} || ' ' || {_G[3]}"
_B5 = f"'(' || {_B4} || ') ' || {_op(3)} || ' ¬(' || {_G[4]} || ' ' || {_op(4)} || ' ' || {_G[0]} || ')'"
_B6 = f"'(' || {_B5} || ') ' || {_op(0)} || ' ' || {_G[5]}"
_FLAT = f"{_G[0]} || ' ' || {_op(0)} || ' ' || {_G[1]} || ' ' || {_op(2)} || ' ' || {_G[2]}"

_BODY = f"""case when p_partkey % 7 = 0 then {_FLAT}
    when p_partkey % 5 = 0 then {_B2} when p_partkey % 5 = 1 then {_B3} when p_partkey % 5 = 2 then {_B4}
    when p_partkey % 5 = 3 then {_B5} else {_B6} end"""

# Two layers, since the prediction is an edit of the gold formula.
FORMULA_BODIES = {"pair_id": "p_partkey", "type_lit": _G[1], "brand_lit": _G[0], "body": _BODY}
FORMULA_PAIRS = {
    "pair_id": "pair_id",
    "gold": "'∀x ∃y (' || body || ')'",
    "pred": """case pair_id % 8
        when 0 then '∀x ∃y (' || body || ')'
        when 1 then '∀x (' || replace(body, type_lit, 'Kind(x)') || ')'
        when 2 then '∀x ∃y ¬(' || body || ')'
        when 3 then '∀x ∃y (' || replace(body, '∧', '∨') || ')'
        when 4 then '∀x (' || body || ') ∧'
        when 5 then repeat(body || ' ∧ ', 6) || body
        when 6 then '∀x (' || brand_lit || ')'
        else 'Odd(x) → (' || brand_lit || ' ∧ Even(x)) ∨ ¬Odd(x)' end""",
}

SUBSETS = ["harmless", "helpful", "online", "sampled"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {name}" for name, e in expressions.items()])


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "lineitem"), ROLLOUTS)


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(table(spark, sf_dir, "lineitem"), TOKEN_STATS)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of every question."""
    return _derive(table(spark, sf_dir, "orders"), VERDICTS)


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions divisible by 50 got no answer, so that the rates have invalid rows to count."""
    return verdicts(spark, sf_dir).where("idx % 50 <> 0")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that were judged, with their subset."""
    return _derive(table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0"), JUDGED)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve token ids per completion, 0 being the end mark."""
    ids = F.array(*[(F.col("l_partkey") * (i + 3) + F.col("l_suppkey")) % 17 for i in range(12)])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("line_no"), ids.alias("ids"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def pref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as two responses; a response without a label has no safety flag."""
    docs = _labelled(spark, sf_dir).withColumn("pair_id", F.expr("doc_id div 2"))
    side = lambda k: docs.where(F.col("doc_id") % 2 == k).select(
        "pair_id",
        F.col("text").alias(f"response_{k}"),
        (F.col("toxic") == 0).alias(f"is_response_{k}_safe"),
        F.coalesce("quality", F.lit(0)).alias(f"_q{k}"),
        F.coalesce("toxic", F.lit(0)).alias(f"_t{k}"),
        *([F.col("lang")] if k == 0 else []),
    )
    items = table(spark, sf_dir, "benchmark")
    size = items.agg(F.count(F.lit(1))).scalar()
    pairs = side(0).join(side(1), "pair_id").withColumn("item_id", F.pmod("pair_id", size))
    return pairs.join(items.select("item_id", F.col("text").alias("prompt")), "item_id").select(
        "pair_id",
        "lang",
        "prompt",
        "response_0",
        "response_1",
        F.when(F.col("_q1") > F.col("_q0"), 1).otherwise(0).alias("better_response_id"),
        F.when(F.col("_t1") < F.col("_t0"), 1).otherwise(0).alias("safer_response_id"),
        "is_response_0_safe",
        "is_response_1_safe",
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per conversation, as one text. Conversations 1, 9, 17, ... keep a leading system turn.

    The rejected side closes with the last answer of the next conversation.
    """
    turns = table(spark, sf_dir, "conversations")
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.array_agg(F.struct("turn", "role", "text"))).alias("_turns")
    )
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("_answer")
    ).select((F.col("conv_id") - 1).alias("conv_id"), "_answer")
    spell = lambda t: F.concat(
        F.when(t["role"] == "user", F.lit("\n\nHuman: ")).otherwise(F.lit("\n\nAssistant: ")), t["text"]
    )
    spoken = F.transform(F.filter("_turns", lambda t: t["role"] != "system"), spell)
    opening = F.get(F.filter("_turns", lambda t: t["role"] == "system"), F.lit(0))["text"]
    lead = F.when(F.col("conv_id") % 8 == 1, F.coalesce(opening, F.lit(""))).otherwise(F.lit(""))
    earlier = F.slice("_spoken", F.lit(1), F.greatest(F.size("_spoken") - 1, F.lit(0)))
    return (
        gathered.withColumns({"_spoken": spoken, "_lead": lead})
        .join(answers, "conv_id", "left")
        .select(
            "conv_id",
            F.get(F.array(*map(F.lit, SUBSETS)), (F.col("conv_id") % 4).cast("int")).alias("subset"),
            F.concat("_lead", F.array_join("_spoken", "")).alias("chosen"),
            F.concat(
                "_lead", F.array_join(earlier, ""), F.lit("\n\nAssistant: "), F.coalesce("_answer", F.lit("No."))
            ).alias("rejected"),
        )
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage, whole, as claim. Passages are shorter and longer than 200 characters."""
    faithful = F.when(F.col("quality") == 1, "faithful").otherwise("unfaithful")
    items = table(spark, sf_dir, "benchmark")
    size = items.agg(F.count(F.lit(1))).scalar()
    docs = _labelled(spark, sf_dir).withColumn("item_id", F.pmod("doc_id", size))
    return docs.join(items.select("item_id", F.col("text").alias("claim")), "item_id").select(
        "doc_id", F.col("text").alias("document"), "claim", faithful.alias("label")
    )


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents as source and reference."""
    docs = table(spark, sf_dir, "documents").withColumn("pair_id", F.expr("doc_id div 2"))
    side = lambda k, name: docs.where(F.col("doc_id") % 2 == k).select("pair_id", F.col("text").alias(name))
    return side(0, "src").join(side(1, "ref"), "pair_id")


def token_pairs(spark: SparkSession, sf_dir: str, tokens: Callable[[str], Column] = words) -> DataFrame:
    """Hypothesis and reference tokens of the text pairs, with a direction and a batch."""
    return bitext(spark, sf_dir).select(
        "pair_id",
        F.when(F.col("pair_id") % 2 == 0, "forward").otherwise("backward").alias("direction"),
        F.expr("pair_id div 16").alias("batch_id"),
        tokens("src").alias("hyp"),
        tokens("ref").alias("ref"),
    )


def formula_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Reading formulas is heavy and parts are short rows, a file of which is read by one task.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    built = _derive(spread(parts, *parts.columns), FORMULA_BODIES)
    row = F.struct(*[F.expr(e).alias(name) for name, e in FORMULA_PAIRS.items()])
    # inline() keeps a filter on a formula from building the formula once more.
    return built.select(F.inline(F.array(row)))


def literal_vectors(spark: SparkSession, sf_dir: str, read: DataFrame | None = None) -> DataFrame:
    """Every literal of the formula pairs, or of pairs that are ``read`` already, with a given vector chosen by hash."""
    if read is None:
        sides = formula_pairs(spark, sf_dir).select(logic.literals("gold").alias("g"), logic.literals("pred").alias("p"))
    elif "_lits_gold" in read.columns:
        sides = read.select(F.col("_lits_gold").alias("g"), F.col("_lits_pred").alias("p"))
    else:
        sides = read.where("_fits").select(F.col("_gold_read.lits").alias("g"), F.col("_pred_read.lits").alias("p"))
    names = sides.select(F.explode(F.array_union("g", "p")).alias("literal")).distinct()
    vectors = table(spark, sf_dir, "embeddings")
    size = vectors.agg(F.count(F.lit(1))).scalar()
    numbered = names.withColumn("vec_id", F.pmod(hash_bucket("literal", 0, 1 << 32), size))
    return joined_rows(numbered, vectors.select("vec_id", "embedding"), "vec_id").select("literal", "embedding")
