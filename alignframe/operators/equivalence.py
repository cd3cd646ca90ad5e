"""Logical equivalence of formula pairs: match literals, enumerate bindings, compare truth tables."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.functions import logic
from alignframe.functions.binding import BindingSearch, truth_table
from alignframe.functions.text import let
from alignframe.operators.overlap import batch_weighted_bleu, sentence_bleu
from alignframe.operators.skew import lookup
from alignframe.session import cut, joined_rows, reachable, spread

# A 64-bit mask covers six variables; 2^12 blocks, so 18 variables, make one unit of work.
_MASK_VARIABLES = 6
_BLOCK_BITS = 12
# Assignments of so many repeated variables are enumerated without further ado, and of so many if a diagram grows too wide.
_FEW_REPEATED = 8
_MAX_REPEATED = 24
# Nodes of one layer of a decision diagram.
_DIAGRAM_WIDTH = 1024
# Ways to settle double claims that one task lists of a pair.
_BINDINGS_PER_PIECE = 1024


def formula_tokens(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(
        {"tokens": logic.tokens(column), "normalized": logic.normalized(column)}
    )


def hoist_quantifiers(df: DataFrame, column: str, out: str = "hoisted") -> DataFrame:
    return df.withColumn(out, logic.hoisted(column))


def formula_literals(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, pos, literal``: distinct literals, numbered from 0 by first appearance."""
    listed = f"_lits_{column}"
    return df.select(key, F.posexplode(listed if listed in df.columns else logic.literals(column)).alias("pos", "literal"))


def read_literals(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the literals of formulas read, as a checkpointed table: give it to all who list literals."""
    return cut(df.withColumns({f"_lits_{c}": logic.literals(c) for c in columns}))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _unit(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    return let(wide, lambda v: let(F.sqrt(_dot(v, v)), lambda size: F.transform(v, lambda x: x / size)))


def literal_similarity(pred_lits: DataFrame, gold_lits: DataFrame, key: str = "pair_id", method: str = "vectors",
                       vectors: DataFrame | None = None) -> DataFrame:
    """``key, gold_pos, gold, pred_pos, pred, similarity`` for the literals of each pair.

    ``vectors`` has ``literal, embedding``. Each distinct pair of literals is compared once.
    """
    gold = gold_lits.select(key, F.col("pos").alias("gold_pos"), F.col("literal").alias("gold"))
    pred = pred_lits.select(key, F.col("pos").alias("pred_pos"), F.col("literal").alias("pred"))
    # A formula within the size budget has a few literals, so a key meets only a few partners.
    return _compared(joined_rows(gold, pred, key), method, vectors)


def _compared(pairs: DataFrame, method: str, vectors: DataFrame | None) -> DataFrame:
    """The pairs of literals with their similarity."""
    if method == "edit":
        longest = F.greatest(F.length("gold"), F.length("pred"))
        return pairs.withColumn("similarity", 1 - F.levenshtein("gold", "pred") / longest)
    if method != "vectors" or vectors is None:
        raise ValueError("method is 'edit', or 'vectors' with a vector table")
    distinct = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("_n"))
    # Vectors are scaled once each. Every pair of literals occurs once here, so no literal is hot and a plain join serves.
    of = lambda name: vectors.select(F.col("literal").alias(name), _unit(F.col("embedding")).alias(f"_{name}"))
    scored = joined_rows(joined_rows(distinct, of("gold"), "gold", "left"), of("pred"), "pred", "left")
    table = scored.select("gold", "pred", "_n", _dot(F.col("_gold"), F.col("_pred")).alias("similarity"))
    return lookup(pairs, table, ["gold", "pred"], ["similarity"], weight="_n")


def best_literal_match(sim: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, gold_pos, gold, pred_pos, pred, similarity``: the most similar prediction of each gold literal.

    The first one wins a tie. Without any similarity above 0 it is the first prediction.
    """
    score = F.coalesce(F.col("similarity"), F.lit(0.0))
    # Everything at or below 0 ties at 0, and the earlier position is the larger second part.
    rank = F.struct(F.greatest(score, F.lit(0.0)), -F.col("pred_pos"))
    # Dealt by key alone, for whoever gathers the matches of a key next.
    best = spread(sim, key).groupBy(key, "gold_pos", "gold").agg(
        F.max_by(F.struct("pred_pos", "pred", "similarity"), rank).alias("_best")
    )
    return best.select(key, "gold_pos", "gold", "_best.*")


def candidate_bindings(matched: DataFrame, limit: int | None = None, allowed: str | None = None) -> DataFrame:
    """One row per way to settle double claims, numbered ``binding_id``.

    Input columns: ``claims array<int>`` (the predicted literal each gold literal claims) and ``pred_count``. Adds
    ``gold_pred`` (per gold literal the predicted literal it keeps, or NULL), ``pred_vars`` (per predicted literal
    its variable), ``free`` (predictions nobody claims) and ``variables``. Gold literal j is variable j; free
    predictions get variables of their own. The number of ways is the product of the claim counts, and the binding
    number has one digit per claimed prediction, the last one moving fastest. ``limit`` keeps the first so many ways of
    a row; ``complete`` tells whether they are all. ``allowed`` names an ``array<boolean>`` that tells which claims may
    win: ways in which another one does are neither listed nor counted.

    Numbers are dealt over tasks in ranges of ``_BINDINGS_PER_PIECE``, so no task lists all ways of a row.
    """
    wins = "c = p" if allowed is None else f"c = p AND {allowed}[j]"
    claimants = f"""transform(array_distinct(claims), p -> named_struct(
        'pred', p, 'golds', filter(transform(claims, (c, j) -> CASE WHEN {wins} THEN j END), j -> j IS NOT NULL)))"""
    product = "aggregate({}, 1L, (n, g) -> n * size(g.golds))".format
    weighted = f"""transform(array({claimants}), groups -> transform(groups, (g, i) -> named_struct(
        'pred', g.pred, 'golds', g.golds, 'weight', {product('slice(groups, i + 2, size(groups))')})))[0]"""
    kept = """transform(_claimed, g -> named_struct(
        'pred', g.pred, 'gold', g.golds[int(binding_id div g.weight % size(g.golds))]))"""
    binding = """named_struct(
        'gold_pred', transform(claims, (c, j) -> get(filter(kept, k -> k.gold = j), 0).pred),
        'pred_vars', transform(sequence(0, pred_count - 1), p -> coalesce(
            get(filter(kept, k -> k.pred = p), 0).gold, int(size(claims) + array_position(free, p) - 1))),
        'free', free,
        'variables', size(claims) + size(free))"""
    free = "array_except(sequence(0, pred_count - 1), transform(kept, k -> k.pred))"
    settled = f"transform(array({kept}), kept -> transform(array({free}), free -> {binding})[0])[0]"
    step = F.lit(_BINDINGS_PER_PIECE).cast("bigint")
    ways = matched.withColumn("_claimed", F.expr(weighted)).withColumn("_ways", F.expr(product("_claimed")))
    # Without rules on claims there is always a way; a filter would work the claims out twice.
    ranges = (
        (ways if allowed is None else ways.where("_ways > 0"))
        .withColumn("complete", F.lit(True) if limit is None else F.col("_ways") <= limit)
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), _at_most("_ways", limit) - 1, step)))
    )
    last = F.least(_at_most("_ways", limit), F.col("_first") + step) - 1
    return (
        spread(ranges, *matched.columns, "_first")
        .withColumn("binding_id", F.explode(F.sequence(F.col("_first"), last)))
        .withColumn("_binding", F.expr(settled))
        .select(*matched.columns, "binding_id", "_binding.*", "complete")
    )


def _at_most(column: str, limit: int | None) -> Column:
    return F.col(column) if limit is None else F.least(column, F.lit(limit).cast("bigint"))


# Why a pair has no truth-table score.
TOO_WIDE = "too many repeated literals"
OVER_BUDGET = "over budget"
NO_BINDING = "not well formed, or no binding allowed"


def truth_agreement(bound: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """``keys, score`` and the carried columns: share of all assignments on which both formulas agree, exact.

    Input columns: ``gold_order`` and ``pred_order`` (postfix), ``gold_vars`` and ``pred_vars`` (variable of each
    literal), ``variables``; ``keys`` identify a row. Up to 18 variables are enumerated in the row, 64 assignments in a
    machine word. With more, only variables that occur more than once in the two formulas need to be told apart; all
    others are independent of each other, and their share follows from the parts of the formula. Up to
    ``_FEW_REPEATED`` of them are enumerated, more of them make a decision diagram. Where one of its layers passes
    ``_DIAGRAM_WIDTH`` nodes, the assignments of up to ``_MAX_REPEATED`` variables are enumerated, spread over rows and
    added up; beyond that the score is NULL.
    """
    carry = carry or []
    leaves = lambda side: f"transform(filter({side}_order, t -> t >= 0), t -> {side}_vars[t])"
    # Repeated variables in the order in which both formulas come to them.
    place = "IF(array_position(l.g, v) = 0, 2, 1) * array_position(l.p, v) + IF(array_position(l.p, v) = 0, 2, 1) * array_position(l.g, v)"
    often = "filter(array_distinct(concat(l.g, l.p)), v -> size(filter(concat(l.g, l.p), x -> x = v)) > 1)"
    ordered = f"transform(array_sort(transform({often}, v -> named_struct('at', {place}, 'v', v))), r -> r.v)"
    repeated = f"transform(array(named_struct('g', {leaves('gold')}, 'p', {leaves('pred')})), l -> {ordered})[0]"
    wide = F.col("variables") > _MASK_VARIABLES + _BLOCK_BITS
    blocks = F.expr(f"shiftleft(1L, greatest(variables - {_MASK_VARIABLES}, 0))")
    cases = F.when(F.size("_repeated") <= _MAX_REPEATED, F.expr("shiftleft(1L, size(_repeated))"))
    per_row = F.lit(1 << _BLOCK_BITS).cast("bigint")
    sides = ("gold_order", "gold_vars", "pred_order", "pred_vars")
    many = wide & (F.size("_repeated") > _FEW_REPEATED)
    sized = bound.withColumn("_repeated", F.when(wide, F.expr(repeated))).withColumn(
        "_whole", F.when(many, logic.diagram_agreement(*sides, "_repeated", _DIAGRAM_WIDTH))
    ).withColumn("_blocks", F.when(F.col("_whole").isNotNull(), 1).when(wide, cases).otherwise(blocks))
    pieces = sized.select(
        *keys, *carry, "variables", "_blocks", "_whole", "_repeated", "gold_order", "gold_vars", "pred_order", "pred_vars",
        F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1, per_row)).alias("_first"),
    )
    # The evaluation is the costly step, hence the even spread before it.
    agreed = spread(pieces, *keys, "_first").withColumn("_last", F.least("_blocks", F.col("_first") + per_row) - 1).select(
        *keys, *carry, "_blocks",
        F.when(F.col("_first").isNull(), F.lit(None).cast("double"))
        .when(F.col("_whole").isNotNull(), F.col("_whole"))
        .when(wide, logic.conditional_agreement(*sides, "_repeated", "_first", "_last"))
        .otherwise(logic.agreeing_bits(*sides, "variables", "_first", "_last") / 64.0)
        .alias("_share"),
    )
    share = F.sum("_share") / F.first("_blocks")
    return agreed.groupBy(*keys).agg(share.alias("score"), *[F.first(c).alias(c) for c in carry])


def read_formulas(pairs: DataFrame, key: str = "pair_id", pred: str = "pred", gold: str = "gold",
                  budget: logic.Budget = logic.Budget()) -> DataFrame:
    """The pairs with their formulas read, as a checkpointed table.

    Reading is heavy, and similarity, truth tables and reports all need it: give them this table, and it is done once.
    """
    fits = budget.allows(pred) & budget.allows(gold)
    read = lambda c: F.when(F.col("_fits"), logic.parsed(c))
    return cut(
        spread(pairs, key).withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumns({"_gold_read": read(gold), "_pred_read": read(pred)})
    )


def _is_read(pairs: DataFrame) -> bool:
    return {"_fits", "_gold_read", "_pred_read"} <= set(pairs.columns)


def _fits(pairs: DataFrame, pred: str, gold: str, budget: logic.Budget) -> Column:
    return F.col("_fits") if _is_read(pairs) else budget.allows(pred) & budget.allows(gold)


def _parsed(pairs: DataFrame, key: str, pred: str, gold: str, budget: logic.Budget) -> DataFrame:
    """Pairs worth a truth table: within the size budget on both sides and well formed."""
    if _is_read(pairs):
        whole = pairs.where("_gold_read.ord is not null and _pred_read.ord is not null")
        return whole.select(
            key,
            F.col("_gold_read.ord").alias("gold_order"),
            F.col("_pred_read.ord").alias("pred_order"),
            F.col("_gold_read.lits").alias("gold_lits"),
            F.col("_pred_read.lits").alias("pred_lits"),
        )
    fits = budget.allows(pred) & budget.allows(gold)
    read = F.struct(F.col(key).alias(key), logic.parsed(gold).alias("g"), logic.parsed(pred).alias("p"))
    whole = F.filter(F.array(read), lambda f: f["g"]["ord"].isNotNull() & f["p"]["ord"].isNotNull())
    # Reading is heavy and rows are short. inline() keeps the filter on the result from reading them twice.
    formulas = spread(pairs.where(fits).select(key, pred, gold), key).select(F.inline(whole))
    return formulas.select(
        key,
        F.col("g.ord").alias("gold_order"),
        F.col("p.ord").alias("pred_order"),
        F.col("g.lits").alias("gold_lits"),
        F.col("p.lits").alias("pred_lits"),
    )


def formula_similarity(pairs: DataFrame, key: str = "pair_id", pred: str = "pred", gold: str = "gold",
                       method: str = "vectors", vectors: DataFrame | None = None,
                       budget: logic.Budget = logic.Budget()) -> DataFrame:
    """``literal_similarity`` of the pairs that will be scored."""
    if _is_read(pairs):
        # Both sides are in the row, so their literals meet there.
        gold = pairs.where("_fits").select(key, F.posexplode("_gold_read.lits").alias("gold_pos", "gold"), "_pred_read")
        met = gold.select(key, "gold_pos", "gold", F.posexplode("_pred_read.lits").alias("pred_pos", "pred"))
        return _compared(met, method, vectors)
    fits = spread(pairs.where(budget.allows(pred) & budget.allows(gold)).select(key, pred, gold), key)
    return literal_similarity(
        formula_literals(fits, key, pred), formula_literals(fits, key, gold), key, method, vectors
    )


def _identity(array: str) -> Column:
    return F.transform(array, lambda _, i: i)


def _best(agreement: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Per key the first binding with the highest score; an all-disagree pair has a score and no binding.

    ``complete`` is true if it is for all bindings.
    """
    rank = F.when(F.col("score") > 0, F.struct(F.col("score"), -F.col("binding_id")))
    return (
        agreement.groupBy(key)
        .agg(
            F.max_by(F.struct(*carry), rank).alias("_best"),
            F.max("score").alias("score"),
            F.max(F.when(F.col("score").isNull(), F.lit(TOO_WIDE))).alias("reason"),
            F.min("complete").alias("complete"),
        )
        .select(key, "score", "reason", "complete", *[F.col("_best")[c].alias(c) for c in carry])
    )


def logical_equivalence(pairs: DataFrame, sim: DataFrame, key: str = "pair_id", pred: str = "pred",
                        gold: str = "gold", threshold: float | None = None, budget: logic.Budget = logic.Budget(),
                        binding_limit: int | None = None) -> DataFrame:
    """``key, score, reason, complete, gold_binding, pred_binding, bound_scores`` for every pair.

    ``sim`` is the result of ``literal_similarity``. The score is the best truth-table agreement over the candidate
    bindings; with a threshold, bindings that join literals less similar than it are left out. Pairs over budget or
    not well formed score 0, have no binding and say so in ``reason``; where bindings are too wide to score, ``reason`` says
    that, and the score is the best of the others or NULL. ``complete`` is false if ``binding_limit`` left some out.
    """
    matches = best_literal_match(sim, key)
    claims = matches.groupBy(key).agg(
        F.sort_array(F.array_agg(F.struct("gold_pos", "pred_pos", "similarity"))).alias("_match")
    )
    matched = joined_rows(_parsed(pairs, key, pred, gold, budget), claims, key).select(
        "*",
        F.transform("_match", lambda m: m["pred_pos"]).alias("claims"),
        F.transform("_match", lambda m: m["similarity"]).alias("claim_scores"),
        F.size("pred_lits").alias("pred_count"),
        _identity("gold_lits").alias("gold_vars"),
    )
    if threshold is not None:
        strong = F.transform("claim_scores", lambda s: F.coalesce(s >= threshold, F.lit(False)))
        bound = candidate_bindings(matched.withColumn("_strong", strong), binding_limit, "_strong").drop("_strong")
    else:
        bound = candidate_bindings(matched, binding_limit)
    carry = ["gold_lits", "pred_lits", "gold_pred", "free", "claim_scores"]
    agreement = truth_agreement(bound, [key, "binding_id"], [*carry, "complete"])
    settled = _best(agreement, key, carry)
    dummy = lambda name: F.concat(F.lit(logic.DUMMY), name)
    gold_names = F.concat(
        F.col("gold_lits"), F.transform("free", lambda p: dummy(F.get("pred_lits", p)))
    )
    pred_names = F.concat(
        F.transform("gold_pred", lambda p, j: F.coalesce(F.get("pred_lits", p), dummy(F.get("gold_lits", j)))),
        F.transform("free", lambda p: F.get("pred_lits", p)),
    )
    bound_scores = F.transform(
        F.filter(F.arrays_zip("gold_pred", "claim_scores"), lambda b: b["gold_pred"].isNotNull()),
        lambda b: b["claim_scores"],
    )
    named = settled.select(
        key, "score", "reason", "complete", gold_names.alias("gold_binding"), pred_names.alias("pred_binding"),
        bound_scores.alias("bound_scores"),
    )
    return _every_pair(pairs, named, key, _fits(pairs, pred, gold, budget))


def _every_pair(pairs: DataFrame, scored: DataFrame, key: str, fits: Column) -> DataFrame:
    """Scores of all pairs, with the reason where a pair has no score of its own."""
    joined = joined_rows(pairs.select(key, fits.alias("_fits")), scored.withColumn("_scored", F.lit(True)), key, "left")
    missing = F.col("_scored").isNull()
    return joined.withColumns({
        "score": F.when(missing, F.lit(0.0)).otherwise(F.col("score")),
        "reason": F.when(~F.coalesce("_fits", F.lit(False)), F.lit(OVER_BUDGET)).when(missing, F.lit(NO_BINDING)).otherwise(F.col("reason")),
        "complete": F.coalesce("complete", F.lit(True)),
    }).drop("_fits", "_scored")


# n! as far as it fits into 64 bits.
_FACTORIALS = [factorial(n) for n in range(21)]
# All permutations of so many literals are tried; more are searched, which soon costs less.
_ENUMERATED_LITERALS = 3
# Entries of truth tables that the search of one piece may look at.
_SEARCH_WORK = 1 << 33


def _searched(names: DataFrame, key: str, work: int) -> DataFrame:
    """``key, binding_id, score, gold_names, pred_names, _perm, complete``: the best permutation of each piece of a search.

    A piece is the choice for the first literal, for the first two where there are many, and everything where there are
    few; pieces are dealt over tasks.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n = len(row.ranked)
                ranks = [list(map(int, r)) for r in row.ranked]
                found = BindingSearch(truth_table(list(row.gold_order), n), truth_table(list(row.pred_order), n), ranks)
                score, image, ended = found.best([int(p) for p in row.prefix], found.climbed(), max(work >> n, 1))
                image = image or found.first()
                out.append((row.key, found.number(image), max(score, 0) / found.size, row.gold_names, row.pred_names, image, ended))
            yield pd.DataFrame(out, columns=["key", "binding_id", "score", "gold_names", "pred_names", "_perm", "complete"])

    deep = F.flatten(F.transform(F.get("_ranked", 0), lambda p: F.transform(
        F.array_remove(F.get("_ranked", 1), p), lambda q: F.array(p, q)
    )))
    whole = F.array(F.array().cast("array<int>"))
    prefixes = (
        F.when(F.size("_ranked") > 9, deep)
        .when(F.size("_ranked") > 6, F.transform(F.get("_ranked", 0), lambda p: F.array(p)))
        .otherwise(whole)
    )
    pieces = names.select(
        F.col(key).alias("key"), "gold_order", "pred_order", "gold_names", "pred_names", F.col("_ranked").alias("ranked"),
        F.explode(prefixes).alias("prefix"),
    )
    kind = pieces.schema["key"].dataType.simpleString()
    found = spread(pieces, "key", "prefix").mapInPandas(
        search,
        f"key {kind}, binding_id bigint, score double, gold_names array<string>, pred_names array<string>, _perm array<int>, complete boolean",
    )
    return found.withColumnRenamed("key", key)


def logical_equivalence_permuted(pairs: DataFrame, key: str = "pair_id", pred: str = "pred", gold: str = "gold",
                                 budget: logic.Budget = logic.Budget(), binding_limit: int | None = None,
                                 search_work: int = _SEARCH_WORK) -> DataFrame:
    """``key, score, reason, complete, gold_binding, pred_binding``: bindings are permutations, nearest literals first.

    Each gold literal ranks the predictions by edit distance, and permutations follow these ranks with the last
    literal moving fastest. Permutation number k is read digit by digit in the factorial number system. Up to
    ``_ENUMERATED_LITERALS`` literals all are tried. More are searched by branch and bound, in pieces of one or two fixed
    literals; ``complete`` is false if a piece passed ``search_work`` entries of truth tables, and the best permutation so
    far stands. With a ``binding_limit`` the first so many permutations are tried instead; ``complete`` tells whether they
    are all. Beyond 20 literals there must be one.
    """
    reachable(pairs.sparkSession)
    padded = lambda names, other: F.concat(
        F.col(names),
        F.transform(
            F.when(
                F.size(other) > F.size(names), F.sequence(F.lit(0), F.size(other) - F.size(names) - 1)
            ).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(F.lit(logic.DUMMY), i.cast("string")),
        ),
    )
    names = _parsed(pairs, key, pred, gold, budget).select(
        key, "gold_order", "pred_order",
        padded("gold_lits", "pred_lits").alias("gold_names"),
        padded("pred_lits", "gold_lits").alias("pred_names"),
        F.size("pred_lits").alias("_pred_count"),
    )
    is_dummy = lambda name: name.startswith(logic.DUMMY)
    distance = lambda a, b: F.when(is_dummy(a) | is_dummy(b), logic.DUMMY_DISTANCE).otherwise(F.levenshtein(a, b))
    ranked = F.transform(
        "gold_names",
        lambda g: F.transform(
            F.array_sort(
                F.transform("pred_names", lambda p, i: F.struct(distance(g, p).alias("d"), i.alias("i")))
            ),
            lambda r: r["i"],
        ),
    )
    n = F.size("gold_names")
    factorials = F.array(*[F.lit(f).cast("bigint") for f in _FACTORIALS])
    all_ways = F.get(factorials, n)
    if binding_limit is None:
        tries = F.coalesce(all_ways, F.raise_error(F.lit("more than 20 literals need a binding_limit")).cast("bigint"))
    else:
        tries = F.least(F.coalesce(all_ways, F.lit(binding_limit)), F.lit(binding_limit)).cast("bigint")
    # Read by both ways of finding the best permutation, and costly to make.
    names = cut(names.withColumn("_ranked", ranked))
    searched = (n > _ENUMERATED_LITERALS) & (n <= 20) if binding_limit is None else F.lit(False)
    numbered = names.where(~searched).withColumn("complete", F.coalesce(all_ways <= tries, F.lit(False))).withColumn(
        "binding_id", F.explode(F.sequence(F.lit(0).cast("bigint"), tries - 1))
    )

    def place(used: Column, i: Column) -> Column:
        left = F.filter(F.get("_ranked", i), lambda p: ~F.array_contains(used, p))
        weight = F.get(factorials, n - 1 - i)
        digit = F.coalesce(F.floor(F.col("binding_id") / weight) % (n - i), F.lit(0)).cast("int")
        return F.concat(used, F.array(F.get(left, digit)))

    bound = numbered.withColumn(
        "_perm", F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), place)
    )
    evaluated = bound.select(
        key, "binding_id", "gold_order", "pred_order", "gold_names", "pred_names", "_perm",
        _identity("gold_names").alias("gold_vars"),
        let(
            F.col("_perm"),
            lambda perm: F.transform(
                F.sequence(F.lit(0), F.col("_pred_count") - 1),
                lambda p: (F.array_position(perm, p) - 1).cast("int"),
            ),
        ).alias("pred_vars"),
        n.alias("variables"), "complete",
    )
    carry = ["gold_names", "pred_names", "_perm", "complete"]
    agreement = truth_agreement(evaluated, [key, "binding_id"], carry)
    if binding_limit is None:
        agreement = agreement.unionByName(_searched(names.where(searched), key, search_work).select(agreement.columns))
    named = _best(agreement, key, carry[:-1]).select(
        key, "score", "reason", "complete", F.col("gold_names").alias("gold_binding"),
        F.transform("_perm", lambda p: F.get("pred_names", p)).alias("pred_binding"),
    )
    return _every_pair(pairs, named, key, _fits(pairs, pred, gold, budget))


def formula_reward(pairs: DataFrame, sim: DataFrame, key: str = "pair_id", pred: str = "pred", gold: str = "gold",
                   budget: logic.Budget = logic.Budget()) -> DataFrame:
    """``key, equivalence, bleu, reward, reason``: half equivalence, half BLEU; completions over the length limit get 0."""
    scores = logical_equivalence(pairs, sim, key, pred, gold, budget=budget).select(
        key, F.col("score").alias("equivalence"), "reason"
    )
    texts = pairs.select(
        key, F.col(pred).alias("_pred"), logic.tokens(pred).alias("_hyp"),
        logic.tokens(gold).alias("_ref"),
    )
    both = joined_rows(sentence_bleu(texts, key, "_hyp", "_ref", ["_pred"]), scores, key)
    reward = F.when(F.length("_pred") > budget.max_chars, F.lit(0.0)).otherwise(
        (F.col("equivalence") + F.col("bleu")) * 0.5
    )
    return both.select(key, "equivalence", "bleu", reward.alias("reward"), "reason")


def preference_reward(completions: DataFrame, formulas: DataFrame, vectors: DataFrame | None = None,
                      completion: str = "completion", reference: str = "reference",
                      method: str = "vectors", budget: logic.Budget = logic.Budget()) -> DataFrame:
    """Adds ``reward``: equivalence, above the similarity floor, of the formulas of completion and reference.

    ``formulas`` is ``text, formula``, one row per text. Each distinct pair of formulas is scored once. Where a text has no
    formula the reward does not apply and is NULL; ``unmatched_references`` counts such rows.
    """
    of = lambda text, name: formulas.select(F.col("text").alias(text), F.col("formula").alias(name))
    # Completions meet formulas by their texts: each pair of texts is looked up once, and no formula goes along with a row.
    whole = F.col(completion).isNotNull() & F.col(reference).isNotNull()
    texts = completions.where(whole).groupBy(completion, reference).agg(F.count(F.lit(1)).alias("_rows"))
    named = lookup(
        lookup(texts, of(completion, "_pred"), [completion], ["_pred"]),
        of(reference, "_gold"), [reference], ["_gold"],
    )
    # A digest stands for the two formulas as a key of fixed length.
    pair = F.unhex(F.sha2(F.concat("_pred", F.lit("\u0001"), "_gold"), 256))
    paired = cut(named.select(completion, reference, "_rows", "_pred", "_gold", pair.alias("_pair")))
    # Read several times, and costly to make.
    distinct = read_formulas(
        paired.where(F.col("_pair").isNotNull()).groupBy("_pair", "_pred", "_gold").agg(F.sum("_rows").alias("_n")),
        "_pair", "_pred", "_gold", budget,
    )
    sim = formula_similarity(distinct, "_pair", "_pred", "_gold", method, vectors, budget)
    scores = logical_equivalence(distinct, sim, "_pair", "_pred", "_gold", logic.SIMILARITY_FLOOR, budget)
    weighted = cut(joined_rows(distinct.select("_pair", "_n"), scores.select("_pair", F.col("score").alias("_score")), "_pair"))
    scored = cut(lookup(paired, weighted, ["_pair"], ["_score"], weight="_n").select(completion, reference, "_rows", "_score"))
    rewarded = lookup(completions, scored, [completion, reference], ["_score"], weight="_rows")
    return rewarded.select(*completions.columns, F.col("_score").alias("reward"))


def formula_evaluation(scored: DataFrame, key: str = "pair_id", score: str = "score", pred: str = "pred",
                       gold: str = "gold", batch: str = "batch_id") -> DataFrame:
    """``LE, bleu`` of an evaluation set: mean score with all rows in the denominator, batch-weighted BLEU."""
    # Read for the mean and for BLEU, and costly to make.
    scored = cut(scored.select(key, batch, score, pred, gold))
    tokens = scored.select(
        key, batch, logic.tokens(pred).alias("_hyp"), logic.tokens(gold).alias("_ref")
    )
    bleu = batch_weighted_bleu(tokens, key, "_hyp", "_ref", batch).agg(F.first("bleu"))
    mean = F.sum(F.coalesce(score, F.lit(0.0))) / F.count(F.lit(1))
    return scored.agg(F.count(F.lit(1)).alias("rows"), mean.alias("LE")).withColumn("bleu", bleu.scalar())
