"""Formula jobs against a brute-force evaluator and hand-made cases."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from alignframe.functions import logic
from alignframe.operators import equivalence as eq
from alignframe.plans import fixtures as fx

OPS = {
    "∧": lambda a, b: a and b,
    "∨": lambda a, b: a or b,
    "⊕": lambda a, b: a != b,
    "→": lambda a, b: (not a) or b,
    "↔": lambda a, b: a == b,
}


def random_formula(rng, names, depth):
    """A fully parenthesised formula as text and as nested tuples."""
    if depth == 0 or rng.random() < 0.15:
        name = rng.choice(names)
        return (f"¬{name}", ("¬", name)) if rng.random() < 0.3 else (name, name)
    left, lt = random_formula(rng, names, depth - 1)
    right, rt = random_formula(rng, names, depth - 1)
    op = rng.choice(list(OPS))
    text, tree = f"({left} {op} {right})", (op, lt, rt)
    return (f"¬{text}", ("¬", tree)) if rng.random() < 0.2 else (text, tree)


def evaluate(tree, env):
    if isinstance(tree, str):
        return env[tree]
    if tree[0] == "¬":
        return not evaluate(tree[1], env)
    return OPS[tree[0]](evaluate(tree[1], env), evaluate(tree[2], env))


def atoms_in_order(text, names):
    return sorted((n for n in names if n in text), key=text.index)


def agreement(tree_a, vars_a, tree_b, vars_b, n):
    same = 0
    for row in itertools.product([False, True], repeat=n):
        env_a = {name: row[v] for name, v in vars_a.items()}
        env_b = {name: row[v] for name, v in vars_b.items()}
        same += evaluate(tree_a, env_a) == evaluate(tree_b, env_b)
    return same / 2**n


def test_truth_agreement_matches_brute_force(spark):
    rng = random.Random(7)
    names = [f"{c}(x)" for c in "ABCDEFGHI"]
    rows, expected = [], {}
    for i in range(60):
        pool = names[: rng.randint(1, 9)]
        gold, gt = random_formula(rng, pool, 4)
        pred, pt = random_formula(rng, pool, 4)
        ga, pa = atoms_in_order(gold, pool), atoms_in_order(pred, pool)
        gv, pv = {a: j for j, a in enumerate(ga)}, {a: j for j, a in enumerate(pa)}
        n = max(len(ga), len(pa))
        rows.append((i, gold, pred, list(range(len(ga))), list(range(len(pa))), n))
        expected[i] = agreement(gt, gv, pt, pv, n)
    df = spark.createDataFrame(rows, "pair_id int, gold string, pred string, gold_vars array<int>, pred_vars array<int>, variables int")
    bound = df.withColumns({"gold_order": logic.postfix("gold"), "pred_order": logic.postfix("pred")})
    got = {r.pair_id: r.score for r in eq.truth_agreement(bound, ["pair_id"]).collect()}
    assert got == pytest.approx(expected)


def test_many_variables_are_spread_over_rows_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(eq, "_BLOCK_BITS", 1)
    gold = " ∧ ".join(f"P{i}(x)" for i in range(9))
    pred = " ∨ ".join(f"P{i}(x)" for i in range(9))
    df = spark.createDataFrame([(1, gold, pred)], "pair_id int, gold string, pred string").select(
        "pair_id", logic.postfix("gold").alias("gold_order"), logic.postfix("pred").alias("pred_order"),
        F.expr("sequence(0, 8)").alias("gold_vars"), F.expr("sequence(0, 8)").alias("pred_vars"),
        F.lit(9).alias("variables"),
    )
    assert eq.truth_agreement(df, ["pair_id"]).first().score == pytest.approx(2 / 2**9)


@pytest.mark.parametrize(
    "text, order",
    [
        ("A(x) ∧ B(x) ∨ C(x)", [0, 1, -2, 2, -3]),
        ("A(x) ∨ B(x) ∧ C(x)", [0, 1, 2, -2, -3]),
        ("A(x) → B(x) → C(x)", [0, 1, 2, -5, -5]),
        ("A(x) ↔ B(x) → C(x)", [0, 1, 2, -5, -6]),
        ("¬(A(x) ⊕ B(x)) ∧ ¬A(x)", [0, 1, -4, -1, 0, -1, -2]),
        ("∀x ∃y (A(x, y))", [0]),
        ("((A(x)))", [0]),
        ("A(x) ∧ ∨ B(x)", None),
        ("(A(x) ∧ B(x)", None),
        ("A(x))", None),
        ("A(x) B(x)", None),
        ("¬¬A(x)", None),
        ("A ∧ B(x)", None),
        ("A() ∧ B(x)", None),
        ("", None),
    ],
)
def test_operator_order_and_well_formedness(spark, text, order):
    row = spark.createDataFrame([(text,)], "f string").select(logic.postfix("f").alias("o")).first()
    assert row.o == order


def test_tokens_merge_words(spark):
    df = spark.createDataFrame([("∀x (dc universe's fan(x)→ Q ( x , big  city ))",)], "f string")
    row = eq.formula_tokens(df, "f").first()
    assert row.tokens == "∀ x ( DcUniversesFan ( x ) → Q ( x , BigCity ) )".split()
    assert row.normalized == "∀x (dcuniversesfan(x) → Q(x, bigcity))"


def test_quantifiers_move_to_the_front_in_order(spark):
    df = spark.createDataFrame([("P(x) ∧ ∀y (Q(y) ∧ ∃z R(z))",)], "f string")
    assert eq.hoist_quantifiers(df, "f").first().hoisted == "∀y ∃z P(x) ∧  (Q(y) ∧  R(z))"


def similarity_table(spark, sims):
    rows = [(k, gp, g, pp, p, s) for k, gp, g, pp, p, s in sims]
    return spark.createDataFrame(
        rows, "pair_id long, gold_pos int, gold string, pred_pos int, pred string, similarity double"
    )


def test_double_claims_and_free_predictions(spark):
    matched = spark.createDataFrame([(1, [0, 0, 2, 2], 4)], "pair_id long, claims array<int>, pred_count int")
    rows = eq.candidate_bindings(matched).orderBy("binding_id").collect()
    assert [r.gold_pred for r in rows] == [
        [0, None, 2, None], [0, None, None, 2], [None, 0, 2, None], [None, 0, None, 2],
    ]
    assert rows[1].pred_vars == [0, 4, 3, 5]
    assert rows[0].free == [1, 3] and rows[0].variables == 6


def brute_equivalence(gold, gt, pred, pt, pool, sim, threshold):
    ga, pa = atoms_in_order(gold, pool), atoms_in_order(pred, pool)
    claims = []
    for g in ga:
        best, at = 0.0, 0
        for i, p in enumerate(pa):
            if sim[g, p] > best:
                best, at = sim[g, p], i
        claims.append(at)
    groups = {}
    for j, c in enumerate(claims):
        groups.setdefault(c, []).append(j)
    best = 0.0
    for keep in itertools.product(*groups.values()):
        bound = dict(zip(groups, keep))
        if threshold is not None and any(sim[ga[j], pa[c]] < threshold for c, j in bound.items()):
            continue
        free = [i for i in range(len(pa)) if i not in bound]
        pv = {pa[c]: j for c, j in bound.items()} | {pa[i]: len(ga) + k for k, i in enumerate(free)}
        n = len(ga) + len(free)
        best = max(best, agreement(gt, {a: j for j, a in enumerate(ga)}, pt, pv, n))
    return best


@pytest.mark.parametrize("threshold", [None, 0.6])
def test_equivalence_matches_brute_force(spark, threshold):
    rng = random.Random(11)
    names = [f"{c}(x)" for c in "ABCDE"]
    pairs, sims, expected = [], [], {}
    for i in range(25):
        gold, gt = random_formula(rng, names[:4], 2)
        pred, pt = random_formula(rng, names[1:], 2)
        ga, pa = atoms_in_order(gold, names), atoms_in_order(pred, names)
        sim = {(g, p): rng.choice([-0.2, 0.0, 0.3, 0.7, 0.9]) for g in ga for p in pa}
        sims += [(i, a, g, b, p, sim[g, p]) for a, g in enumerate(ga) for b, p in enumerate(pa)]
        pairs.append((i, gold, pred))
        expected[i] = brute_equivalence(gold, gt, pred, pt, names, sim, threshold)
    df = spark.createDataFrame(pairs, "pair_id long, gold string, pred string")
    got = eq.logical_equivalence(df, similarity_table(spark, sims), threshold=threshold).collect()
    assert {r.pair_id: r.score for r in got} == pytest.approx(expected)
    for r in got:
        assert (r.score == 0) == (r.gold_binding is None)
        if r.gold_binding is not None:
            assert len(r.gold_binding) == len(r.pred_binding)


def test_equivalence_of_itself_its_negation_and_bad_formulas(spark):
    f = "A(x) → (B(x) ∨ C(x))"
    rows = [
        (1, f, f), (2, f"¬({f})", f), (3, "A(x) ∧", f), (4, f"{'x' * 200}(y)", f), (5, None, f),
        (6, " ∧ ".join(["A(x)"] * 7), f),
    ]
    df = spark.createDataFrame(rows, "pair_id long, pred string, gold string")
    sim = eq.formula_similarity(df, method="edit")
    got = {r.pair_id: r for r in eq.logical_equivalence(df, sim).collect()}
    assert got[1].score == 1.0 and got[1].gold_binding == ["A(x)", "B(x)", "C(x)"]
    assert got[1].bound_scores == [1.0, 1.0, 1.0]
    assert [got[i].score for i in (2, 3, 4, 5, 6)] == [0.0] * 5


def brute_permuted(gold, gt, pred, pt, pool, limit):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    ga, pa = atoms_in_order(gold, pool), atoms_in_order(pred, pool)
    n = max(len(ga), len(pa))
    gn = ga + [None] * (n - len(ga))
    pn = pa + [None] * (n - len(pa))

    def walk(i, used):
        if i == n:
            yield list(used)
            return
        cost = lambda k: 10000 if gn[i] is None or pn[k] is None else edit(gn[i], pn[k])
        for k in sorted((k for k in range(n) if k not in used), key=lambda k: (cost(k), k)):
            yield from walk(i + 1, used + [k])

    best = 0.0
    for perm in itertools.islice(walk(0, []), limit):
        pv = {pn[k]: v for v, k in enumerate(perm) if pn[k] is not None}
        best = max(best, agreement(gt, {a: j for j, a in enumerate(ga)}, pt, pv, n))
    return best


def test_permuted_equivalence_matches_brute_force(spark):
    rng = random.Random(5)
    names = ["Ab(x)", "Abc(x)", "Bcd(y)", "Cde(y)", "Xyz(z)"]
    pairs, expected = [], {}
    for i in range(12):
        gold, gt = random_formula(rng, names, 3)
        pred, pt = random_formula(rng, names, 3)
        pairs.append((i, gold, pred))
        over = any(t.count(c) > 5 for t in (gold, pred) for c in "∧∨")
        expected[i] = 0.0 if over else brute_permuted(gold, gt, pred, pt, names, 1000)
    df = spark.createDataFrame(pairs, "pair_id long, gold string, pred string")
    got = {r.pair_id: r.score for r in eq.logical_equivalence_permuted(df).collect()}
    assert got == pytest.approx(expected)


def test_seven_literals_try_exactly_the_first_thousand_permutations(spark):
    names = [f"{c}{c}(x)" for c in "ABCDEFG"]
    gold = " → ".join(names)
    pred = " ↔ ".join(reversed(names))
    tree = lambda op, parts: parts[0] if len(parts) == 1 else (op, parts[0], tree(op, parts[1:]))
    want = brute_permuted(gold, tree("→", names), pred, tree("↔", names[::-1]), names, 1000)
    df = spark.createDataFrame([(1, gold, pred)], "pair_id long, gold string, pred string")
    assert eq.logical_equivalence_permuted(df).first().score == pytest.approx(want)


def test_preference_reward_uses_the_floor_and_scores_every_row(spark):
    completions = spark.createDataFrame(
        [(1, "c1", "r1"), (2, "c2", "r1"), (3, "c9", "r1"), (4, "c1", "r1")],
        "id int, completion string, reference string",
    )
    formulas = spark.createDataFrame(
        [("c1", "A(x) ∧ B(x)"), ("c2", "¬(A(x) ∧ B(x))"), ("r1", "A(x) ∧ B(x)")], "text string, formula string"
    )
    got = {r.id: r.reward for r in eq.preference_reward(completions, formulas, method="edit").collect()}
    # A text without a formula has no reward, rather than the worst one.
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 1.0}


def test_wide_formulas_are_exact(spark):
    """36 literals on either side, within the budget: each occurs once, so the share follows from the parts."""
    gold = "→".join(f"{chr(65 + i % 26)}({'xyz'[i // 26]})" for i in range(36))
    pred = "↔".join(f"{chr(97 + i % 26)}({'xyz'[i // 26]})" for i in range(36))
    assert len(gold) == len(pred) == 179
    # The chain of equivalences is true on half of all assignments, so the two agree on half.
    pairs = spark.createDataFrame([(1, gold, pred), (2, gold, gold)], "pair_id long, gold string, pred string")
    read = pairs.select(
        "pair_id", logic.postfix("gold").alias("gold_order"), logic.postfix("pred").alias("pred_order"),
        F.transform(logic.literals("gold"), lambda _, i: i).alias("gold_vars"),
        F.transform(logic.literals("pred"), lambda _, i: F.when(F.col("pair_id") == 1, i + 36).otherwise(i)).alias("pred_vars"),
        F.when(F.col("pair_id") == 1, 72).otherwise(36).alias("variables"),
    )
    got = {r.pair_id: r.score for r in eq.truth_agreement(read, ["pair_id"]).collect()}
    assert got[1] == pytest.approx(0.5, abs=1e-12)
    # All 36 variables occur on both sides: too many to enumerate, and no work for a diagram.
    assert got[2] == 1.0
    sim = similarity_table(spark, [(1, g, f"g{g}", p, f"p{p}", 0.0) for g in range(36) for p in range(36)])
    scored = eq.logical_equivalence(pairs.where("pair_id = 1"), sim).first()
    assert scored.score == pytest.approx(0.5, abs=1e-9) and scored.reason is None and scored.complete


def test_conditional_and_enumerated_shares_agree(spark, monkeypatch):
    rng = random.Random(11)
    names = [f"{c}(x)" for c in "ABCDEFGHI"]
    rows = []
    for i in range(40):
        gold, _ = random_formula(rng, names[: rng.randint(2, 9)], 4)
        pred, _ = random_formula(rng, names[: rng.randint(2, 9)], 4)
        rows.append((i, gold, pred))
    df = spark.createDataFrame(rows, "pair_id int, gold string, pred string").select(
        "pair_id", logic.postfix("gold").alias("gold_order"), logic.postfix("pred").alias("pred_order"),
        F.transform(logic.literals("gold"), lambda _, i: i).alias("gold_vars"),
        F.transform(logic.literals("pred"), lambda _, i: i + 2).alias("pred_vars"),
    ).withColumn("variables", F.greatest(F.size("gold_vars"), F.size("pred_vars") + 2))
    counted = {r.pair_id: r.score for r in eq.truth_agreement(df, ["pair_id"]).collect()}
    # With fewer enumerated variables the same pairs take the other way.
    monkeypatch.setattr(eq, "_MASK_VARIABLES", -1)
    monkeypatch.setattr(eq, "_BLOCK_BITS", 1)
    derived = {r.pair_id: r.score for r in eq.truth_agreement(df, ["pair_id"]).collect()}
    assert derived == pytest.approx(counted)


def bound_by_position(spark, pairs, shift=0):
    df = spark.createDataFrame(pairs, "pair_id int, gold string, pred string").select(
        "pair_id", logic.postfix("gold").alias("gold_order"), logic.postfix("pred").alias("pred_order"),
        F.transform(logic.literals("gold"), lambda _, i: i).alias("gold_vars"),
        F.transform(logic.literals("pred"), lambda _, i: i + shift).alias("pred_vars"),
    )
    return df.withColumn("variables", F.greatest(F.size("gold_vars"), F.size("pred_vars") + shift))


def scores(bound):
    return {r.pair_id: r.score for r in eq.truth_agreement(bound, ["pair_id"]).collect()}


def test_diagrams_equal_brute_force_and_say_where_they_end(spark, monkeypatch):
    rng = random.Random(13)
    names = [f"{c}(x)" for c in "ABCDEFGHIJKL"]
    pairs, expected = [], {}
    for i in range(40):
        pool = names[: rng.choice([2, 5, 12])]
        gold, gt = random_formula(rng, pool, 5)
        pred, pt = random_formula(rng, pool, 5)
        if i % 4 == 0:
            # Much the same formula on the other side.
            pred, pt = f"¬({gold})", ("¬", gt)
        pairs.append((i, gold, pred))
        ga, pa = atoms_in_order(gold, pool), atoms_in_order(pred, pool)
        expected[i] = agreement(gt, {a: j for j, a in enumerate(ga)}, pt, {a: j for j, a in enumerate(pa)}, max(len(ga), len(pa)))
    bound = bound_by_position(spark, pairs)
    monkeypatch.setattr(eq, "_MASK_VARIABLES", -1)
    monkeypatch.setattr(eq, "_BLOCK_BITS", 0)
    monkeypatch.setattr(eq, "_FEW_REPEATED", 0)
    monkeypatch.setattr(eq, "_MAX_REPEATED", 0)
    assert scores(bound) == pytest.approx(expected)
    # A layer of one node is never enough, so pairs that do not settle at once have no score, or are enumerated.
    monkeypatch.setattr(eq, "_DIAGRAM_WIDTH", 1)
    narrow = scores(bound)
    assert any(v is None for v in narrow.values()) and all(v is None or v == pytest.approx(expected[i]) for i, v in narrow.items())
    monkeypatch.setattr(eq, "_MAX_REPEATED", 12)
    assert scores(bound) == pytest.approx(expected)


def test_diagrams_equal_masks_at_twenty_variables(spark, monkeypatch):
    rng = random.Random(17)
    names = [f"{c}({v})" for v in "xy" for c in "ABCDEFGHIJ"]
    chain = lambda parts, ops: "".join(p + o for p, o in zip(parts, [*ops, ""]))
    pairs = []
    for i in range(6):
        ops = [rng.choice("∧∨→↔⊕") for _ in range(19)]
        pairs.append((i, chain(names, ops), chain(names[::-1] if i % 2 else names, rng.sample(ops, 19))))
    bound = bound_by_position(spark, pairs)
    derived = scores(bound)
    monkeypatch.setattr(eq, "_BLOCK_BITS", 14)
    assert derived == pytest.approx(scores(bound), abs=1e-12) and len(set(derived.values())) > 3


def test_searched_permutations_equal_enumerated_ones(spark, monkeypatch):
    rng = random.Random(19)
    names = [f"{c}{c.lower()}({v})" for c, v in zip("ABCDEFG", "xyzxyzx")]
    pairs = [(i, random_formula(rng, names[: rng.randint(2, 7)], 4)[0], random_formula(rng, names[: rng.randint(2, 7)], 4)[0]) for i in range(30)]
    df = spark.createDataFrame(pairs, "pair_id long, gold string, pred string")
    rows = lambda: sorted(map(repr, eq.logical_equivalence_permuted(df).collect()))
    monkeypatch.setattr(eq, "_ENUMERATED_LITERALS", 7)
    counted = rows()
    monkeypatch.setattr(eq, "_ENUMERATED_LITERALS", 1)
    assert rows() == counted


def test_twelve_literals_are_searched_whole(spark):
    names = [f"{c}(x)" for c in "ABCDEFGHIJKL"]
    ops = "∧→∨∧↔∨→∧⊕∨∧"
    gold = "".join(n + o for n, o in zip(names, [*ops, ""]))
    turned = names[5:] + names[:5]
    pred = "".join(n + o for n, o in zip(turned, [*ops, ""]))
    other = "".join(n + o for n, o in zip(names, [*ops[::-1], ""]))
    df = spark.createDataFrame([(1, gold, pred), (2, gold, other)], "pair_id long, gold string, pred string")
    started = time.time()
    got = {r.pair_id: r for r in eq.logical_equivalence_permuted(df).collect()}
    assert time.time() - started < 60
    # The same formula under other names: found, where the nearest names mislead.
    assert got[1].score == 1.0 and got[1].complete and got[1].reason is None
    assert got[2].complete and 0.5 < got[2].score <= 1
    stopped = eq.logical_equivalence_permuted(df.where("pair_id = 2"), search_work=1 << 14).first()
    assert not stopped.complete and stopped.score <= got[2].score


def test_bindings_are_dealt_in_ranges(spark, monkeypatch):
    """Eight literals that all claim one of four predictions, in every pair alike."""
    monkeypatch.setattr(eq, "_BINDINGS_PER_PIECE", 4)
    claims = [0, 1, 2, 3, 0, 1, 2, 3]
    pairs = spark.range(10_000).select(F.col("id").alias("pair_id"), F.array(*map(F.lit, claims)).alias("claims"), F.lit(4).alias("pred_count"))
    bound = eq.candidate_bindings(pairs)
    sizes = [r["count"] for r in bound.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 160_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    one = bound.where("pair_id = 7").orderBy("binding_id").collect()
    assert [r.binding_id for r in one] == list(range(16)) and len({tuple(map(str, r.gold_pred)) for r in one}) == 16
    # Claims that may not win are neither listed nor counted.
    some = pairs.limit(3).withColumn("may", F.array(*[F.lit(i not in (1, 6)) for i in range(8)]))
    kept = eq.candidate_bindings(some, allowed="may").collect()
    assert len(kept) == 3 * 4 and all(r.gold_pred[1] is None and r.gold_pred[6] is None for r in kept)
    assert eq.candidate_bindings(some.withColumn("may", F.array(*[F.lit(i % 4 > 0) for i in range(8)])), allowed="may").count() == 0


def test_scores_name_their_reason_and_limits(spark):
    pairs = spark.createDataFrame(
        [(1, "A(x) ∧ B(x)", "A(x) ∧ B(x)"), (2, "A(x) ∧", "A(x)"), (3, "A(x)", "∧".join(["A(x)"] * 8))], "pair_id long, gold string, pred string"
    )
    sim = eq.formula_similarity(pairs, method="edit")
    got = {r.pair_id: (r.score, r.reason, r.complete) for r in eq.logical_equivalence(pairs, sim).collect()}
    assert got == {1: (1.0, None, True), 2: (0.0, eq.NO_BINDING, True), 3: (0.0, eq.OVER_BUDGET, True)}
    wider = logic.Budget(max_and=20)
    assert {r.pair_id: r.score for r in eq.logical_equivalence(pairs, eq.formula_similarity(pairs, method="edit", budget=wider), budget=wider).collect()}[3] == 1.0
    eight = " ∧ ".join(f"{c}(x)" for c in "ABCDEF") + " → G(x) ∨ H(x)"
    long = spark.createDataFrame([(1, eight, eight)], "pair_id long, gold string, pred string")
    some = eq.logical_equivalence_permuted(long, binding_limit=10).first()
    assert some.score == 1.0 and not some.complete
    seven = " → ".join(f"{c}(x)" for c in "ABCDEFG")
    whole = eq.logical_equivalence_permuted(spark.createDataFrame([(1, seven, seven)], "pair_id long, gold string, pred string")).first()
    assert whole.score == 1.0 and whole.complete


def test_formula_evaluation_keeps_all_rows_in_the_denominator(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "A(x)", "A(x)", 0), (2, None, "B(x)", "A(x)", 0)],
        "pair_id int, score double, pred string, gold string, batch_id int",
    )
    row = eq.formula_evaluation(df).first()
    assert row.rows == 2 and row.LE == 0.5 and 0 < row.bleu < 1


def _broadcast_joins(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_rows_of_pairs_are_never_broadcast(spark):
    # Short rows make long ones: Spark takes all these tables to be small. Only hashes of hot keys may be broadcast.
    pairs = spark.range(40).selectExpr("id as pair_id", "'A(x) ∧ B(x)' as gold", "'B(x) ∧ A(x)' as pred", "id div 16 as batch_id")
    read = eq.read_formulas(pairs)
    names = spark.createDataFrame([("A(x)", [1.0, 0.0]), ("B(x)", [0.0, 1.0])], "literal string, embedding array<double>")
    sim = eq.formula_similarity(read, vectors=names)
    for df in (eq.logical_equivalence(read, sim), eq.logical_equivalence(read, sim, threshold=0.6), eq.formula_reward(read, sim)):
        assert all("_hash" in line for line in _broadcast_joins(df))
    scored = read.join(eq.logical_equivalence(read, sim).select("pair_id", "score").hint("merge"), "pair_id")
    assert eq.formula_evaluation(scored).select("rows", "LE").collect() == [(40, 1.0)]


def test_similarity_meets_in_the_row_as_by_join(spark):
    pairs = spark.createDataFrame([(1, "A(x) ∧ B(x)", "B(x) ∨ C(x)"), (2, "A(x)", "A(x) ∧"), (3, "", "A(x)")], "pair_id long, gold string, pred string")
    names = spark.createDataFrame([("A(x)", [1.0, 0.0]), ("B(x)", [0.6, 0.8])], "literal string, embedding array<double>")
    columns = ["pair_id", "gold_pos", "gold", "pred_pos", "pred", "similarity"]
    found = [eq.formula_similarity(p, vectors=names).select(columns) for p in (pairs, eq.read_formulas(pairs))]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
    assert found[1].count() == 5


def test_parts_are_dealt_before_formulas_are_read(spark, tiny):
    # One short file is one task, which would read all formulas.
    assert fx.formula_pairs(spark, tiny).rdd.getNumPartitions() == 4
    read = eq.read_literals(fx.formula_pairs(spark, tiny), "pred", "gold")
    for column in ("pred", "gold"):
        lists = [eq.formula_literals(df, "pair_id", column) for df in (read, fx.formula_pairs(spark, tiny))]
        assert sorted(lists[0].collect()) == sorted(lists[1].collect())
    # Literals that are read already are not read again.
    assert "regexp" not in eq.formula_literals(read, "pair_id", "pred")._jdf.queryExecution().optimizedPlan().toString()


def test_preference_reward_takes_no_formula_along_with_rows(spark):
    completions = spark.createDataFrame([(1, "a", "r"), (2, "a", "r"), (3, "b", "r"), (4, None, "r"), (5, "a", None), (6, "no", "r")], "id long, completion string, reference string")
    formulas = spark.createDataFrame([("a", "A(x)"), ("b", "¬A(x)"), ("b", "A(x)"), ("r", "A(x)")], "text string, formula string")
    rewarded = eq.preference_reward(completions, formulas, method="edit")
    plan = rewarded._jdf.queryExecution().optimizedPlan().toString()
    assert "_pred" not in plan and "_gold" not in plan
    # A text with two formulas gives two rows, as a join does.
    got = sorted(map(tuple, rewarded.select("id", "reward").collect()), key=str)
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0), (3, 1.0), (4, None), (5, None), (6, None)]
