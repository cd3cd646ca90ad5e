"""Hand-made cases and invariants of the other operators."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignframe.functions.text import words
from alignframe.operators import (
    bitext, dialogue, examples, filters, judging, overlap, policy, prompts, ranking, rollouts, skew,
)
from alignframe.plans.tasks import prepare_task
from alignframe.sources import io
from alignframe.streaming import incremental


def col(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# --- lookups and ranks


@pytest.mark.parametrize("weighted", [True, False])
def test_lookup_with_a_hot_key_keeps_every_row(spark, weighted):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"), "id"
    )
    table = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    table = table.where("k % 5 <> 0")
    got = skew.lookup(rows, table, ["k"], ["top"], weight="n" if weighted else None, hot_keys=3)
    want = rows.join(table, "k", "left").select("k", "id", "top")
    assert sorted(col(got, "id", "top")) == sorted(col(want, "id", "top"))
    assert sorted(col(skew.salted_lookup(rows, table, ["k"], ["top"], salts=4), "id", "top")) == sorted(
        col(want, "id", "top")
    )


def test_lookup_deals_hot_rows_to_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 4000, 1, 16).select(F.lit(1).alias("k"), "id")
        table = spark.createDataFrame([(1, 5, 4000)], "k int, v int, n long")
        got = skew.lookup(rows, table, ["k"], ["v"], weight="n")
        tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_positions_running_totals_and_quantiles(spark):
    df = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("v"))
    assert all(v == p for v, p in col(ranking.with_position(df, ["v"]), "v", "position"))
    total = ranking.running_total(df, "v", "v", "upto", width=16)
    assert all(u == v * (v + 1) // 2 for v, u in col(total, "v", "upto"))
    grouped = spark.createDataFrame(
        [("a", float(v)) for v in (0, 0, 0, 1, 5, 5, 1e9)] + [("b", -3.5), ("b", 2.0), ("c", 4.0), ("a", None)],
        "g string, x double",
    )
    for q in (0.0, 0.3, 0.5, 0.9, 1.0):
        got = dict(col(ranking.group_quantile(grouped, "g", "x", q, "c"), "g", "c"))
        want = dict(col(grouped.groupBy("g").agg(F.percentile("x", q).alias("c")), "g", "c"))
        assert got == pytest.approx(want)


# --- dialogue

TRANSCRIPT = "\n\nHuman: Hi\n\nAssistant: Hello\n\nHuman: Why?\n\nAssistant: Because."


def transcripts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, chosen string")


def test_parse_transcript_cases(spark):
    df = transcripts(
        spark, TRANSCRIPT, "no marker", "lead Human: a", "Human: Human: a", "Human: a\n\nAssistant:  ", "",
        "Human: ends with user",
    )
    rows = dialogue.parse_transcript(df, "chosen").orderBy("id").collect()
    assert [(m.role, m.content) for m in rows[0].messages] == [("user", "Hi"), ("assistant", "Hello"), ("user", "Why?")]
    assert [r.malformed for r in rows] == [False, True, True, False, False, True, False]
    assert [m.content for m in rows[3].messages] == ["a"]
    assert [m.content for m in rows[4].messages] == ["a"]
    labelled = dialogue.parse_transcript(df, "chosen", with_label=True).orderBy("id").first()
    assert labelled.messages[-1].content == "Because."


def test_render_then_parse_gives_the_messages_back(spark):
    parsed = dialogue.parse_transcript(transcripts(spark, TRANSCRIPT), "chosen", with_label=True)
    markup = "\n\n{role}: {content}"
    text = prompts.chat_text(F.col("messages"), False, markup)
    text = F.replace(F.replace(text, F.lit("user:"), F.lit("Human:")), F.lit("assistant:"), F.lit("Assistant:"))
    assert parsed.select(text.alias("t")).first().t == TRANSCRIPT


def test_instruction_answer_and_last_turn(spark):
    df = transcripts(spark, TRANSCRIPT, "only one Assistant: x ", "none", "Assistant: a\nAssistant: b", "xAssistant: a Assistant: b")
    got = dialogue.extract_last_answer(dialogue.extract_instruction(df, "chosen"), "chosen").orderBy("id")
    assert col(got, "instruction", "answer") == [
        ("Human: Hi\n\nAssistant: Hello\n\nHuman: Why?", "Because."),
        ("only one Assistant: x", "x"),
        ("none", ""),
        ("Assistant: a", "a\nAssistant: b"),
        ("xAssistant: a Assistant: b", "a Assistant: b"),
    ]
    turns = dialogue.split_last_turn(df, "chosen").orderBy("id")
    assert col(turns, "instruction", "target")[0] == ("Human: Hi\n\nAssistant: Hello\n\nHuman: Why?", "Because.")
    assert col(turns, "instruction", "target")[2] == ("none", "")


# --- prompts and filters


def test_templates(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    row = prompts.render_prompt(prompts.render_prompt(df, "<{a}> {{x}}", "p"), "{b}!", "q").first()
    assert row.p == "<{b}> {x}" and row.q is None
    with pytest.raises(ValueError):
        prompts.render_prompt(df, "{missing}")


def test_suffix_and_empty_suffix(spark):
    df = spark.createDataFrame([("abc", "c"), ("abc", "")], "t string, s string")
    assert col(prompts.strip_known_suffix(df, "t", "s"), "instruction") == [("ab",), ("abc",)]


def test_agreed_safe_and_checks(spark):
    df = spark.createDataFrame(
        [(0, 0, True, False), (1, 1, True, None), (1, 1, False, True), (0, 1, True, True), (1, 1, True, False)],
        "better_response_id int, safer_response_id int, is_response_0_safe boolean, is_response_1_safe boolean",
    )
    assert col(filters.agreed_safe(df), "better_response_id") == [(0,), (1,)]
    checked = filters.check_required(df, ["is_response_1_safe"]).first()
    assert (checked.rows, checked.missing_is_response_1_safe) == (5, 1)
    with pytest.raises(Exception, match="required value"):
        filters.require(df, ["is_response_1_safe"]).collect()
    assert filters.require(df, ["is_response_0_safe"]).count() == 5


# --- BLEU


def test_bleu_cases(spark):
    cases = [
        (0, "a b c d e", "a b c d e"), (1, "a b", "c d"), (2, "a", "a"), (3, "a b c", "a b c d e f"), (4, "", "a b"),
        (5, "a a a a", "a a b b"),
    ]
    df = spark.createDataFrame(cases, "id int, h string, r string").select("id", words("h").alias("h"), words("r").alias("r"))
    got = dict(col(overlap.sentence_bleu(df, "id", "h", "r"), "id", "bleu"))
    assert got[0] == pytest.approx(1.0) and got[1] == 0 and got[2] == pytest.approx(1.0) and got[4] == 0
    assert got[3] == pytest.approx(math.exp(1 - 6 / 3))
    # 2 of 4 unigrams, 1 of 3 bigrams, then smoothing 1/(2*2) and 1/(4*1).
    assert got[5] == pytest.approx((2 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25)
    strict = overlap.corpus_bleu(df.where("id = 2").withColumn("g", F.lit(1)), "id", "h", "r", ["g"], False).first()
    assert strict.bleu == 0


def test_ngram_counts_equal_a_count_of_strings(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice("abc") for _ in range(n)]
    cases = [(i, text(rng.randint(0, 30)), text(rng.randint(0, 30))) for i in range(300)]
    cases += [(300, None, ["a"]), (301, ["a"], None), (302, [], []), (303, ["a", "a\u0001b"], ["a", "a", "b"]), (304, text(30000), text(20000))]
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    want = {
        i: [len(h or []), len(r or []), *[sum((grams(h or [], n) & grams(r or [], n)).values()) for n in range(1, 5)]]
        for i, h, r in cases
    }
    df = spark.createDataFrame(cases, "id int, h array<string>, r array<string>").withColumn("_hyp", F.lit("kept"))
    got = overlap.ngram_counts(df, "id", "h", "r", ["_hyp"]).collect()
    assert {r.id: [r.hyp_len, r.ref_len, r.match_1, r.match_2, r.match_3, r.match_4] for r in got} == want
    assert {r._hyp for r in got} == {"kept"}
    # A NULL token is a token of its own; no rows, no counts.
    nulls = spark.createDataFrame([(1, ["a", None, "b"], [None, "b"])], "id int, h array<string>, r array<string>")
    row = overlap.ngram_counts(nulls, "id", "h", "r").first()
    assert (row.hyp_len, row.match_1, row.match_2, row.total_3) == (3, 2, 1, 1)
    assert overlap.ngram_counts(nulls.where("id = 2"), "id", "h", "r").count() == 0


def test_slices_hold_whole_rows():
    assert list(overlap._slices(np.array([3, 3, 9, 1, 0, 2]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(overlap._slices(np.array([], dtype=int), 6)) == [] and list(overlap._slices(np.array([0, 0]), 6)) == [(0, 2)]


# --- training sets


def test_supervised_examples(spark):
    df = spark.createDataFrame([(1, "say it", "it is"), (2, "go", "it")], "id int, p string, a string")
    vocab = examples.build_vocabulary(df, ["p", "a"])
    ids = dict(col(vocab, "token", "token_id"))
    assert ids == {"it": 1, "go": 2, "is": 3, "say": 4}
    built = {r.id: r for r in examples.supervised_examples(df, "id", "p", "a", vocab, max_len=4).collect()}
    assert built[1].input_ids == [4, 1, 1, 3] and built[1].labels == [-100, -100, 1, 3]
    assert built[2].input_ids == [2, 1, 0] and built[2].labels == [-100, 1, 0]
    assert built[2].attention_mask == [1, 1, 1]


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_supervised_examples_with_few_and_many_frequent_words(spark, monkeypatch, frequent):
    monkeypatch.setattr(examples.frequent_words, "__defaults__", (frequent,))
    rng = random.Random(frequent)
    text = lambda n: " ".join(rng.choice(["the", "a", "Straße", "x" * 90, "rare", f"w{rng.randint(0, 200)}"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 9)), text(rng.randint(0, 60))) for i in range(200)]
    rows += [(200, None, "a"), (201, "a", None), (202, None, None), (203, "", " "), (204, "a", text(20000))]
    df = spark.createDataFrame(rows, "id int, p string, a string")
    vocab = examples.build_vocabulary(df, ["p", "a"]).where("token <> 'w7' and token_id <> 5")
    ids = dict(col(vocab, "token", "token_id"))
    got = {r.id: r for r in examples.supervised_examples(df, "id", "p", "a", vocab, max_len=50).collect()}
    assert len(got) == len(rows)
    for i, p, a in rows:
        # Without a prompt or an answer there is no example, only the end mark.
        tokens = (p.split() + a.split()) if p is not None and a is not None else []
        want = [ids.get(t, -1) for t in tokens] + ([0] if len(tokens) < 50 else [])
        assert got[i].input_ids == want, i
        cut = len(p.split()) if p is not None else None
        if cut is not None:
            assert got[i].labels == [-100 if j < cut else t for j, t in enumerate(want)]


def test_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(2000)
    train, held = examples.split_by_key(df, "id")
    a, b = {r.id for r in train.collect()}, {r.id for r in held.collect()}
    assert not a & b and len(a | b) == 2000 and len(b) == 400
    assert b == {r.id for r in examples.split_by_key(df.orderBy(F.desc("id")), "id")[1].collect()}


def test_split_has_its_exact_size(spark):
    for n, fraction, want in ((7, 0.2, 1), (13, 0.2, 3), (5, 0.1, 1), (4, 0.1, 0), (9, 0.0, 0), (9, 1.0, 9), (0, 0.2, 0), (3000, 0.33, 990)):
        train, held = examples.split_by_key(spark.range(n), "id", fraction, seed=3)
        assert (train.count(), held.count()) == (n - want, want)
    # Rows of one key stay together; rows without a key are never held out.
    rows = spark.createDataFrame([(i // 50 if i % 10 else None,) for i in range(500)], "id int")
    train, held = examples.split_by_key(rows, "id", 0.5)
    assert held.where("id is null").count() == 0 and held.count() == 225 and train.count() == 275
    assert held.groupBy("id").count().where("count <> 45").count() == 0


def test_appends_count_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
    io.append_results(rows([1, 2, 3]), path, "a")
    io.append_results(rows([4]), path, "b")
    io.append_results(rows([1, 2, 3]), path, "a")
    bad = F.udf(lambda i: 1 // (i - 6), "int")
    with pytest.raises(Exception):
        io.append_results(rows([5, 6, 7]).repartition(3).select(bad("id").alias("id")), path, "c")
    assert sorted(col(spark.read.parquet(path), "run", "id")) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]
    io.append_results(rows([5, 6, 7]), path, "c")
    assert spark.read.parquet(path).count() == 7
    lines = io.metric_rows(rows([1, 2]), {"most": F.max("id")}, "r")
    for step in ("one", "one", "two"):
        io.append_metrics(lines, str(tmp_path / "m"), step)
    assert sorted(col(spark.read.parquet(str(tmp_path / "m")), "run", "step", "value")) == [("r", "one", 2.0), ("r", "two", 2.0)]


def test_quantiles_of_values_that_crowd(spark, monkeypatch):
    """Many distinct values next to each other, powers of two, both signs, infinities, ties and single rows."""
    rng = np.random.default_rng(5)
    groups = {
        0: 1 + np.arange(3000) * 1e-13, 1: rng.normal(size=500), 2: np.repeat([-1.5, 0.0, 2.0], [3, 5, 2]), 3: np.array([7.25]),
        4: 2.0 ** rng.integers(-1074, 1023, 300) * np.where(rng.random(300) < 0.5, -1, 1), 5: np.array([1.0, np.inf, np.inf]),
        6: np.array([2.0, 8.0, np.nextafter(8, 0), np.nextafter(8, 9)]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(3, None), (3, math.nan)], "g int, v double")
    for bits, q in ((16, 0.8), (8, 0.37)):
        monkeypatch.setattr(ranking, "_DIGIT_BITS", bits)
        got = {r["g"]: (r["_rows"], r["c"]) for r in ranking.group_quantile(df, "g", "v", q, "c").collect()}
        for g, vs in groups.items():
            vs, at = np.sort(vs), (len(vs) - 1) * q
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            assert got[g] == (len(vs), low if low == high else low + (high - low) * (at - math.floor(at)))


def test_padding_report_with_a_shared_length(spark, monkeypatch):
    monkeypatch.setattr(examples, "_BATCHES_PER_TASK", 3)
    lengths = [5] * 40 + [9, 1, 17]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {r.batch_id: r for r in examples.padding_report(df, "n", 4).collect()}
    ordered = sorted(lengths)
    for i in range(0, len(ordered), 4):
        batch, r = ordered[i:i + 4], got.pop(i // 4)
        padded = -(-max(batch) // 8) * 8
        assert (r.rows, r.max_len, r.padded_len, r.waste) == (
            len(batch), max(batch), padded, padded * len(batch) - sum(batch)
        )
    assert not got


def test_bidirectional_alternates(spark):
    df = spark.createDataFrame([(1, "long one", "x"), (2, "ab", "cd")], "pair_id int, src string, ref string")
    rows = bitext.bidirectional(df, "pair_id").orderBy("seq").collect()
    assert [(r.pair_id, r.direction, r.src) for r in rows] == [
        (2, "forward", "ab"), (2, "backward", "cd"), (1, "forward", "long one"), (1, "backward", "x"),
    ]


# --- rewards


def test_rewards_nan_null_and_constant_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("g", 1.0, nan), ("g", 3.0, 2.0), ("one", 5.0, nan), ("none", nan, None), ("none", nan, None)],
        "g string, a double, b double",
    )
    combined = rollouts.combine_rewards(df, {"a": 1.0, "b": 0.5})
    assert sorted(col(combined, "g", "reward")) == [("g", 1.0), ("g", 4.0), ("none", 0.0), ("none", 0.0), ("one", 5.0)]
    plain = rollouts.group_advantages(combined, "g", "reward", scale=False)
    assert all(abs(s) < 1e-12 for _, s in col(plain.groupBy("g").agg(F.sum("advantage").alias("s")), "g", "s"))
    scaled = {(r.g, r.reward): r for r in rollouts.group_advantages(combined, "g", "reward").collect()}
    assert scaled["one", 5.0].advantage == 0 and scaled["one", 5.0].zero_std
    assert scaled["g", 4.0].advantage == pytest.approx(1.5 / (math.sqrt(4.5) + 1e-4))
    report = dict(col(rollouts.reward_report(combined, "g", "reward", ["a", "b"]), "metric", "value"))
    assert report["rewards/b/mean"] == 2.0 and report["frac_reward_zero_std"] == pytest.approx(2 / 3)
    assert report["reward"] == 2.0 and report["reward_std"] == pytest.approx(2 * math.sqrt(4.5) / 5)


def test_completion_mask_and_report(spark):
    df = spark.createDataFrame([(1, [3, 0, 4]), (2, [3, 4, 5])], "id int, ids array<long>")
    masked = rollouts.completion_mask(df, "ids", 0, mask_truncated=True).orderBy("id")
    assert col(masked, "kept_ids", "length", "terminated", "mask_sum") == [([3, 0], 2, True, 2), ([3, 4, 5], 3, False, 0)]
    report = rollouts.completion_report(masked).first()
    assert report.clipped_ratio == 0.5 and report.max_terminated_length == 2
    none = rollouts.completion_report(masked.where("not terminated")).first()
    assert none.clipped_ratio == 1 and none.mean_terminated_length == 0


def test_consecutive_repeats_collapse_across_blocks(spark):
    df = spark.createDataFrame(list(enumerate("aabbbaacc")), "i int, v string").withColumn("g", F.lit(0))
    kept = rollouts.drop_consecutive(df, ["g"], "v", "i", F.expr("i div 2")).orderBy("i")
    assert [v for (v,) in col(kept, "v")] == list("abac")


def test_reward_specs_accept_an_arrow_scorer(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def halves(x: pd.Series) -> pd.Series:
        return x / 2

    df = spark.createDataFrame([(2.0,), (4.0,)], "x double")
    specs = [rollouts.RewardSpec("half", lambda d: halves(d["x"]), 2.0), rollouts.RewardSpec("one", lambda d: F.lit(1.0))]
    assert col(rollouts.apply_rewards(df, specs), "reward") == [(3.0,), (5.0,)]


# --- token diagnostics


def tokens(spark):
    rows = [(s, s % 2, -1.0 - s - p / 10, -1.2 - s, -0.9 - s, 0.5 * p + s, int(p != 1), float(1 - s)) for s in range(3) for p in range(4)]
    return spark.createDataFrame(
        rows, "seq_id int, batch_id int, logp double, old_logp double, ref_logp double, entropy double, mask int, advantage double"
    )


def test_absent_old_logp_means_ratio_one(spark):
    df = tokens(spark).withColumn("old_logp", F.lit(None).cast("double"))
    assert {r for (r,) in col(policy.importance_ratio(df), "ratio")} == {1.0}


def test_objective_by_hand(spark):
    rows = tokens(spark).collect()
    losses = {}
    for b in (0, 1):
        means = []
        for s in {r.seq_id for r in rows if r.batch_id == b}:
            mine = [r for r in rows if r.seq_id == s]
            loss = 0.0
            for r in mine:
                ratio = math.exp(r.logp - r.old_logp)
                clipped = min(max(ratio, 0.8), 1.2)
                d = r.ref_logp - r.logp
                loss += r.mask * (-min(ratio * r.advantage, clipped * r.advantage) + 0.1 * (math.exp(d) - d - 1))
            means.append(loss / sum(r.mask for r in mine))
        losses[b] = sum(means) / len(means)
    got = dict(col(policy.clipped_objective(tokens(spark), beta=0.1), "batch_id", "loss"))
    assert got == pytest.approx(losses)
    with pytest.raises(ValueError):
        policy.clipped_objective(tokens(spark), "other")


def test_sequence_level_report_averages_sequences(spark):
    row = policy.clip_report(tokens(spark), 0.01, 0.01, level=policy.SEQUENCE).first()
    flags = policy.importance_ratio(tokens(spark), policy.SEQUENCE).select(
        "seq_id", "batch_id", ((F.col("ratio") > 1.01) & (F.col("advantage") > 0)).alias("h")
    ).distinct()
    share = {}
    for s, b, h in flags.collect():
        share.setdefault(b, []).append(h)
    assert row.high_mean == pytest.approx(sum(sum(v) / len(v) for v in share.values()) / len(share))


# --- judging


def test_scoreboard_and_rates(spark):
    rows = [
        (1, "A", '{"better_answer": "A"}'), (1, "B", '{"better_answer": "B"}'),
        (2, "A", '{"better_answer": "B"}'), (2, "B", '{"better_answer": "C"}'),
        (3, "A", '{"better_answer": "Z"}'), (4, "A", '{"better_answer": "A"'), (5, "A", "{}"),
    ]
    parsed = judging.parse_verdicts(spark.createDataFrame(rows, "idx int, target string, raw string"), "raw")
    board = judging.pair_scoreboard(parsed)
    assert sorted(col(board, "idx", "net", "outcome")) == [(1, 2, "win"), (2, -1, "lost"), (3, 0, "tie")]
    dataset = spark.range(1, 7).select(F.col("id").cast("int").alias("idx"), F.lit("s").alias("subset"))
    r = judging.win_rates(board, dataset).first()
    assert (r.win, r.lost, r.tie, r.total, r.invalid) == (1 / 6, 1 / 6, 1 / 6, 6, 3)


# --- sources and streams


def test_json_templates_and_metrics(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"user_prompt": "{question}"}))
    assert io.read_templates(spark, str(tmp_path / "t.json")) == {"user_prompt": "{question}"}
    (tmp_path / "r.json").write_text('{"a": 1}\nbroken\n')
    rows = io.read_json_records(spark, str(tmp_path / "r.json"), spark.createDataFrame([], "a int").schema)
    assert sorted(str(x) for x in col(rows, "a", io.CORRUPT)) == ["(1, None)", "(None, 'broken')"]
    df = spark.createDataFrame([("s", 1.0), ("s", 3.0)], "subset string, x double")
    path = str(tmp_path / "m")
    io.append_metrics(io.metric_rows(df, {"x/mean": F.avg("x")}, "run-1", "subset"), path)
    io.append_metrics(io.metric_rows(df, {"x/max": F.max("x")}, "run-2"), path)
    assert sorted(col(spark.read.parquet(path), "run", "subset", "metric", "value")) == [
        ("run-1", "s", "x/mean", 2.0), ("run-2", "all", "x/max", 3.0),
    ]


def test_streamed_scoring_resumes_by_key(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = spark.createDataFrame([], "id long, t string").schema
    calls = []

    def score(df):
        calls.append(df.count())
        return df.select("id", F.length("t").alias("n"))

    for ids in (range(0, 6), range(3, 10)):
        spark.createDataFrame([(i, "x" * i) for i in ids], schema).write.mode("append").parquet(source)
        incremental.append_unscored_stream(spark, source, schema, out, progress, "id", score).awaitTermination()
    assert sorted(col(spark.read.parquet(out), "id", "n")) == [(i, i) for i in range(10)]
    assert calls == [6, 4]


def test_streamed_scoring_reads_nothing_of_earlier_results(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = spark.createDataFrame([], "id long, t string").schema
    for run, ids in enumerate((range(0, 20), range(10, 30), range(25, 32))):
        spark.createDataFrame([(i, "x" * i) for i in ids], schema).write.mode("append").parquet(source)
        incremental.append_unscored_stream(spark, source, schema, out, progress, "id", lambda df: df.select("id")).awaitTermination()
        for part in (tmp_path / "out").rglob("*.parquet"):
            if run < 2 and part.stat().st_size:
                # Results that are gone would be missed by whoever reads them.
                (tmp_path / f"kept-{run}-{part.name}").write_bytes(part.read_bytes())
                part.write_bytes(b"")
    last = sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "out").glob("batch=*"))[-1]
    assert sorted(r.id for r in spark.read.parquet(f"{out}/batch={last}").collect()) == [30, 31]


def test_board_is_one_snapshot_and_the_changes_since(spark, tmp_path, monkeypatch):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rng, net = random.Random(2), {}
    schema = spark.createDataFrame([], "idx long, target string, output string").schema
    for run in range(7):
        rows = [(rng.randrange(12), rng.choice("AB"), rng.choice("ABC")) for _ in range(9)]
        for i, target, given in rows:
            net[i] = net.get(i, 0) + (0 if given == "C" else 1 if given == target else -1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        board = incremental.scoreboard_stream(spark.readStream.schema(schema).parquet(source))
        incremental.keep_board(board, out, progress, compact_every=3).awaitTermination()
        whole = judging.pair_scoreboard(spark.read.schema(schema).parquet(source)).select("idx", "net", "outcome")
        assert sorted(map(tuple, incremental.read_board(spark, out).collect())) == sorted(map(tuple, whole.collect()))
    read = incremental.read_board(spark, out)
    assert {r.idx: r.net for r in read.collect()} == net
    before = sorted(map(tuple, read.collect()))

    def lose(folders):
        # Files without content would fail whoever reads them.
        for folder in folders:
            for part in (tmp_path / "out" / folder).glob("*.parquet"):
                part.write_bytes(b"")

    # Seven batches: a read needs the snapshot of the first six, and one folder of changes.
    lose([f"changes/n={n}" for n in range(6)] + ["snapshots/upto=2"])
    assert sorted(map(tuple, incremental.read_board(spark, out).collect())) == before
    # A compaction that ends before its pointer is written changes nothing, and may be run again.
    (tmp_path / "out" / "snapshots" / "upto=6").mkdir()
    (tmp_path / "out" / "snapshots" / "upto=6" / "part-0.parquet").write_bytes(b"")
    assert sorted(map(tuple, incremental.read_board(spark, out).collect())) == before
    for _ in range(2):
        incremental.compact_board(spark, out, 6)
        assert sorted(map(tuple, incremental.read_board(spark, out).collect())) == before
    lose(["changes/n=6", "snapshots/upto=5"])
    assert sorted(map(tuple, incremental.read_board(spark, out).collect())) == before


def test_tasks(spark):
    with pytest.raises(ValueError):
        prepare_task("other", spark.range(1))
    df = spark.createDataFrame([(1, TRANSCRIPT), (2, "bad")], "id int, chosen string")
    rows = prepare_task("dialogue", df)
    assert col(rows, "id", "malformed") == [(1, False), (2, True)]
    assert col(rows.where("not malformed"), "id", "better_answer") == [(1, "Because.")]


def test_missing_rewards_leave_their_group_alone(spark):
    rows = [(1, 1.0), (1, 3.0), (1, float("nan")), (1, None), (2, None), (3, 5.0)]
    df = spark.createDataFrame(rows, "g int, r double")
    got = sorted((r.g, repr(r.r), r.advantage) for r in rollouts.group_advantages(df, "g", "r", scale=False).collect())
    assert got == [(1, "1.0", -1.0), (1, "3.0", 1.0), (1, "None", None), (1, "nan", None), (2, "None", None), (3, "5.0", 0.0)]
    scaled = {repr(r.r): r.scaled for r in rollouts.minmax_scale(df.where("g = 1"), "r").collect()}
    assert scaled == {"1.0": 0.0, "3.0": 1.0, "nan": None, "None": None}


def test_a_null_verdict_is_a_tie(spark):
    raw = [(1, "A", '{"better_answer": null}'), (2, "A", '{"other": 1}'), (3, "A", "{"), (4, "A", '{"better_answer": "A"}')]
    df = spark.createDataFrame(raw, "idx int, target string, raw string")
    parsed = judging.parse_verdicts(df, "raw")
    assert {r.idx: r.output for r in parsed.collect()} == {1: "", 2: None, 3: None, 4: "A"}
    assert {r.idx: r.outcome for r in judging.pair_scoreboard(parsed).collect()} == {1: "tie", 4: "win"}


def test_requests_for_a_chat_judge(spark):
    df = spark.createDataFrame([(1, "q", "x", "y")], "idx int, question string, answer string, other string")
    rows = judging.judge_requests(df, "{question}|{answer_a}|{answer_b}", system="be fair").orderBy("target").collect()
    assert [[tuple(m) for m in r.messages] for r in rows] == [
        [("system", "be fair"), ("user", "q|x|y")], [("system", "be fair"), ("user", "q|y|x")],
    ]


def test_runs_collapse_across_stretches_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(rollouts, "_PIECES", 2)
    values = [v for v in "aabbbacccccab" for _ in range(3)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, at int, v string")
    kept = rollouts.drop_consecutive(df, ["g"], "v", "at", F.expr("at div 2")).orderBy("at").collect()
    want = [i for i, v in enumerate(values) if i == 0 or values[i - 1] != v]
    assert [r.at for r in kept] == want


def test_running_totals_over_levels(spark):
    df = spark.createDataFrame([(i * 3, i) for i in range(100)], "at bigint, n bigint")
    for levels in (1, 2, 3):
        got = {r["at"]: r["s"] for r in ranking.running_total(df, "at", "n", "s", 4, levels).collect()}
        assert got == {i * 3: i * (i + 1) // 2 for i in range(100)}


def test_translation_tokens(spark):
    from alignframe.functions.text import translation_tokens

    df = spark.createDataFrame([('He said: "3.5, or 1,000-2?" (maybe).',)], "t string")
    assert df.select(translation_tokens("t").alias("w")).first().w == ["He", "said", ":", '"', "3.5", ",", "or", "1,000", "-", "2", "?", '"', "(", "maybe", ")", "."]


def test_message_without_content_stays(spark):
    df = spark.createDataFrame([([("user", None), ("assistant", "x")],)], "m array<struct<role:string,content:string>>")
    assert prompts.render_chat(df, "m", False).first().prompt == "<|user|>\n\n<|assistant|>\nx\n"
