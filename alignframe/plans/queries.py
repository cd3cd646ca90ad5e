"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from alignframe.functions import logic
from alignframe.functions.text import translation_tokens
from alignframe.operators import (
    bitext,
    dialogue,
    equivalence,
    examples,
    filters,
    judging,
    overlap,
    policy,
    prompts,
    ranking,
    rollouts,
)
from alignframe.plans import fixtures as fx
from alignframe.plans.tasks import prepare_task, task_reward
from alignframe.session import cut, fresh_path, joined_rows
from alignframe.sources import io
from alignframe.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Own wording; a user passes the judge's templates from a configuration file.
JUDGE_TEMPLATE = "Question:\n{question}\n\nAnswer A:\n{answer_a}\n\nAnswer B:\n{answer_b}\n"
SHORT_JUDGE_TEMPLATE = "Task: {input}\nOutput (a): {output_1}\nOutput (b): {output_2}\nWhich is better?"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- sources and sinks


@query("a1_read_parquet_set")
def a1(spark, d):
    paths = []
    for k in range(2):
        path = fresh_path(spark, "labels")
        fx.table(spark, d, "labels").where(F.col("doc_id") % 2 == k).write.parquet(path)
        paths.append(path)
    return io.read_parquet_set(spark, paths)


@query("a2_read_json_records")
def a2(spark, d):
    path = fresh_path(spark, "claims")
    fx.summaries(spark, d).select("doc_id", "claim", "label").write.json(path)
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("claim", StringType()), StructField("label", StringType())]
    )
    return io.read_json_records(spark, path, schema).where(F.col(io.CORRUPT).isNull()).drop(io.CORRUPT)


@query("a3_read_subsets")
def a3(spark, d):
    """Four subsets in four files; a subset that is read from another one's file has other rows."""
    names = ["helpful-base", "helpful-online", "helpful-rejection-sampled", "harmless-base"]
    paths = {name: fresh_path(spark, name) for name in names}
    for k, name in enumerate(names):
        fx.table(spark, d, "documents").where(F.col("doc_id") % 4 == k).write.parquet(paths[name])
    return io.read_subsets(spark, paths).groupBy("subset", "lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars")
    )


@query("a4_append_unscored")
def a4(spark, d):
    """What is left after one run, which was tried twice, and another one."""
    inputs = fx.summaries(spark, d).select("doc_id", "claim")
    path = fresh_path(spark, "done")
    for run, rest in (("first", 0), ("first", 0), ("second", 1)):
        io.append_results(inputs.where(F.col("doc_id") % 4 == rest).select("doc_id"), path, run)
    done = spark.read.parquet(path)
    once = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times = 1")
    return io.append_unscored(inputs, once, "doc_id")


@query("a5_metric_rows")
def a5(spark, d):
    metrics = {
        "reward/mean": F.avg("l_discount"), "reward/max": F.max("l_discount"), "rows": F.count(F.lit(1)),
    }
    lines = io.metric_rows(fx.table(spark, d, "lineitem"), metrics, "run-1", "l_returnflag")
    path = fresh_path(spark, "metrics")
    for _ in range(2):
        # A run that is tried again replaces its lines.
        io.append_metrics(lines, path)
    return spark.read.parquet(path).select("run", "subset", "metric", r6("value").alias("value"))


# --- filters and checks


@query("b1_agreed_safe")
def b1(spark, d):
    return filters.agreed_safe(fx.pref_pairs(spark, d)).select("pair_id", "better_response_id", "lang")


@query("b2_label_is")
def b2(spark, d):
    return filters.label_is(fx.summaries(spark, d), "label", "faithful").select("doc_id", "label")


@query("b3_length_between")
def b3(spark, d):
    kept = filters.length_between(
        fx.summaries(spark, d), {"document": (200, 8096), "claim": (None, 200)}, {"document": ["license", "eau"]}
    )
    return kept.select("doc_id", F.length("document").cast("bigint").alias("chars"))


@query("b4_nonempty")
def b4(spark, d):
    answers = dialogue.split_last_turn(fx.transcripts(spark, d), "chosen")
    return filters.nonempty(answers, "target").select("conv_id", F.length("target").cast("bigint").alias("chars"))


@query("b5_check_required")
def b5(spark, d):
    return filters.check_required(fx.pref_pairs(spark, d), ["prompt", "response_0", "is_response_0_safe"])


@query("b6_within_formula_budget")
def b6(spark, d):
    return filters.within_formula_budget(fx.formula_pairs(spark, d), "pred").select("pair_id", "in_budget")


# --- prompts


@query("c1_render_prompt")
def c1(spark, d):
    texts = fx.summaries(spark, d)
    claims = prompts.render_prompt(texts, prompts.CLAIM_TO_FORMULA, "claim_prompt")
    both = prompts.render_prompt(claims, prompts.PASSAGE_TO_FORMULA, "document_prompt")
    return both.select("doc_id", "claim_prompt", F.md5("document_prompt").alias("document_prompt"))


@query("c2_pick_preferred")
def c2(spark, d):
    return prompts.pick_preferred(fx.pref_pairs(spark, d)).select(
        "pair_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected")
    )


@query("c3_render_chat")
def c3(spark, d):
    parsed = dialogue.parse_transcript(fx.transcripts(spark, d), "chosen")
    return prompts.render_chat(parsed, "messages").select("conv_id", "prompt")


@query("c4_strip_known_suffix")
def c4(spark, d):
    answers = dialogue.extract_last_answer(fx.transcripts(spark, d), "chosen")
    return prompts.strip_known_suffix(answers, "chosen", "answer").select("conv_id", "instruction")


# --- dialogue


@query("d1_parse_transcript")
def d1(spark, d):
    parsed = dialogue.parse_transcript(fx.transcripts(spark, d), "chosen")
    return parsed.select(
        "conv_id", "malformed", F.size("messages").cast("bigint").alias("n"),
        prompts.chat_text(F.col("messages"), False).alias("chat"),
    )


@query("d2_split_last_turn")
def d2(spark, d):
    return dialogue.split_last_turn(fx.transcripts(spark, d), "chosen").select("conv_id", "instruction", "target")


@query("d3_extract_instruction")
def d3(spark, d):
    return dialogue.extract_instruction(fx.transcripts(spark, d), "chosen").select("conv_id", "instruction")


@query("d4_extract_last_answer")
def d4(spark, d):
    return dialogue.extract_last_answer(fx.transcripts(spark, d), "rejected").select("conv_id", "answer")


@query("d5_preference_triples")
def d5(spark, d):
    return dialogue.preference_triples(fx.transcripts(spark, d)).select("conv_id", "prompt", "chosen", "rejected")


@query("d6_paired_messages")
def d6(spark, d):
    chat = lambda c: prompts.chat_text(F.col(c), False).alias(c)
    return dialogue.paired_messages(fx.transcripts(spark, d)).select(
        "conv_id", "malformed", chat("message_instruction"), chat("message_chosen"), chat("message_rejected")
    )


@query("d6_label_pairs")
def d6_label_pairs(spark, d):
    return dialogue.label_pairs(fx.transcripts(spark, d)).select("conv_id", "malformed", "prompt", "better_answer")


# --- supervised examples, splits, orders


def _claim_prompts(spark, d):
    return prompts.render_prompt(fx.summaries(spark, d), prompts.CLAIM_TO_FORMULA)


@query("e1_supervised_examples")
def e1(spark, d):
    texts = _claim_prompts(spark, d)
    vocab = examples.build_vocabulary(texts, ["prompt", "document"])
    built = examples.supervised_examples(texts, "doc_id", "prompt", "document", vocab)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return built.select("doc_id", text("input_ids"), text("labels"), F.size("attention_mask").cast("bigint").alias("n"))


@query("e2_split_by_key")
def e2(spark, d):
    train, held_out = examples.split_by_key(fx.summaries(spark, d).select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(held_out.withColumn("part", F.lit("test")))


@query("e3_seeded_order")
def e3(spark, d):
    keys = fx.table(spark, d, "orders").select("o_orderkey")
    return ranking.number_rows(examples.seeded_order(keys, "o_orderkey", 0))


@query("e3_length_order")
def e3_length(spark, d):
    ordered = examples.length_order(fx.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return ranking.number_rows(ordered.select("doc_id"))


@query("e4_padding_report")
def e4(spark, d):
    lengths = fx.table(spark, d, "documents").select(F.length("text").alias("chars"))
    return examples.padding_report(lengths, "chars", batch_size=16)


@query("e5_preview")
def e5(spark, d):
    return examples.preview(_claim_prompts(spark, d).select("doc_id", "prompt"), "doc_id", 3)


# --- translation pairs


@query("f1_bidirectional")
def f1(spark, d):
    return bitext.bidirectional(fx.bitext(spark, d), "pair_id").select(
        "pair_id", "direction", "seq", F.md5("prompt").alias("prompt"), F.md5("ref").alias("ref")
    )


@query("f2_translation_evaluation")
def f2_evaluation(spark, d):
    pairs = fx.token_pairs(spark, d, translation_tokens).withColumn("quality", (F.col("pair_id") % 10) / 10)
    scored = bitext.translation_evaluation(pairs, "pair_id", "hyp", "ref", "batch_id", "quality")
    return scored.withColumns({"bleu": r6("bleu"), "quality": r6("quality")})


@query("f2_by_direction")
def f2(spark, d):
    pairs = fx.token_pairs(spark, d).withColumn("length", F.size("hyp").cast("bigint"))
    scored = overlap.sentence_bleu(pairs, "pair_id", "hyp", "ref", ["direction", "length"])
    metrics = {"bleu": r6(F.avg("bleu")), "best": r6(F.max("bleu")), "tokens": F.sum("length")}
    return bitext.by_direction(scored, metrics)


# --- text overlap


@query("g1_sentence_bleu")
def g1(spark, d):
    return overlap.sentence_bleu(fx.token_pairs(spark, d), "pair_id", "hyp", "ref").select("pair_id", r6("bleu").alias("bleu"))


@query("g2_corpus_bleu")
def g2(spark, d):
    return overlap.corpus_bleu(fx.token_pairs(spark, d), "pair_id", "hyp", "ref", ["direction"]).withColumn("bleu", r6("bleu"))


@query("g3_batch_weighted_bleu")
def g3(spark, d):
    scored = overlap.batch_weighted_bleu(fx.token_pairs(spark, d), "pair_id", "hyp", "ref", "batch_id", ["direction"])
    return scored.withColumn("bleu", r6("bleu"))


@query("g4_blend_scores")
def g4(spark, d):
    scored = overlap.sentence_bleu(fx.token_pairs(spark, d), "pair_id", "hyp", "ref")
    with_quality = scored.withColumn("quality", (F.col("pair_id") % 10) / 10)
    return overlap.blend_scores(with_quality, ["bleu", "quality"]).select("pair_id", r6("score").alias("score"))


# --- formulas


def _literals(spark, d, column):
    return equivalence.formula_literals(fx.formula_pairs(spark, d), "pair_id", column)


def _read_pairs(spark, d):
    return equivalence.read_literals(fx.formula_pairs(spark, d), "pred", "gold").select("pair_id", "_lits_pred", "_lits_gold")


def _similarity(spark, d, read=None):
    read = _read_pairs(spark, d) if read is None else read
    of = lambda column: equivalence.formula_literals(read, "pair_id", column)
    return equivalence.literal_similarity(of("pred"), of("gold"), vectors=fx.literal_vectors(spark, d, read))


def _scored_formulas(spark, d, threshold=None):
    pairs = equivalence.read_formulas(fx.formula_pairs(spark, d))
    sim = equivalence.formula_similarity(pairs, vectors=fx.literal_vectors(spark, d, pairs))
    return equivalence.logical_equivalence(pairs, sim, threshold=threshold)


@query("h1_formula_tokens")
def h1(spark, d):
    return equivalence.formula_tokens(fx.formula_pairs(spark, d), "pred").select(
        "pair_id", F.array_join("tokens", " ").alias("tokens"), "normalized"
    )


@query("h2_hoist_quantifiers")
def h2(spark, d):
    moved = fx.formula_pairs(spark, d).withColumn("mixed", F.concat("pred", F.lit(" → "), "gold"))
    return equivalence.hoist_quantifiers(moved, "mixed").select("pair_id", "hoisted")


@query("h3_formula_literals")
def h3(spark, d):
    return _literals(spark, d, "pred").withColumn("pos", F.col("pos").cast("bigint"))


@query("h4_literal_similarity")
def h4(spark, d):
    return _similarity(spark, d).select("pair_id", "gold", "pred", r6("similarity").alias("similarity"))


@query("h4_literal_similarity_edit")
def h4_edit(spark, d):
    sim = equivalence.literal_similarity(_literals(spark, d, "pred"), _literals(spark, d, "gold"), method="edit")
    return sim.select("pair_id", "gold", "pred", r6("similarity").alias("similarity"))


@query("h5_best_literal_match")
def h5(spark, d):
    return equivalence.best_literal_match(_similarity(spark, d)).select("pair_id", "gold", "pred")


@query("h6_truth_agreement")
def h6(spark, d):
    """Every prediction against its gold formula, literals bound by position; a pair without a score says why."""
    pairs = equivalence.read_formulas(fx.formula_pairs(spark, d))
    fits = logic.in_budget("gold") & logic.in_budget("pred")
    read = pairs.where("_gold_read.ord is not null and _pred_read.ord is not null").select(
        "pair_id",
        F.col("_gold_read.ord").alias("gold_order"),
        F.col("_pred_read.ord").alias("pred_order"),
        F.transform("_gold_read.lits", lambda _, i: i).alias("gold_vars"),
        F.transform("_pred_read.lits", lambda _, i: i).alias("pred_vars"),
    )
    bound = read.withColumn("variables", F.greatest(F.size("gold_vars"), F.size("pred_vars")))
    scored = equivalence.truth_agreement(bound, ["pair_id"]).withColumn("score", r6("score"))
    reason = (
        F.when(~F.col("fits"), equivalence.OVER_BUDGET)
        .when(F.col("scored").isNull(), "not well formed")
        .when(F.col("score").isNull(), equivalence.TOO_WIDE)
    )
    named = scored.withColumn("scored", F.lit(True))
    return joined_rows(pairs.select("pair_id", fits.alias("fits")), named, "pair_id", "left").select("pair_id", "score", reason.alias("reason"))


@query("h7_candidate_bindings")
def h7(spark, d):
    read = _read_pairs(spark, d)
    best = equivalence.best_literal_match(_similarity(spark, d, read))
    claims = best.groupBy("pair_id").agg(F.sort_array(F.array_agg(F.struct("gold_pos", "pred_pos"))).alias("m"))
    sizes = read.select("pair_id", F.size("_lits_pred").alias("pred_count"))
    matched = joined_rows(claims, sizes, "pair_id").select(
        "pair_id", F.transform("m", lambda m: m["pred_pos"]).alias("claims"), "pred_count"
    )
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-").alias(c)
    return equivalence.candidate_bindings(matched).select(
        "pair_id", "binding_id", text("gold_pred"), text("pred_vars"), F.col("variables").cast("bigint").alias("variables")
    )


@query("h8_logical_equivalence")
def h8(spark, d):
    return _scored_formulas(spark, d).select(
        "pair_id", r6("score").alias("score"), F.array_join("gold_binding", " ").alias("gold_binding"),
        F.array_join("pred_binding", " ").alias("pred_binding"),
    )


@query("h8_logical_equivalence_threshold")
def h8_threshold(spark, d):
    return _scored_formulas(spark, d, logic.SIMILARITY_FLOOR).select("pair_id", r6("score").alias("score"))


@query("h9_logical_equivalence_permuted")
def h9(spark, d):
    return equivalence.logical_equivalence_permuted(fx.formula_pairs(spark, d)).select(
        "pair_id", r6("score").alias("score"), F.array_join("pred_binding", " ").alias("pred_binding")
    )


@query("h10_formula_reward")
def h10(spark, d):
    pairs = equivalence.read_formulas(fx.formula_pairs(spark, d))
    sim = equivalence.formula_similarity(pairs, vectors=fx.literal_vectors(spark, d, pairs))
    return equivalence.formula_reward(pairs, sim).select(
        "pair_id", *[r6(c).alias(c) for c in ("equivalence", "bleu", "reward")]
    )


def _text_formulas(spark, d):
    """Rollout texts named after formulas, and the table that translates them."""
    pairs = fx.formula_pairs(spark, d)
    named = pairs.select(
        F.concat(F.lit("answer "), F.col("pair_id")).alias("completion"),
        F.concat(F.lit("label "), F.col("pair_id")).alias("reference"),
        "pred",
        "gold",
    )
    formulas = named.select(F.col("completion").alias("text"), F.col("pred").alias("formula")).unionByName(
        named.select(F.col("reference").alias("text"), F.col("gold").alias("formula"))
    )
    rolled = fx.rollouts(spark, d).select(
        "prompt_id", "part_id", "line_no",
        # Some completions were never turned into formulas.
        F.concat(F.when(F.col("part_id") % 50 == 7, "unknown ").otherwise("answer "), F.col("part_id")).alias("completion"),
        F.concat(F.lit("label "), F.col("part_id")).alias("reference"),
    )
    return rolled, formulas


@query("h11_preference_reward")
def h11(spark, d):
    rolled, formulas = _text_formulas(spark, d)
    rewarded = equivalence.preference_reward(rolled, formulas, fx.literal_vectors(spark, d))
    return rewarded.select("prompt_id", "part_id", "line_no", r6("reward").alias("reward"))


@query("h12_formula_evaluation")
def h12(spark, d):
    scored = joined_rows(fx.formula_pairs(spark, d), _scored_formulas(spark, d).select("pair_id", "score"), "pair_id")
    batched = scored.withColumn("batch_id", F.expr("pair_id div 16"))
    return equivalence.formula_evaluation(batched).select("rows", r6("LE").alias("LE"), r6("bleu").alias("bleu"))


# --- rollouts and rewards


def _combined(spark, d):
    return rollouts.combine_rewards(fx.rollouts(spark, d), {"reward_a": 1.0, "reward_b": 5.0})


_ROLLOUT_KEY = ["prompt_id", "part_id", "supp_id", "line_no"]


@query("i1_dedupe_references")
def i1(spark, d):
    refs = fx.rollouts(spark, d).select("prompt_id", F.struct("line_no", "part_id", "supp_id").alias("at"), "part_id")
    return rollouts.dedupe_references(refs, "prompt_id", "part_id", "at")


@query("i1_drop_consecutive")
def i1_consecutive(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("one"))
    block = F.expr("o_orderkey div 4096")
    kept = rollouts.drop_consecutive(orders, ["one"], "o_orderstatus", "o_orderkey", block)
    return kept.select("o_orderkey", "o_orderstatus")


@query("i2_attach_references")
def i2(spark, d):
    refs = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("reference")
    )
    attached = rollouts.attach_references(fx.rollouts(spark, d), refs, "prompt_id", "reference")
    return attached.select(*_ROLLOUT_KEY, "reference")


@query("i2_unmatched_references")
def i2_unmatched(spark, d):
    refs = fx.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("reference")
    )
    attached = rollouts.attach_references(fx.rollouts(spark, d), refs, "prompt_id", "reference")
    return rollouts.unmatched_references(attached, "reference")


@query("i3_first_per_group")
def i3(spark, d):
    rows = fx.rollouts(spark, d).withColumn("at", F.struct("line_no", "part_id", "supp_id"))
    return rollouts.first_per_group(rows, "prompt_id", "at").select("prompt_id", "line_no", "part_id", "supp_id")


@query("i4_combine_rewards")
def i4(spark, d):
    return _combined(spark, d).select(*_ROLLOUT_KEY, r6("reward").alias("reward"))


@query("i5_group_advantages")
def i5(spark, d):
    scored = rollouts.group_advantages(_combined(spark, d), "prompt_id", "reward")
    return scored.select(*_ROLLOUT_KEY, r6("advantage").alias("advantage"), "zero_std")


@query("i5_group_advantages_missing")
def i5_missing(spark, d):
    """A reward that does not apply to all rows of a group."""
    scored = rollouts.group_advantages(fx.rollouts(spark, d), "prompt_id", "reward_b")
    # Adding 0 leaves no negative zero.
    return scored.select(*_ROLLOUT_KEY, (r6("advantage") + F.lit(0.0)).alias("advantage"), "zero_std")


@query("i6_reward_report")
def i6(spark, d):
    report = rollouts.reward_report(_combined(spark, d), "prompt_id", "reward", ["reward_a", "reward_b"])
    return report.withColumn("value", r6("value"))


@query("i7_completion_mask")
def i7(spark, d):
    masked = rollouts.completion_mask(fx.completions(spark, d), "ids", 0, mask_truncated=True)
    return masked.select(
        "prompt_id", "part_id", "line_no", F.array_join(F.col("kept_ids").cast("array<string>"), ",").alias("kept_ids"),
        "length", "terminated", "mask_sum",
    )


@query("i8_completion_report")
def i8(spark, d):
    report = rollouts.completion_report(rollouts.completion_mask(fx.completions(spark, d), "ids", 0))
    return report.withColumns({c: r6(c) for c in ("mean_length", "clipped_ratio", "mean_terminated_length")})


@query("i9_minmax_scale")
def i9(spark, d):
    scaled = rollouts.minmax_scale(fx.rollouts(spark, d), "reward_a", "prompt_id", "in_group")
    scaled = rollouts.minmax_scale(scaled, "reward_a", None, "in_table")
    return scaled.select(*_ROLLOUT_KEY, r6("in_group").alias("in_group"), r6("in_table").alias("in_table"))


@query("i9_minmax_scale_missing")
def i9_missing(spark, d):
    scaled = rollouts.minmax_scale(fx.rollouts(spark, d), "reward_b", "prompt_id", "in_group")
    scaled = rollouts.minmax_scale(scaled, "reward_b", None, "in_table")
    return scaled.select(*_ROLLOUT_KEY, r6("in_group").alias("in_group"), r6("in_table").alias("in_table"))


@query("i10_tokens_seen")
def i10(spark, d):
    masked = rollouts.completion_mask(fx.completions(spark, d), "ids", 0)
    return rollouts.tokens_seen(masked.withColumn("step", F.expr("prompt_id div 16")), "step", "length")


@query("m1_apply_rewards")
def m1(spark, d):
    specs = [
        rollouts.RewardSpec("discount", lambda df: df["reward_a"] / 2, 1.0),
        rollouts.RewardSpec("tax", lambda df: df["reward_b"], 2.0),
    ]
    scored = rollouts.apply_rewards(fx.rollouts(spark, d), specs)
    return scored.select(*_ROLLOUT_KEY, r6("discount").alias("discount"), r6("reward").alias("reward"))


@query("m1_translation_reward")
def m1_translation(spark, d):
    pairs = fx.token_pairs(spark, d).withColumn("quality", (F.col("pair_id") % 10) / 10)
    return task_reward("translation", pairs).select("pair_id", r6("reward").alias("reward"))


# --- token diagnostics

_TOKEN_KEY = ["seq_id", "pos", "part_id"]


@query("j1_token_kl")
def j1(spark, d):
    return policy.token_kl(fx.token_stats(spark, d)).select(*_TOKEN_KEY, r6("kl").alias("kl"))


@query("j1_mean_kl")
def j1_mean(spark, d):
    return policy.mean_kl(fx.token_stats(spark, d)).withColumn("kl", r6("kl"))


@query("j2_importance_ratio")
def j2(spark, d):
    rows = policy.importance_ratio(fx.token_stats(spark, d), delta=1.3)
    return rows.select(*_TOKEN_KEY, r6("ratio").alias("ratio"), r6("clipped_ratio").alias("clipped_ratio"))


@query("j2_importance_ratio_sequence")
def j2_sequence(spark, d):
    rows = policy.importance_ratio(fx.token_stats(spark, d), level=policy.SEQUENCE)
    return rows.select(*_TOKEN_KEY, r6("ratio").alias("ratio"))


def _objective(loss_type):
    def run(spark, d):
        loss = policy.clipped_objective(fx.token_stats(spark, d), loss_type, beta=0.12, max_len=512)
        return loss.withColumn("loss", r6("loss"))

    return run


for _loss_type in ("grpo", "bnpo", "dr_grpo"):
    QUERIES[f"j3_clipped_objective_{_loss_type}"] = _objective(_loss_type)


@query("j3_clipped_objective_entropy")
def j3_entropy(spark, d):
    """The policy term of high-entropy tokens only."""
    marked = policy.high_entropy_mask(fx.token_stats(spark, d), 0.2)
    loss = policy.clipped_objective(marked, beta=0.12, entropy_mask="high_entropy")
    return loss.withColumn("loss", r6("loss"))


@query("j4_high_entropy_mask")
def j4(spark, d):
    return policy.high_entropy_mask(fx.token_stats(spark, d), 0.2).select(*_TOKEN_KEY, "high_entropy")


@query("j4_mean_entropy")
def j4_mean(spark, d):
    return policy.mean_entropy(fx.token_stats(spark, d)).withColumn("entropy", r6("entropy"))


@query("j5_clip_report")
def j5(spark, d):
    report = policy.clip_report(fx.token_stats(spark, d), 0.02, 0.03)
    return report.select([r6(c).alias(c) for c in report.columns])


@query("j6_anchored_objective")
def j6(spark, d):
    tokens = fx.token_stats(spark, d)
    anchor = tokens.select("batch_id", "logp", F.expr("ref_logp - 0.5").alias("ref_logp"), "mask")
    loss = policy.anchored_objective(tokens, anchor, num_generations=8, beta=0.12)
    return loss.withColumns({c: r6(c) for c in ("loss", "loss_corrected")})


# --- judging


@query("k1_judge_requests")
def k1(spark, d):
    pairs = prompts.pick_preferred(fx.pref_pairs(spark, d)).select(
        F.col("pair_id").alias("idx"), F.col("prompt").alias("question"), F.col("chosen").alias("answer"),
        F.col("rejected").alias("other"),
    )
    requests = judging.judge_requests(pairs, JUDGE_TEMPLATE).withColumn("style", F.lit("long"))
    short = judging.judge_requests(pairs, SHORT_JUDGE_TEMPLATE).withColumn("style", F.lit("short"))
    return requests.unionByName(short).select("idx", "target", "style", F.md5("message").alias("message"))


JUDGE_SYSTEM = "You compare two answers to a question and name the better one."


@query("k1_judge_chat")
def k1_chat(spark, d):
    pairs = prompts.pick_preferred(fx.pref_pairs(spark, d)).select(
        F.col("pair_id").alias("idx"), F.col("prompt").alias("question"), F.col("chosen").alias("answer"),
        F.col("rejected").alias("other"),
    )
    requests = judging.judge_requests(pairs, JUDGE_TEMPLATE, system=JUDGE_SYSTEM)
    return requests.select("idx", "target", F.md5(prompts.chat_text(F.col("messages"))).alias("chat"))


def _parsed_verdicts(spark, d):
    return judging.parse_verdicts(fx.verdicts(spark, d), "raw")


@query("k2_parse_verdicts")
def k2(spark, d):
    both = judging.parse_verdicts(_parsed_verdicts(spark, d), "short_raw", "short", "short_output")
    return both.select("idx", "target", "output", "short_output")


@query("k3_pair_scoreboard")
def k3(spark, d):
    return judging.pair_scoreboard(_parsed_verdicts(spark, d))


@query("k4_win_rates")
def k4(spark, d):
    return _rates(spark, d).withColumns({c: r6(c) for c in ("win", "lost", "tie")})


def _rates(spark, d):
    board = judging.pair_scoreboard(judging.parse_verdicts(fx.answered(spark, d), "raw"))
    return judging.win_rates(board, fx.judged(spark, d))


@query("k4_report_lines")
def k4_report(spark, d):
    """The rates of each subset as metric lines."""
    metrics = {c: F.max(c).cast("double") for c in ("win", "lost", "tie", "total", "invalid")}
    return io.metric_rows(_rates(spark, d), metrics, "run-1", "subset").withColumn("value", r6("value"))


# --- incremental forms


@query("l1_append_unscored_stream")
def l1(spark, d):
    """Two runs: half of the files, then the rest. The scorer is the length of the prompt."""
    source, out, checkpoint = (fresh_path(spark, f"stream-{n}") for n in ("in", "out", "progress"))
    inputs = _claim_prompts(spark, d).select("doc_id", "prompt")
    for k in range(2):
        io.append_results(inputs.where(F.col("doc_id") % 2 == k), source)
        incremental.append_unscored_stream(
            spark, source, inputs.schema, out, checkpoint, "doc_id",
            lambda df: df.select("doc_id", F.length("prompt").cast("bigint").alias("score")),
        ).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "score")


@query("l2_scoreboard_stream")
def l2(spark, d):
    """Four runs, each over the verdicts that came since; the board is kept and compacted on the way."""
    source, out, checkpoint = (fresh_path(spark, f"board-{n}") for n in ("in", "out", "progress"))
    parsed = _parsed_verdicts(spark, d).select("idx", "target", "output")
    for k in range(4):
        io.append_results(parsed.where(F.pmod(F.hash("idx", "target"), F.lit(4)) == k), source)
        arriving = spark.readStream.schema(parsed.schema).parquet(source)
        incremental.keep_board(incremental.scoreboard_stream(arriving), out, checkpoint, compact_every=2).awaitTermination()
    return incremental.read_board(spark, out)


# --- tasks


@query("m2_task_preference")
def m2_preference(spark, d):
    return prepare_task("preference", fx.pref_pairs(spark, d)).select(
        "pair_id", "prompt", F.md5("better_answer").alias("better_answer")
    )


@query("m2_task_dialogue")
def m2_dialogue(spark, d):
    return prepare_task("dialogue", fx.transcripts(spark, d)).select("conv_id", "subset", "malformed", "prompt", "better_answer")


@query("m2_task_translation")
def m2_translation(spark, d):
    return prepare_task("translation", fx.bitext(spark, d)).select("seq", "direction", F.md5("prompt").alias("prompt"))


@query("m2_task_formula")
def m2_formula(spark, d):
    statements = fx.formula_pairs(spark, d).select(
        "pair_id", F.concat(F.lit("Part "), F.col("pair_id"), F.lit(" is heavy.")).alias("NL"), F.col("gold").alias("FOL")
    )
    return prepare_task("formula", statements).select("pair_id", "part", "prompt", "FOL")


@query("m2_task_distill")
def m2_distill(spark, d):
    return prepare_task("distillation", fx.summaries(spark, d)).select("doc_id", "part", F.md5("prompt").alias("prompt"), "claim")


# --- the flagship: formula rewards of rollouts, group advantages, report


def flagship(spark: SparkSession, d: str) -> DataFrame:
    rolled, formulas = _text_formulas(spark, d)
    rewarded = equivalence.preference_reward(rolled, formulas, fx.literal_vectors(spark, d))
    # A narrow result of a costly job, read once for the groups and once for the rows.
    advantages = rollouts.group_advantages(cut(rewarded), "prompt_id", "reward")
    return advantages.select(
        "prompt_id", "part_id", "line_no", r6("reward").alias("reward"), r6("advantage").alias("advantage"), "zero_std"
    )


QUERIES["flagship_formula_advantages"] = flagship
