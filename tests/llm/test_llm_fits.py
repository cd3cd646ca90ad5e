"""The classifiers' fits against plain loops over rows, and the bound of their samples."""

import math
import random

import numpy as np

from alignframe.llm import labelled, quality, toxicity


def by_differences(loss, w, step=1e-5):
    out = []
    for i in range(len(w)):
        up, down = list(w), list(w)
        up[i] += step
        down[i] -= step
        out.append((loss(up) - loss(down)) / (2 * step))
    return out


def test_ranking_fit_is_at_the_minimum_of_its_loss():
    rng = random.Random(1)
    differences = [[rng.gauss(0.4, 1), rng.gauss(-0.2, 1), rng.gauss(0, 1)] for _ in range(200)]

    def loss(w):
        lead = [sum(a * b for a, b in zip(row, w, strict=True)) for row in differences]
        return sum(math.log(1 + math.exp(-z)) for z in lead) / len(lead) + quality.RIDGE / 2 * sum(x * x for x in w)

    w = quality._descend(np.array(differences))
    assert max(abs(g) for g in by_differences(loss, w)) < 1e-3
    assert loss(w) < loss([0.0, 0.0, 0.0]) - 0.02
    assert w[0] > 0.2 and w[1] < -0.1 and abs(w[2]) < 0.3


def test_toxicity_fit_is_at_the_minimum_of_loss_and_swap_penalty():
    rng = random.Random(2)
    # Feature 0 is a group's name that toxic rows bear more often, 1 its neutral term, 2 and 3 other words.
    texts, y = [], []
    for i in range(200):
        toxic = i % 4 == 0
        names = {0} if rng.random() < (0.7 if toxic else 0.1) else {1}
        texts.append(np.array(sorted(names | ({2} if rng.random() < (0.8 if toxic else 0.2) else set()) | ({3} if rng.random() < 0.5 else set()))))
        y.append(float(toxic))
    pairs = [(t, np.array(sorted(set(t.tolist()) - {0} | {1}))) for t in texts if 0 in t]
    weight = np.full(200, 1 / 200)

    def loss(params, penalty):
        w, bias = params[:4], params[4]
        z = [sum(w[i] for i in t) + bias for t in texts]
        fit = sum(math.log(1 + math.exp(v)) - label * v for v, label in zip(z, y, strict=True)) / len(z)
        change = sum((sum(w[i] for i in a) - sum(w[i] for i in b)) ** 2 for a, b in pairs) / len(pairs)
        return fit + toxicity.RIDGE / 2 * sum(x * x for x in w) + penalty * change

    gaps = []
    for penalty in (0.0, 0.1, 4.0):
        w, bias = toxicity._descend(texts, np.array(y), weight, pairs, 4, penalty)
        params = [*w.tolist(), bias]
        start = [0.0] * 5
        assert max(abs(g) for g in by_differences(lambda p, penalty=penalty: loss(p, penalty), params)) < 5e-3, penalty
        assert loss(params, penalty) < loss(start, penalty)
        gaps.append(abs(w[0] - w[1]))
    # The stronger the penalty, the less a group's name matters.
    assert gaps[0] > 1 and gaps[0] > gaps[1] > gaps[2] and gaps[2] < 0.2


def test_repeated_ids_take_part_once(spark):
    texts = [(i, f"text {i}") for i in range(200)] + [(1, f"copy {i}") for i in range(3000)] + [(None, "none")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0)], "doc_id bigint, toxic int")
    sample, stands_for = labelled.training_rows(docs, labels, "toxic", 100)
    rows = sample.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 1 in ids and set(stands_for.values()) == {1.0}
    again = {r["doc_id"]: r["text"] for r in labelled.training_rows(docs.repartition(7), labels, "toxic", 100)[0].collect()}
    assert again == {r["doc_id"]: r["text"] for r in rows}
    # Missing texts and no rows at all.
    assert labelled.training_rows(docs.selectExpr("doc_id", "cast(null as string) text"), labels, "toxic", 20)[0].where("text is null").count() == 40
    assert labelled.training_rows(docs.limit(0), labels, "toxic", 20)[0].count() == 0


def test_quality_learns_from_every_labelled_document(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), 3 + id % 5) as text")
    # All rows of label 0 but a few are alike; what tells those few is known only to who has read them all.
    rare = "doc_id % 1000 = 501"
    docs = docs.selectExpr("doc_id", f"case when {rare} then '# # # #' else text end as text")
    labels = docs.selectExpr("doc_id", f"case when {rare} then 0 else 1 end as quality")
    rows = labelled.training_values(docs, labels, "quality", quality._packed("text"))
    held = labelled.crc_mod(docs["doc_id"], 5) != 0
    assert rows.count() == docs.where(held).count() > 2 * labelled.ROWS_PER_LABEL - 1000
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    blocks = quality._blocks(rows, counts).collect()
    assert sum(len(b["good"]) for b in blocks) == counts[1] and all(b["bad"] for b in blocks)
    model = quality.fit(docs, labels)
    scores = {r["bad"]: r["s"] for r in docs.selectExpr("*", f"{rare} as bad").select("bad", quality.score(docs["text"], model).alias("s")).distinct().collect()}
    assert scores[True] < quality.THRESHOLD <= scores[False]


def test_sums_of_the_fit_reach_the_driver_once_a_task(spark):
    rows = spark.range(4000).selectExpr(
        "cast(id % 3 <> 0 as int) y", "id as doc_id", "concat(repeat('word ', cast(1 + id % 9 as int)), repeat('#', cast(id % 7 as int))) as text"
    ).select("doc_id", "y", quality._packed("text").alias("value"))
    x = quality._unpacked([r["value"] for r in rows.collect()])
    counts, deviations = quality._counts_and_deviations(rows.repartition(90))
    assert counts == {0: 1334, 1: 2666} and np.allclose(deviations, x.std(axis=0), rtol=1e-9, atol=1e-12)
    assert quality._counts_and_deviations(rows.limit(0))[0] == {}
    assert quality._counts_and_deviations(rows.where("y = 1"))[0] == {1: 2666}

    blocks = quality._blocks(rows, counts).repartition(90)
    spread, w = np.where(deviations > 0, deviations, 1.0), np.linspace(-0.2, 0.3, x.shape[1])
    found = quality._summed(blocks, spread, w)
    want = [quality._slopes(quality._unpacked(b["good"]) / spread, quality._unpacked(b["bad"]) / spread, w) for b in blocks.collect()]
    assert found[0] == sum(p[0] for p in want)
    for i in (1, 2, 3):
        assert np.allclose(found[i], sum(p[i] for p in want), rtol=1e-9)
    # What the driver gets follows the cores, not the partitions or the batches.
    most = quality.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert most < 90 and 0 < len(quality._task_sums(rows.repartition(90), quality._moments)) <= most
