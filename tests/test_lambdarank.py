"""The pairwise ranker against a plain trainer, and its explanations against all subsets of features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.operators import lambdarank, ltr
from shortlist.operators.lambdarank import UNIT, LambdaParams, Node, Ranker, Tree

FEATURES = ["f0", "f1", "f2"]
KIND = "group_id long, candidate_id string, label int, f0 double, f1 double, f2 double"


def data(seed, sizes):
    draw = random.Random(seed)
    rows = []
    for g, size in enumerate(sizes):
        shift = draw.random()
        for i in range(size):
            x = [round(draw.random(), 1), round(draw.random(), 2), draw.choice([0.0, 1.0, None])]
            signal = x[0] + 0.3 * (x[2] or 0) + 0.1 * draw.random()
            rows.append((g, f"c{g}_{i:04d}", min(3, int(3 * signal * (0.5 + shift))), *x))
    return rows


def half_up(x):
    return int(math.floor(x + 0.5))


def plain_slopes(rows, scores, params):
    """Every pair of every group, one by one."""
    out = {r[1]: [0, 0] for r in rows}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-scores[r[1]], r[1]))
        discount = {r[1]: 1 / math.log2(i + 2) if i < params.truncation else 0.0 for i, r in enumerate(mine)}
        ideal = sum((2.0**lab - 1) / math.log2(i + 2) for i, lab in enumerate(sorted((r[2] for r in mine), reverse=True)[: params.truncation]))
        for i, a in enumerate(mine[: params.truncation]):
            for b in mine[i + 1 :]:
                if a[2] == b[2]:
                    continue
                hi, lo = (a, b) if a[2] > b[2] else (b, a)
                chance = 1 / (1 + math.exp(params.steepness * (scores[hi[1]] - scores[lo[1]])))
                size = params.steepness * (2.0 ** hi[2] - 2.0 ** lo[2]) * abs(discount[a[1]] - discount[b[1]]) / ideal
                slope, curve = half_up(UNIT * size * chance), half_up(UNIT * params.steepness * size * chance * (1 - chance))
                out[hi[1]][0] += slope
                out[lo[1]][0] -= slope
                out[hi[1]][1] += curve
                out[lo[1]][1] += curve
    return out


def plain_tree(rows, slopes, edges, params):
    """Node by node, every edge of every feature tried on the rows themselves."""
    nodes = {}

    def value(members):
        return params.learning_rate * (sum(slopes[r[1]][0] for r in members) / UNIT) / (sum(slopes[r[1]][1] for r in members) / UNIT + params.penalty)

    def strength(members):
        return (sum(slopes[r[1]][0] for r in members) / UNIT) ** 2 / (sum(slopes[r[1]][1] for r in members) / UNIT + params.penalty)

    def split(number, members, level):
        best = None
        for f, own in enumerate(edges):
            for edge in own if level < params.depth else ():
                left = [r for r in members if (r[3 + f] or 0.0) <= edge]
                right = [r for r in members if (r[3 + f] or 0.0) > edge]
                if min(len(left), len(right)) >= params.least_rows:
                    gain = strength(left) + strength(right) - strength(members)
                    if gain > params.least_gain and (best is None or gain > best[0]):
                        best = gain, f, edge, left, right
        nodes[number] = (len(members), value(members), best[1:3] if best else None)
        if best:
            split(2 * number, best[3], level + 1)
            split(2 * number + 1, best[4], level + 1)

    split(1, rows, 0)
    return nodes


@pytest.mark.parametrize("truncation", [3, 30])
def test_trees_equal_a_plain_trainer(spark, truncation):
    rows = data(1, [40, 1, 25, 60])
    rows += [(9, f"z{i}", 0, 0.5, 0.5, 0.0) for i in range(5)]
    params = LambdaParams(trees=4, depth=3, learning_rate=0.3, truncation=truncation, least_rows=4)
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    edges = [[0.05 + i / 10 for i in range(10)], [0.105 + i / 10 for i in range(9)], [0.5]]
    model = lambdarank.fit(frame, FEATURES, params, edges=edges)
    scores = {r[1]: 0.0 for r in rows}
    for tree in model.trees:
        want = plain_tree(rows, plain_slopes(rows, scores, params), edges, params)
        got = {n: (x.rows, x.value, (x.feature, x.edge) if x.feature >= 0 else None) for n, x in tree.nodes.items()}
        assert got.keys() == want.keys()
        for number, (count, value, split) in want.items():
            assert got[number][0] == count and got[number][2] == split and got[number][1] == pytest.approx(value, abs=1e-7)
        for r in rows:
            at = 1
            while want[at][2]:
                at = 2 * at + int((r[3 + want[at][2][0]] or 0.0) > want[at][2][1])
            scores[r[1]] += tree.nodes[at].value
    got = {r.candidate_id: r.score for r in lambdarank.predict(model, frame).collect()}
    assert got == pytest.approx(scores)
    assert sum(len(t.nodes) for t in model.trees) > 20


def test_trees_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(data(2, [200, 30, 30]), KIND)
    params = LambdaParams(trees=3, depth=3, least_rows=5)
    edges = lambdarank.quantile_edges(frame, FEATURES, 16)
    assert lambdarank.fit(frame.repartition(1), FEATURES, params, edges=edges) == lambdarank.fit(frame.repartition(7), FEATURES, params, edges=edges)


def test_pairs_within_groups_beat_labels_across_groups(spark):
    """The label's level differs by group, its order follows one feature: pairs see the order, single labels the level."""
    draw = random.Random(5)
    rows = []
    for g in range(60):
        level = g % 3
        for i in range(30):
            a = draw.random()
            rows.append((g, f"c{g}_{i}", int(a > 0.8) + level, a + 0.6 * draw.random(), level * 3 + draw.random(), draw.random()))
    frame = spark.createDataFrame(rows, KIND)
    train, test = frame.where("group_id % 4 < 3"), frame.where("group_id % 4 = 3")
    pairwise = lambdarank.fit(train, FEATURES, LambdaParams(trees=6, depth=2, learning_rate=0.3, least_rows=10))
    pointwise = ltr.fit_ranker(train, FEATURES, ltr.RankerParams(trees=6, depth=2, learning_rate=0.3))
    found = [ltr.mean_ndcg(scored, (10,)).first()["ndcg_at_10"] for scored in (lambdarank.predict(pairwise, test), ltr.predict(pointwise, test, FEATURES))]
    assert found[0] > found[1]


def test_slopes_of_a_group_need_no_single_task(spark, capsys):
    state = spark.createDataFrame(data(3, [50]), KIND).withColumn("score", F.lit(0.0))
    ideal = lambdarank.ideal_gains(state, 30, "group_id", "candidate_id")
    lambdarank.lambda_gradients(state, ideal, stage=lambda df, _: df).explain("formatted")
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInArrow") if bad in plan]


def test_one_shuffle_per_level(spark, capsys):
    state = spark.range(10).select(F.array(F.lit(0), F.lit(1)).alias("bins"), F.col("id").alias("slope"), F.col("id").alias("curve"))
    lambdarank.histograms(state, Tree({1: Node(0, 0.0)}), 0).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


# --- explanations ---------------------------------------------------------------------------


def random_tree(draw, depth, features):
    nodes = {}

    def make(number, rows, level):
        if level == depth or rows < 2 or draw.random() < 0.15:
            nodes[number] = Node(rows, draw.uniform(-1, 1))
            return
        left = draw.randint(1, rows - 1)
        nodes[number] = Node(rows, 0.0, draw.randrange(features), 0, draw.random())
        make(2 * number, left, level + 1)
        make(2 * number + 1, rows - left, level + 1)

    make(1, 200, 0)
    return Tree(nodes)


def expected(tree, x, known, number=1):
    """The prediction when only the features in ``known`` are: others follow the shares of rows."""
    node = tree.nodes[number]
    if node.feature < 0:
        return node.value
    if node.feature in known:
        return expected(tree, x, known, 2 * number + int(x[node.feature] > node.edge))
    return sum(tree.nodes[c].rows / node.rows * expected(tree, x, known, c) for c in (2 * number, 2 * number + 1))


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_contributions_equal_all_subsets(depth):
    draw, count = random.Random(depth), 4
    model = Ranker([f"f{i}" for i in range(count)], [random_tree(draw, depth, count) for _ in range(3)])
    x = np.array([[draw.random() for _ in range(count)] for _ in range(8)])
    got = model.contributions(x)
    assert np.allclose(got.sum(axis=1) + model.base(), model.predict(x))
    for row, values in zip(x, got):
        for i in range(count):
            want = 0.0
            for size in range(count):
                for known in itertools.combinations([j for j in range(count) if j != i], size):
                    weight = math.factorial(size) * math.factorial(count - size - 1) / math.factorial(count)
                    want += weight * sum(expected(t, row, {*known, i}) - expected(t, row, set(known)) for t in model.trees)
            assert values[i] == pytest.approx(want, abs=1e-9)


def test_contributions_of_a_table(spark):
    frame = spark.createDataFrame(data(4, [80, 60]), KIND)
    model = lambdarank.fit(frame, FEATURES, LambdaParams(trees=3, depth=3, learning_rate=0.3, least_rows=5))
    found = lambdarank.contributions(model, frame)
    sums = {r.candidate_id: r.total for r in found.groupBy("candidate_id").agg(F.sum("contribution").alias("total")).collect()}
    scores = {r.candidate_id: r.score for r in lambdarank.predict(model, frame).collect()}
    assert sums.keys() == scores.keys() and all(sums[i] + model.base() == pytest.approx(scores[i]) for i in sums)
    mean = {r.feature: r.mean_abs for r in ltr.mean_abs_contributions(found).collect()}
    assert max(mean, key=mean.get) == "f0"
    gains = lambdarank.feature_gains(model, spark).collect()
    assert gains[0].feature == "f0" and [g.gain for g in gains] == sorted((g.gain for g in gains), reverse=True)


def test_empty_and_flat_tables(spark):
    empty = spark.createDataFrame([], KIND)
    model = lambdarank.fit(empty, FEATURES, LambdaParams(trees=2))
    assert lambdarank.predict(model, empty).count() == 0
    flat = spark.createDataFrame([(1, f"c{i}", 1, 0.5, 0.5, None) for i in range(30)], KIND)
    model = lambdarank.fit(flat, FEATURES, LambdaParams(trees=2))
    assert [r.score for r in lambdarank.predict(model, flat).collect()] == [0.0] * 30
    assert lambdarank.contributions(model, flat).count() == 0
