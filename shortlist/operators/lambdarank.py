"""Pairwise ranking by boosted trees (L1-L4): lambda gradients, distributed histograms, exact tree explanations.

A tree is grown on the slopes that pairs of rows of one query group pull at their scores with. A pair with different
labels counts by how much exchanging the two rows changes the group's NDCG at ``truncation``, so every pair that
counts has a row among the group's ``truncation`` best. These few rows per group meet all others: a group is spread over
as many tasks as its rows are, and what its best rows get from the others is added up before it is shuffled.

Slopes are whole numbers (multiples of 2^-30), so all sums are exact and the trees do not depend on how rows are
dealt to tasks. Per tree the state is written once to the shared folder; per level one aggregation over (node, feature,
bin) is shuffled, whose size depends on the model alone: nodes x features x bins. The split is chosen from it.

``contributions`` explains predictions: for every leaf, the shares that its path's features have in reaching it, by the
polynomial of the subsets of the other features, in time that grows with the square of the path's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.operators.ltr import RankerParams, group_folds, mean_ndcg, usable_folds
from shortlist.session import staged

#: Slopes are counted in units of 2^-30.
UNIT = float(1 << 30)


@dataclass(frozen=True)
class LambdaParams(RankerParams):
    """Trees as in ``RankerParams``; ``truncation`` is the depth of the NDCG, ``penalty`` is added to the sum of curvatures."""

    truncation: int = 30
    bins: int = 64
    steepness: float = 1.0
    penalty: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-9


@dataclass(frozen=True)
class Node:
    """A leaf, or a split of ``feature``: values up to ``edge`` (bins up to ``bin``) go left."""

    rows: int
    value: float
    feature: int = -1
    bin: int = -1
    edge: float = 0.0
    gain: float = 0.0


@dataclass(frozen=True)
class Tree:
    """Nodes by number: 1 is the root, the children of n are 2n and 2n + 1."""

    nodes: dict[int, Node] = field(default_factory=dict)

    def leaves(self) -> Iterator[tuple[int, list[int]]]:
        """Every leaf with the numbers of the nodes from the root to it."""
        for number, node in sorted(self.nodes.items()):
            if node.feature < 0:
                yield number, [number >> up for up in range(number.bit_length() - 1, -1, -1)]

    def leaf_of(self, values: np.ndarray) -> np.ndarray:
        """The number of the leaf of every row of feature values."""
        at = np.ones(len(values), np.int64)
        for number, node in sorted(self.nodes.items()):
            if node.feature >= 0:
                here = at == number
                at[here] = 2 * number + (values[here, node.feature] > node.edge)
        return at

    def predict(self, values: np.ndarray) -> np.ndarray:
        at = self.leaf_of(values)
        out = np.zeros(len(values))
        for number, _ in self.leaves():
            out[at == number] = self.nodes[number].value
        return out


@dataclass(frozen=True)
class Ranker:
    features: list[str]
    trees: list[Tree]

    def predict(self, values: np.ndarray) -> np.ndarray:
        return sum((tree.predict(values) for tree in self.trees), np.zeros(len(values)))

    def base(self) -> float:
        """The mean prediction over the rows each tree was grown on."""
        return sum(tree.nodes[n].value * tree.nodes[n].rows / tree.nodes[1].rows for tree in self.trees for n, _ in tree.leaves() if tree.nodes[1].rows)

    def used(self) -> list[int]:
        return sorted({node.feature for tree in self.trees for node in tree.nodes.values() if node.feature >= 0})

    def contributions(self, values: np.ndarray) -> np.ndarray:
        """A column per feature; with ``base()`` a row adds up to its prediction."""
        out = np.zeros((len(values), len(self.features)))
        for tree in self.trees:
            for number, path in tree.leaves():
                explained, shares, passed = [], [], []
                for above, below in zip(path, path[1:]):
                    node = tree.nodes[above]
                    share = tree.nodes[below].rows / node.rows if node.rows else 0.0
                    goes = (values[:, node.feature] > node.edge) == bool(below & 1)
                    if node.feature in explained:
                        i = explained.index(node.feature)
                        shares[i] *= share
                        passed[i] = passed[i] & goes
                    else:
                        explained.append(node.feature)
                        shares.append(share)
                        passed.append(goes)
                if explained:
                    # Rows that pass the same conditions share their values.
                    kinds, kind = np.unique(np.column_stack(passed), axis=0, return_inverse=True)
                    out[:, explained] += tree.nodes[number].value * path_shares(np.array(shares), kinds.astype(float))[kind.ravel()]
        return out


def path_shares(shares: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Shapley values of the game that a path's leaf is.

    A subset of the path's features reaches the leaf with the product of ``passed`` (0 or 1) over its members and of
    ``shares`` over the others. ``passed`` has a row per kind of input; so has the result. The coefficients of the product of
    ``shares + passed * t`` add up the subsets by size; taking one factor out leaves the subsets without that feature.
    """
    kinds, size = passed.shape
    whole = np.zeros((kinds, size + 1))
    whole[:, 0] = 1.0
    for i in range(size):
        whole[:, 1:] = whole[:, 1:] * shares[i] + whole[:, :-1] * passed[:, i, None]
        whole[:, 0] *= shares[i]
    weights = np.ones(size)
    for k in range(1, size):
        weights[k] = weights[k - 1] * k / (size - k)
    weights /= size
    out = np.zeros((kinds, size))
    for i in range(size):
        rest, one = np.zeros((kinds, size)), passed[:, i] > 0
        carry = whole[:, size].copy()
        for k in range(size - 1, -1, -1):
            rest[one, k] = carry[one]
            carry = whole[:, k] - carry * shares[i]
        if shares[i] > 0:
            rest[~one] = whole[~one, :size] / shares[i]
        out[:, i] = (rest * weights).sum(axis=1) * (passed[:, i] - shares[i])
    return out


# --- bins -----------------------------------------------------------------------------------


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 increasing edges per feature that hold about equally many rows between them, in one pass."""
    asked = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), asked, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(values or [])) for values in row]


def equal_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """``bins`` - 1 edges at equal distances between the smallest and the largest value."""
    ends = df.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.min, F.max)]).first()
    pairs = list(zip(ends[::2], ends[1::2]))
    return [[lo + (hi - lo) * i / bins for i in range(1, bins)] if lo is not None and hi > lo else [] for lo, hi in pairs]


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


# --- slopes ---------------------------------------------------------------------------------


def _discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def _pull(label: Column, score: Column, discount: Column, other: Column, steepness: float) -> tuple[Column, Column]:
    """How a row of the group's best (``other``: struct of label, score, rank) pulls at a row: slope and curvature in units."""
    up = label > other["label"]
    gain = F.abs(F.pow(F.lit(2.0), label) - F.pow(F.lit(2.0), other["label"])) * F.abs(discount - _discount(other["rank"]))
    behind = F.when(up, other["score"] - score).otherwise(score - other["score"])
    chance = 1.0 / (1.0 + F.exp(-steepness * behind))
    size = steepness * gain / F.col("_ideal")
    unit = F.lit(UNIT)
    slope = F.round(unit * size * chance).cast("long")
    curve = F.round(unit * steepness * size * chance * (1.0 - chance)).cast("long")
    none = label == other["label"]
    return F.when(none, 0).when(up, slope).otherwise(-slope).cast("long"), F.when(none, 0).otherwise(curve).cast("long")


def ideal_gains(df: DataFrame, truncation: int, group: str, id_col: str) -> DataFrame:
    """Per group the DCG of its best order, over ``truncation`` rows; groups whose labels are all 0 are left out."""
    order = Window.partitionBy(group).orderBy(F.desc("label"), id_col)
    top = df.select(group, id_col, "label").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= truncation)
    return top.groupBy(group).agg(F.sum((F.pow(F.lit(2.0), F.col("label")) - 1.0) * _discount(F.col("_at"))).alias("_ideal")).where("_ideal > 0")


def lambda_gradients(df: DataFrame, ideal: DataFrame, params: LambdaParams = LambdaParams(), group: str = "group_id", id_col: str = "candidate_id",
                     stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """``df`` (with ``label`` and ``score``) with ``slope`` and ``curve`` in units of 2^-30. An id names one row of a group.

    Two steps: what the rows below the best give to the best, added up by group; then every row's own sum. ``ideal`` comes
    from ``ideal_gains``. Rows of groups without gains have 0. Rows without a label count as label 0.
    """
    rows = df.withColumns({"label": F.coalesce("label", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})
    order = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    best = rows.select(group, id_col, "label", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.truncation)
    best = best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "score", "label"))).alias("_best"))
    best = stage(best.join(ideal, group), "lambda-best")

    met = rows.select(group, id_col, "label", "score").join(best, group).where(~F.array_contains(F.col("_best.id"), F.col(id_col)))
    below = F.transform("_best", lambda t: F.struct(*(p.alias(n) for p, n in zip(_pull(F.col("label"), F.col("score"), F.lit(0.0), t, params.steepness), ("slope", "curve")))))
    met = met.select(group, below.alias("_pulls"))
    given = met.groupBy(group).agg(*[
        F.struct(F.sum(-F.get("_pulls", F.lit(i))["slope"]).alias("slope"), F.sum(F.get("_pulls", F.lit(i))["curve"]).alias("curve")).alias(f"_g{i}")
        for i in range(params.truncation)
    ])
    given = given.select(group, F.array(*(f"_g{i}" for i in range(params.truncation))).alias("_given"))
    best = stage(best.join(given, group, "left"), "lambda-given")

    joined = rows.join(best, group, "left")
    place = F.array_position(F.col("_best.id"), F.col(id_col))
    discount = F.when(place > 0, _discount(place)).otherwise(0.0)

    def own(at: int) -> Column:
        pull = lambda t: F.when(t["id"] == F.col(id_col), 0).otherwise(_pull(F.col("label"), F.col("score"), discount, t, params.steepness)[at])
        mine = F.aggregate(F.transform("_best", pull), F.lit(0).cast("long"), lambda a, b: a + b)
        got = F.when(place > 0, F.get("_given", (place - 1).cast("int"))[("slope", "curve")[at]])
        return F.coalesce(mine, F.lit(0)) + F.coalesce(got, F.lit(0))

    return joined.withColumns({"slope": own(0), "curve": own(1)}).drop("_best", "_ideal", "_given")


# --- trees ----------------------------------------------------------------------------------


def _node(tree: Tree, number: int = 1) -> Column:
    """The number of the deepest node of a tree that a row reaches, by its bins."""
    node = tree.nodes[number]
    if node.feature < 0:
        return F.lit(number)
    left = F.get("bins", F.lit(node.feature)) <= node.bin
    return F.when(left, _node(tree, 2 * number)).otherwise(_node(tree, 2 * number + 1))


def _value(tree: Tree, number: int = 1) -> Column:
    node = tree.nodes[number]
    if node.feature < 0:
        return F.lit(node.value)
    left = F.get("bins", F.lit(node.feature)) <= node.bin
    return F.when(left, _value(tree, 2 * number)).otherwise(_value(tree, 2 * number + 1))


def histograms(state: DataFrame, tree: Tree, level: int) -> DataFrame:
    """Sums of ``slope`` and ``curve`` and ``rows`` by node of a level, feature and bin: one shuffle."""
    placed = state.select(_node(tree).alias("node"), "bins", "slope", "curve").where(F.col("node") >= 1 << level)
    bins = placed.select("node", F.posexplode("bins").alias("feature", "bin"), "slope", "curve")
    return bins.groupBy("node", "feature", "bin").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve"), F.count("*").alias("rows"))


def best_split(rows: list, edges: list[list[float]], params: LambdaParams) -> tuple[Node, tuple[Node, Node] | None]:
    """The node made of histogram rows, split where the gain is largest (ties: first feature, then first edge), and its children."""
    first = [r for r in rows if r["feature"] == 0]
    slope, curve, count = (sum(r[n] for r in first) for n in ("slope", "curve", "rows"))

    def value(s: int, c: int) -> float:
        return params.learning_rate * (s / UNIT) / (c / UNIT + params.penalty)

    def strength(s: int, c: int) -> float:
        return (s / UNIT) ** 2 / (c / UNIT + params.penalty)

    leaf, best = Node(count, value(slope, curve)), None
    by_feature: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in rows:
        by_feature.setdefault(r["feature"], {})[r["bin"]] = (r["slope"], r["curve"], r["rows"])
    for feature, sums in sorted(by_feature.items()):
        s = c = n = 0
        for at in range(len(edges[feature])):
            more = sums.get(at, (0, 0, 0))
            s, c, n = s + more[0], c + more[1], n + more[2]
            if n < params.least_rows or count - n < params.least_rows:
                continue
            gain = strength(s, c) + strength(slope - s, curve - c) - strength(slope, curve)
            if gain > params.least_gain and (best is None or gain > best[0].gain):
                children = Node(n, value(s, c)), Node(count - n, value(slope - s, curve - c))
                best = Node(count, leaf.value, feature, at, edges[feature][at], gain), children
    return best or (leaf, None)


def grow(state: DataFrame, edges: list[list[float]], params: LambdaParams) -> Tree:
    """One tree on the slopes in ``state``, level by level. Only histograms reach the driver."""
    tree = Tree({1: Node(0, 0.0)})
    for level in range(params.depth):
        by_node: dict[int, list] = {}
        for r in histograms(state, tree, level).collect():
            by_node.setdefault(r["node"], []).append(r)
        split = False
        for number, rows in by_node.items():
            tree.nodes[number], children = best_split(rows, edges, params)
            if children:
                split = True
                tree.nodes[2 * number], tree.nodes[2 * number + 1] = children
        if not split:
            break
    return tree


def fit(df: DataFrame, features: list[str], params: LambdaParams = LambdaParams(), group: str = "group_id", id_col: str = "candidate_id",
        edges: list[list[float]] | None = None) -> Ranker:
    """L1: ``params.trees`` trees on ``df`` (``label``, ``group``, ``id_col`` and the features; missing values count as 0)."""
    filled = df.select(group, id_col, F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"),
                       *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)])
    names = [f"_f{i}" for i in range(len(features))]
    edges = edges or quantile_edges(filled, names, params.bins)
    bins = F.array(*[_bin(F.col(n), e) for n, e in zip(names, edges)])
    state = staged(filled.select(group, id_col, "label", F.lit(0.0).alias("score"), bins.alias("bins")), "lambda-rows")
    ideal = staged(ideal_gains(state, params.truncation, group, id_col), "lambda-ideal")
    trees: list[Tree] = []
    for _ in range(params.trees):
        pulled = staged(lambda_gradients(state, ideal, params, group, id_col), "lambda-state")
        trees.append(grow(pulled, edges, params))
        state = pulled.drop("slope", "curve").withColumn("score", F.col("score") + _value(trees[-1]))
    return Ranker(list(features), trees)


# --- use ------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    columns = [np.nan_to_num(batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False).astype(float)) for f in features]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def predict(model: Ranker, df: DataFrame, out: str = "score") -> DataFrame:
    """L2: ``df`` with the model's score for every row; batches of rows are scored inside tasks."""
    kept = df.drop(out)
    schema = kept.select("*", F.lit(0.0).alias(out)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(model.predict(_matrix(batch, model.features)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return kept.mapInArrow(score, schema)


def contributions(model: Ranker, df: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """L4: ``(id, feature, contribution)`` for every row and every feature the model uses; see ``Ranker.contributions``."""
    used = model.used()
    kind = df.schema[id_col].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                made = model.contributions(_matrix(part, model.features))[:, used]
                ids = part.column(part.schema.get_field_index(id_col)).take(pa.array(np.repeat(np.arange(part.num_rows), len(used))))
                names = pa.array([model.features[i] for i in used] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(made.ravel(), pa.float64())], names=[id_col, "feature", "contribution"])

    return df.select(id_col, *model.features).mapInArrow(explain, f"{id_col} {kind}, feature string, contribution double")


def feature_gains(model: Ranker, spark) -> DataFrame:
    """L3: per feature how often it splits and the gain of its splits."""
    nodes = [node for tree in model.trees for node in tree.nodes.values() if node.feature >= 0]
    rows = [(name, sum(n.feature == i for n in nodes), sum(n.gain for n in nodes if n.feature == i)) for i, name in enumerate(model.features)]
    return spark.createDataFrame(rows, "feature string, splits int, gain double").orderBy(F.desc("gain"), "feature")


def cross_validate(df: DataFrame, features: list[str], k: int = 5, params: LambdaParams = LambdaParams(), ks: tuple[int, ...] = (10, 50),
                   group: str = "group_id") -> DataFrame:
    """L1: one row per fold with its quality on held-out groups, next to random order. The frame is written once."""
    k = usable_folds(df, k, group)
    if k < 2:
        raise ValueError("cross-validation needs at least two groups")
    folds = group_folds(df, k, group).select(group, "fold")
    table = staged(df.join(folds, group).select("candidate_id", group, "fold", "label", *features), "lambda-cv")
    out = None
    for fold in range(k):  # a handful of model fits, each made of distributed jobs
        held_out = table.where(F.col("fold") == fold)
        model = fit(table.where(F.col("fold") != fold), features, params, group)
        chance = held_out.withColumn("score", F.pmod(F.xxhash64("candidate_id"), F.lit(1 << 30)).cast("double"))
        row = mean_ndcg(predict(model, held_out), ks, group=group).select(F.lit(fold).alias("fold"), "*")
        row = row.withColumn("random_ndcg", mean_ndcg(chance, ks[:1], group=group).select(f"ndcg_at_{ks[0]}").scalar())
        out = row if out is None else out.unionByName(row)
    return out
