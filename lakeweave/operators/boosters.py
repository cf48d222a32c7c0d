"""Boosted trees for many models in one stage, and what each feature adds to a prediction.

Rows are grouped by model (a source, a run, a round, or all three); every group of at most MOST_CELLS values becomes a
model inside its own task, so a thousand sources are one job, not a thousand. A model with more values than that is
fitted by Spark's distributed trees instead. Models are rows of numbers that are stored, joined and broadcast in blocks of
bounded size. Features are binned once per model; trees are perfect trees of histograms with Newton leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: values (rows x features) of a model that one task fits
MOST_CELLS = 8_000_000
#: bytes of models that are broadcast at once, and models of such a block
MOST_BYTES, MOST_MODELS = 64_000_000, 512
_BINS = 256


@dataclass(frozen=True)
class Booster:
    """Settings of the boosted trees. ``rows`` and ``columns`` are the shares that each tree sees."""

    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: str = "0.8"
    seed: int = 42
    penalty: float = 1.0
    least_child: float = 1.0


@dataclass
class Trees:
    """A fitted model: perfect trees. Node i has the children 2i + 1 (values up to the threshold) and 2i + 2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` (trees, leaves), ``cover`` (trees, all nodes) is the
    weight of the rows that reach a node. ``middle`` stands for missing values. Inputs are features, then whether each is missing.
    """

    base: float
    middle: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    cover: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        return np.concatenate([np.where(missing, self.middle, x), missing], 1)

    def margin(self, x: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.leaf):
            return out
        depth = int(np.log2(self.leaf.shape[1]))
        for a in range(0, len(x), at_once):
            part = np.ascontiguousarray(self.inputs(x[a : a + at_once]).T)
            rows = np.arange(part.shape[1])
            for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
                node = (part[f[0]] > t[0]).astype(np.int64) + 1
                for _ in range(depth - 1):
                    node = 2 * node + 1 + (part[f[node], rows] > t[node])
                out[a : a + at_once] += leaf[node - (1 << depth) + 1]
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.margin(x)))

    def pack(self) -> dict:
        parts = {"middle": "<f8", "feature": "<i2", "threshold": "<f8", "leaf": "<f8", "cover": "<f4"}
        return {"base": self.base, "trees": len(self.leaf)} | {k: np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in parts.items()}

    @staticmethod
    def unpack(row) -> Trees:
        kinds = {"middle": "<f8", "feature": "<i2", "threshold": "<f8", "leaf": "<f8", "cover": "<f4"}
        own = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
        shaped = {k: own[k].reshape(row["trees"], -1) if row["trees"] else np.empty((0, 1)) for k in ("feature", "threshold", "leaf", "cover")}
        return Trees(row["base"], own["middle"], shaped["feature"].astype(np.int64), shaped["threshold"], shaped["leaf"], shaped["cover"].astype(float))


MODEL = "base double, trees int, middle binary, feature binary, threshold binary, leaf binary, cover binary"


def _edges(x: np.ndarray) -> np.ndarray:
    """Where a feature may be cut: between its values if these are few, else at quantiles."""
    values = np.unique(x)
    if len(values) <= _BINS:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, _BINS + 1)[1:-1]))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, booster: Booster, start: np.ndarray | None = None) -> Trees:
    """A model of one group's rows. ``x`` has NaN for missing values; weights count relative to their mean. With a single
    class it always tells that class. ``start``: what another model says of the rows (log-odds); the trees then add to it
    and have no base of their own, and a single class is no exception."""
    middle = np.array([np.median(c[~np.isnan(c)]) if not np.isnan(c).all() else 0.0 for c in x.T]) if len(x) else np.zeros(x.shape[1])
    none = np.empty((0, 1))
    w = w / w.mean() if len(w) and w.sum() > 0 else np.ones(len(y))
    rate = float(np.average(y, weights=w)) if len(y) else 0.5
    if (start is None and rate in (0.0, 1.0)) or not len(y) or not booster.trees:
        base = np.inf if rate == 1 else -np.inf if rate == 0 else float(np.log(rate / (1 - rate)))
        return Trees(0.0 if start is not None else base, middle, none, none, none, none)
    base = 0.0 if start is not None else float(np.log(rate / (1 - rate)))
    full = Trees(base, middle, none, none, none, none).inputs(x)
    edges = [_edges(c) for c in full.T]
    used = np.array([f for f, e in enumerate(edges) if len(e)], np.int64)
    n_inner, n_leaves, depth = (1 << booster.depth) - 1, 1 << booster.depth, booster.depth
    feature, threshold = np.zeros((booster.trees, n_inner), np.int64), np.full((booster.trees, n_inner), np.inf)
    leaf, cover = np.zeros((booster.trees, n_leaves)), np.zeros((booster.trees, 2 * n_leaves - 1))
    width = max([len(edges[f]) for f in used], default=0) + 1
    codes = np.stack([np.searchsorted(edges[f], full[:, f]) for f in used], 1).astype(np.int32) if len(used) else np.empty((len(y), 0), np.int32)
    cuts = np.full((len(used), width), np.inf)  # the threshold behind each bin; inf: no cut there
    for i, f in enumerate(used):
        cuts[i, : len(edges[f])] = edges[f]
    rng = np.random.default_rng(booster.seed)
    margin = np.full(len(y), base) if start is None else np.clip(start, -30, 30)
    n_columns = max(1, round(float(booster.columns) * len(used))) if len(used) else 0
    for t in range(booster.trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p)
        drawn = np.flatnonzero(rng.random(len(y)) < booster.rows)
        columns = np.sort(rng.choice(len(used), n_columns, replace=False)) if n_columns else np.empty(0, np.int64)
        node = np.zeros(len(y), np.int64)
        some = codes[drawn][:, columns] + (np.arange(n_columns) * width).astype(np.int32)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            own = node[drawn]
            cover[t, first : first + n] = np.bincount(own, w[drawn], n)
            if n_columns:
                at = (own[:, None] * (n_columns * width) + some).ravel()
                size = n * n_columns * width
                sums = [np.bincount(at, np.repeat(v[drawn], n_columns), size).reshape(n, n_columns, width) for v in (g, h)]
                (gl, hl), (ga, ha) = [np.cumsum(s, 2) for s in sums], [s[:, :1].sum(2, keepdims=True) for s in sums]
                gr, hr = ga - gl, ha - hl
                gain = gl**2 / (hl + booster.penalty) + gr**2 / (hr + booster.penalty) - ga**2 / (ha + booster.penalty)
                gain[(hl < booster.least_child) | (hr < booster.least_child) | np.isinf(cuts[columns])[None]] = 0
                best = gain.reshape(n, -1).argmax(1)
                good = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
                column, bin_ = columns[best // width], best % width
                feature[t, first : first + n] = np.where(good, used[column], 0)
                threshold[t, first : first + n] = np.where(good, cuts[column, bin_], np.inf)
                go = codes[np.arange(len(y)), column[node]] > np.where(good, bin_, width)[node]
            else:
                go = False
            node = 2 * node + go
        gs, hs = (np.bincount(node[drawn], v[drawn], n_leaves) for v in (g, h))
        cover[t, n_leaves - 1 :] = np.bincount(node[drawn], w[drawn], n_leaves)
        leaf[t] = -booster.rate * gs / (hs + booster.penalty)
        margin += leaf[t, node]
    return Trees(base, middle, feature, threshold, leaf, cover)


def _matrix(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    return np.stack([pdf[c].to_numpy(float) for c in names], 1) if len(names) else np.empty((len(pdf), 0))


def fit_many(train: DataFrame, features: Sequence[str], booster: Booster, by: Sequence[str], weight: str | None = "weight", bounded: bool = False, start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, large): a model of ``label`` for each value of ``by`` (``by`` and the columns of MODEL), and the values of
    ``by`` with more than MOST_CELLS values, for which there is none.

    One shuffle of the features; rows without a label play no part. Each group is fitted in its own task, in an order of
    its own rows that doesn't depend on how they arrive, so repeated runs agree. ``bounded``: the caller has counted.
    ``start``: a column with another model's log-odds, to which the trees are appended.
    """
    names = list(features)
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)]
    w = F.col(weight).cast("double") if weight and weight in train.columns else F.lit(1.0)
    rows = train.where(F.col("label").isNotNull()).select(*by, *x, F.col("label").cast("double").alias("_y"), w.alias("_w"), (F.col(start) if start else F.lit(0.0)).cast("double").alias("_s"))
    large = rows.select(*by).where("false")
    if not bounded:
        large = rows.groupBy(*by).count().where(F.col("count") * max(1, len(names)) > MOST_CELLS).select(*by)
        if not large.isEmpty():
            same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by]
            rows = rows.alias("_r").join(F.broadcast(large.alias("_l")), same, "left_anti")
    columns = [f"_x{i}" for i in range(len(names))]
    keys = list(by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort([pdf[c].to_numpy(float) for c in (*columns, "_y", "_w", "_s")])]
        trees = grow(_matrix(pdf, columns), pdf["_y"].to_numpy(float), pdf["_w"].fillna(0.0).to_numpy(float), booster, pdf["_s"].to_numpy(float) if start else None)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | trees.pack()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", " + MODEL
    return rows.groupBy(*by).applyInPandas(one, schema), large


def _blocks(models: DataFrame, by: Sequence[str]) -> Iterator[list]:
    """The models in blocks of bounded size."""
    size = sum((F.length(c) for c in ("feature", "threshold", "leaf", "cover")), F.lit(0))
    total = models.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return
    blocks = max(-(-2 * total["bytes"] // MOST_BYTES), -(-2 * total["n"] // MOST_MODELS), 1) if total["n"] > 1 else 1
    for i in range(blocks):
        held = models.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == i).collect()
        if held:
            yield held


def _chances_of(shared):
    """A function of feature columns: the chances by each of the broadcast models."""

    @F.pandas_udf("array<double>")
    def chances(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(list(np.stack([m.chances(x) for m in shared.value], 1)))

    return chances


def predict_many(models: DataFrame, rows: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``rows`` once for each model, with ``by`` and ``p1``. Columns of ``rows`` named as in ``by`` give way to the model's."""
    spark, names = rows.sparkSession, list(features)
    plain = rows.drop(*by)
    schema = models.select(*by).schema
    out = None
    for held in _blocks(models, by):
        shared = spark.sparkContext.broadcast([Trees.unpack(r) for r in held])
        keys = spark.createDataFrame([(i, *[r[c] for c in by]) for i, r in enumerate(held)], _with_position(schema))
        each = plain.select("*", F.posexplode(_chances_of(shared)(*[F.col(c).cast("double") for c in names])).alias("_i", "p1"))
        one = each.join(F.broadcast(keys), "_i").drop("_i").withColumn("p1", F.round("p1", 9))
        out = one if out is None else out.unionByName(one)
    if out is None:
        empty = plain.where("false").withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema})
        return empty.withColumn("p1", F.lit(None).cast("double"))
    return out


def _with_position(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("_i", T.IntegerType()), *schema.fields])


def predict_own(models: DataFrame, rows: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Every row with ``p1`` by the model of its own group (``by``); rows whose group has no model are left out.

    Groups are those that ``fit_many`` fitted, so their size is bounded.
    """
    names, columns = list(features), rows.columns

    def score(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model) or not len(own):
            return pd.DataFrame({c: own[c].iloc[:0] for c in columns} | {"p1": np.empty(0)})
        return own.assign(p1=np.round(Trees.unpack(model.iloc[0]).chances(_matrix(own, names)), 9))

    doubles = rows.withColumns({c: F.col(c).cast("double") for c in names}) if names else rows
    schema = doubles.withColumn("p1", F.lit(0.0)).schema
    return doubles.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(score, schema)


# what each feature adds


def _paths(trees: Trees, t: int):
    """Of each leaf of a tree: its value and, for each feature on its way, (low, high) bounds and the share of rows that
    go the leaf's way where the feature is split."""
    depth = int(np.log2(trees.leaf.shape[1]))
    for k in range(1 << depth):
        if trees.leaf[t, k] == 0:
            continue
        node, parts, reached = 0, {}, True
        for level in range(depth):
            right = k >> (depth - 1 - level) & 1
            f, cut = int(trees.feature[t, node]), trees.threshold[t, node]
            child = 2 * node + 1 + right
            if np.isinf(cut):
                if right:
                    reached = False
                    break
            else:
                low, high, share = parts.get(f, (-np.inf, np.inf, 1.0))
                whole = trees.cover[t, node]
                share *= trees.cover[t, child] / whole if whole > 0 else 0.0
                parts[f] = (max(low, cut), high, share) if right else (low, min(high, cut), share)
            node = child
        if reached:
            yield trees.leaf[t, k], parts


def contributions(trees: Trees, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features, base): path-dependent SHAP values, which sum with the base to the margin of each row.

    A feature's own values and its being missing count together. A leaf's value is split among the features on its way:
    over all subsets of the others, known features count whether the row goes that way, unknown ones the share of the
    training rows that do.
    """
    n_features = x.shape[1]
    out, base = np.zeros((len(x), n_features)), trees.base
    part = trees.inputs(x).T
    for t in range(len(trees.leaf)):
        for value, parts in _paths(trees, t):
            # inputs of the same feature (value and missing) act as one player
            players: dict[int, list[int]] = {}
            for f in parts:
                players.setdefault(f % n_features, []).append(f)
            inside = {p: np.logical_and.reduce([(part[f] > parts[f][0]) & (part[f] <= parts[f][1]) for f in fs]).astype(float) for p, fs in players.items()}
            share = {p: float(np.prod([parts[f][2] for f in fs])) for p, fs in players.items()}
            base += value * float(np.prod(list(share.values())))
            m = len(players)
            for i in players:
                others = [p for p in players if p != i]
                total = np.zeros(len(x))
                for size in range(m):
                    weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                    for known in combinations(others, size):
                        term = np.full(len(x), weight)
                        for p in others:
                            term = term * (inside[p] if p in known else share[p])
                        total += term
                out[:, i] += value * total * (inside[i] - share[i])
    return out, base


def _contributions_of(shared):
    """A function of feature columns: the contributions and the base by each of the broadcast models."""

    @F.pandas_udf("array<array<double>>")
    def added(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        each = [contributions(m, x) for m in shared.value]
        return pd.Series([[np.append(v[i], b) for v, b in each] for i in range(len(x))])

    return added


def shap_values(models: DataFrame, rows: DataFrame, features: Sequence[str], by: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """``by, row_id, feature, contribution``: what every feature adds to the log-odds of every row, for each model; the
    feature ``""`` is the base. Without trees (a single class) nothing is added."""
    spark, names = rows.sparkSession, list(features)
    schema = models.select(*by).schema
    labels = F.array(*[F.lit(c) for c in (*names, "")])
    out = None
    for held in _blocks(models.where("trees > 0"), by):
        shared = spark.sparkContext.broadcast([Trees.unpack(r) for r in held])
        keys = spark.createDataFrame([(i, *[r[c] for c in by]) for i, r in enumerate(held)], _with_position(schema))
        each = rows.select(row_id, F.posexplode(_contributions_of(shared)(*[F.col(c).cast("double") for c in names])).alias("_i", "_v"))
        pairs = each.select("_i", row_id, F.explode(F.arrays_zip(labels.alias("feature"), F.col("_v").alias("contribution"))).alias("_p"))
        one = pairs.join(F.broadcast(keys), "_i").select(*by, row_id, "_p.feature", "_p.contribution")
        out = one if out is None else out.unionByName(one)
    if out is None:
        empty = rows.where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], row_id)
        return empty.withColumns({"feature": F.lit(""), "contribution": F.lit(0.0)})
    return out


def mean_contributions(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, importance, place``: the mean absolute contribution of each feature over all rows, largest first."""
    from pyspark.sql import Window

    held = values.where("feature <> ''").groupBy(*by, "feature").agg(F.round(F.avg(F.abs("contribution")), 9).alias("importance"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return held.withColumn("place", F.row_number().over(order.orderBy(F.col("importance").desc(), "feature")))
