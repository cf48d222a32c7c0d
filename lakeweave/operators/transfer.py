"""Scores that tell beforehand how well labelled sources will serve a target."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.numeric import correlation
from lakeweave.functions.vectors import centroids, cosine, squared_distance


def centroid_margin(rows: DataFrame, references: DataFrame, vector: str = "vector", width: int | None = None) -> DataFrame:
    """``margin`` of labelled source centroids over target rows: mean of (d2 - d1) / d2, the gap of the two nearest.

    ``references`` are the source's labelled rows; their centroids (one per class) are broadcast. No PCA is applied.
    """
    means = centroids(references, ["label"], vector, "centroid", width).select("label", "centroid")
    far = rows.select("id", vector).join(F.broadcast(means)).select("id", F.sqrt(squared_distance(vector, "centroid")).alias("d"))
    two = far.groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("d"))  # one distance per class
    gap = F.try_divide(F.col("d")[1] - F.col("d")[0], F.col("d")[1])
    return two.agg(F.round(F.avg(gap), 6).alias("margin"), F.count(F.lit(1)).alias("n"))


def zscore_cosine_margin(rows: DataFrame, labelled: DataFrame, width: int, least_std: float = 0.01) -> DataFrame:
    """``margin``: mean gap of the cosines to the two nearest class directions, in standardised space.

    Elements are standardised by the target's mean and population standard deviation (those below ``least_std`` are
    left out), rows are divided by their length, and a class direction is the normalised sum of its rows.
    """
    parts = [F.col("vector")[i].cast("double") for i in range(width)]
    stats = rows.agg(F.array(*[F.avg(p) for p in parts]).alias("_m"), F.array(*[F.stddev_pop(p) for p in parts]).alias("_s"))

    def scaled(df: DataFrame) -> DataFrame:
        z = F.transform(F.arrays_zip("vector", "_m", "_s"), lambda x: F.when(x["_s"] > least_std, (x["vector"].cast("double") - x["_m"]) / x["_s"]).otherwise(F.lit(0.0)))
        out = df.join(F.broadcast(stats)).withColumn("_z", z)
        size = F.sqrt(F.aggregate("_z", F.lit(0.0), lambda s, x: s + x * x))
        return out.withColumn("vector", F.transform("_z", lambda x: F.try_divide(x, size))).drop("_m", "_s", "_z")

    means = centroids(scaled(labelled), ["label"], "vector", "centroid", width).select("label", "centroid")
    sims = scaled(rows).join(F.broadcast(means)).select("id", cosine("vector", "centroid").alias("c"))
    two = sims.groupBy("id").agg(F.sort_array(F.collect_list("c"), asc=False).alias("c"))
    return two.agg(F.round(F.avg(F.col("c")[0] - F.col("c")[1]), 6).alias("margin"))


def whitened(x: np.ndarray, components: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, scales) of the leading principal components, scaled to unit variance."""
    mean = x.mean(0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    k = int(min(components, (s > 1e-8 * max(1e-12, s.max(initial=0))).sum()))
    return mean, v[:k], np.maximum(s[:k] / np.sqrt(max(1, len(x) - 1)), 1e-12)


def pas(source: np.ndarray, label: np.ndarray, target: np.ndarray, components: int = 10, least_rows: int = 5) -> float:
    """Prototype alignment: mean (d2 - d1) / d2 of target rows to the class centroids, in the source's whitened PCA space."""
    if min((label == k).sum() for k in (0, 1)) < least_rows:
        return float("nan")
    mean, axes, scales = whitened(source, components)
    a, b = (((x - mean) @ axes.T) / scales for x in (source, target))
    d = np.sort(np.stack([np.linalg.norm(b - a[label == k].mean(0), axis=1) for k in (0, 1)], 1), 1)
    return float(((d[:, 1] - d[:, 0]) / np.maximum(d[:, 1], 1e-12)).mean())


def normalized_pas(source: np.ndarray, label: np.ndarray, target: np.ndarray, key: np.ndarray, least_self: float = 0.01) -> float:
    """PAS of the target over PAS of a held-out fifth of the source, clipped to [0, 2]; NaN if the latter is too small."""
    rank = np.argsort(((key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11))
    held = np.zeros(len(source), bool)
    held[rank[: len(source) // 5]] = True
    own = pas(source[~held], label[~held], source[held])
    return float("nan") if not own >= least_self else float(np.clip(pas(source[~held], label[~held], target) / own, 0, 2))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag(np.r_[np.full(x.shape[1], penalty), 1e-6])
    r = np.ones(len(x)) if weights is None else weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (r * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (r * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chances(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def rank_auc(y: np.ndarray, p: np.ndarray) -> float:
    """Rank-sum AUC with ties at half; NaN with one class."""
    order = pd.Series(p).rank().to_numpy()
    n = y.sum()
    return float("nan") if n in (0, len(y)) else float((order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


def round_trip(source: np.ndarray, label: np.ndarray, target: np.ndarray) -> float:
    """2 (AUC - 0.5): a model of the source labels the target, a model of those labels is tried on the source."""
    guess = (chances(logistic(source, label), target) >= 0.5).astype(float)
    if guess.min() == guess.max():
        return 0.0
    return 2 * (rank_auc(label, chances(logistic(target, guess), source)) - 0.5)


def agreement(models: Sequence[np.ndarray], target: np.ndarray) -> float:
    """1 - 2 x mean standard deviation of the sources' predictions for each target row."""
    return float(1 - 2 * np.std([chances(m, target) for m in models], axis=0).mean())


SCORES = "table_id string, pas double, npas double, tsc double, spread double, separation double, nuclear double, n_rows long"


def _moments(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by, n, total, outer``: rows, sums and sums of products of the elements, by tasks and then over them."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)

    def sums(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, g in pdf.groupby(list(by), sort=False):
                x = g[list(names)].to_numpy(float)
                n, total, outer = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(x), total + x.sum(0), outer + x.T @ x)
        for key, (n, total, outer) in held.items():
            yield pd.DataFrame([[*key, n, total, outer.ravel()]], columns=[*by, "n", "total", "outer"])

    parts = df.select(*by, *names).mapInPandas(sums, f"{kinds}, n long, total array<double>, outer array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*pdf[list(by)].iloc[0], pdf["n"].sum(), np.sum(pdf["total"].to_list(), 0), np.sum(pdf["outer"].to_list(), 0)]], columns=[*by, "n", "total", "outer"])

    return parts.groupBy(*by).applyInPandas(add, parts.schema)


def _space(n: int, total: np.ndarray, outer: np.ndarray, components: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(mean, whitening matrix) of the leading principal components, from moments (see ``whitened``)."""
    mean = total / n
    values, axes = np.linalg.eigh((outer - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[:components]
    values, axes = np.maximum(values[order], 0), axes[:, order]
    k = int((np.sqrt(values) > 1e-7 * max(1e-12, np.sqrt(values.max(initial=0)))).sum())
    return mean, axes[:, :k] / np.maximum(np.sqrt(values[:k]), 1e-12)


def _gap(x: np.ndarray, space: tuple[np.ndarray, np.ndarray], centres: np.ndarray) -> np.ndarray:
    """(d2 - d1) / d2 of each row to two centroids in a whitened space."""
    mean, into = space
    b, c = (x - mean) @ into, (centres - mean) @ into
    d = np.sort(np.stack([np.linalg.norm(b - c[k], axis=1) for k in (0, 1)], 1), 1)
    return (d[:, 1] - d[:, 0]) / np.maximum(d[:, 1], 1e-12)


def source_scores(sources: DataFrame, target: DataFrame, features: Sequence[str], most_rows: int = 5000, least_rows: int = 5, least_self: float = 0.01) -> DataFrame:
    """``SCORES`` of each source (``table_id, row_id, label`` and features) against the target's rows.

    Means, covariances and centroids are sums over all rows, and all target rows are scored in batches; what the driver
    holds is a matrix a source. Only the logistic models (of the source, and of the target for TSC) are fitted to
    ``most_rows`` rows by a hash of row_id; TSC tries the second on all source rows. A fifth of a source's rows, by hash,
    is held out for nPAS. Missing values become the source's medians.
    """
    from pyspark.sql import Window

    from lakeweave.operators.evaluate import auc

    names, spark = list(features), sources.sparkSession
    nan = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names})
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    middles = {r["table_id"]: np.array([r[c] if r[c] is not None else 0.0 for c in names]) for r in sources.groupBy("table_id").agg(*[F.percentile(known(c), 0.5).alias(c) for c in names]).collect()}
    if not middles:
        return spark.createDataFrame([], SCORES)
    filled = lambda x, middle: np.where(np.isnan(x), 0.0, x - middle)  # noqa: E731  # from the median on, for the sums' sake
    kind, label_kind = sources.schema["table_id"].dataType.simpleString(), "int"

    def fill(batches):
        for pdf in batches:
            pdf[names] = filled(pdf[names].to_numpy(float), np.stack([middles[t] for t in pdf["table_id"]]))
            yield pdf

    held = (F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(5)) == 0).cast("int").alias("held")
    rows = nan(sources).select("table_id", "row_id", F.col("label").cast(label_kind).alias("label"), held, *names)
    rows = rows.mapInPandas(fill, rows.schema).persist()
    goal = nan(target).select("row_id", *names).persist()
    parts: dict = {}
    for r in _moments(rows, names, ["table_id", "label", "held"]).collect():
        parts.setdefault(r["table_id"], {})[r["label"], r["held"]] = (r["n"], np.array(r["total"]), np.array(r["outer"]).reshape(len(names), -1))

    def pooled(own: dict, keep) -> tuple | None:
        some = [v for k, v in own.items() if keep(*k)]
        return (sum(v[0] for v in some), sum(v[1] for v in some), sum(v[2] for v in some)) if some else None

    def standard(n: int, total: np.ndarray, outer: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple:
        cross = np.outer(total, mean)
        return n, (total - n * mean) / std, (outer - cross - cross.T + n * np.outer(mean, mean)) / np.outer(std, std)

    def prototype(own: dict, keep, mean: np.ndarray, std: np.ndarray) -> tuple | None:
        classes = [pooled(own, lambda c, h, k=k: c == k and keep(h)) for k in (0, 1)]
        if any(c is None or c[0] < least_rows for c in classes):
            return None
        return _space(*standard(*pooled(own, lambda c, h: keep(h)), mean, std)), np.stack([(c[1] / c[0] - mean) / std for c in classes])

    order = F.xxhash64("row_id")
    thin = rows.withColumn("_n", F.row_number().over(Window.partitionBy("table_id").orderBy(order))).where(F.col("_n") <= most_rows)
    some = goal.orderBy(order).limit(most_rows).select(*names).toPandas().to_numpy(float)
    plans = {}
    for name, own in parts.items():
        n, total, outer = pooled(own, lambda c, h: True)
        mean = total / n
        var = np.diag(outer) / n - mean**2
        std = np.where(var > 1e-12 * mean**2 + 1e-18, np.sqrt(np.maximum(var, 0)), np.inf)  # a constant counts 0
        plan = {"n": n, "both": all(pooled(own, lambda c, h, k=k: c == k) for k in (0, 1)), "mean": mean, "std": std, "whole": prototype(own, lambda h: True, mean, std), "part": prototype(own, lambda h: h == 0, mean, std)}
        if plan["both"]:
            centres = [pooled(own, lambda c, h, k=k: c == k) for k in (0, 1)]
            plan["separation"] = float(np.linalg.norm((centres[1][1] / centres[1][0] - centres[0][1] / centres[0][0]) / std))
        plans[name] = plan
    fits = {name: (p["mean"], p["std"]) for name, p in plans.items() if p["both"]}

    def models(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["table_id"].iloc[0]
        w, back = np.empty(0), np.empty(0)
        if name in fits and 0 < pdf["label"].mean() < 1:
            mean, std = fits[name]
            w = logistic((pdf[names].to_numpy(float) - mean) / std, pdf["label"].to_numpy(float))
            t = (filled(some, middles[name]) - mean) / std
            guess = (chances(w, t) >= 0.5).astype(float)
            back = logistic(t, guess) if guess.min() < guess.max() else back
        return pd.DataFrame([[name, w, back]], columns=["table_id", "w", "back"])

    for r in thin.groupBy("table_id").applyInPandas(models, f"table_id {kind}, w array<double>, back array<double>").collect():
        plans[r["table_id"]] |= {"w": np.array(r["w"]), "back": np.array(r["back"])}

    def on_target(batches):
        held: dict = {}
        for pdf in batches:
            raw = pdf[names].to_numpy(float)
            for name, p in plans.items():
                if not p["both"] or not len(p["w"]):
                    continue
                x = (filled(raw, middles[name]) - p["mean"]) / p["std"]
                c = chances(p["w"], x)
                gaps = [_gap(x, *p[k]).sum() if p[k] else np.nan for k in ("whole", "part")]
                held[name] = held.get(name, 0.0) + np.array([len(x), *gaps, c.sum(), (c * c).sum()])
        for name, v in held.items():
            yield pd.DataFrame([[name, *v]], columns=["table_id", "n", "pas", "part", "c", "cc"])

    def on_source(batches):
        for pdf in batches:
            for name, g in pdf.groupby("table_id", sort=False):
                p = plans[name]
                x = (g[names].to_numpy(float) - p["mean"]) / p["std"]
                out = pd.DataFrame({"table_id": g["table_id"], "label": g["label"], "own": np.nan, "p1": 0.5})
                if p["part"]:
                    out["own"] = np.where(g["held"] == 1, _gap(x, *p["part"]), np.nan)
                if len(p.get("back", ())):
                    out["p1"] = chances(p["back"], x)
                yield out

    sums = goal.mapInPandas(on_target, f"table_id {kind}, n double, pas double, part double, c double, cc double").groupBy("table_id").agg(*[F.sum(c).alias(c) for c in ("n", "pas", "part", "c", "cc")])
    on_goal = {r["table_id"]: r for r in sums.collect()}
    tried = rows.mapInPandas(on_source, f"table_id {kind}, label {label_kind}, own double, p1 double").persist()
    own_pas = {r["table_id"]: r["m"] for r in tried.groupBy("table_id").agg(F.avg(F.nanvl("own", F.lit(None))).alias("m")).collect()}
    aucs = {r["table_id"]: r["auc"] for r in auc(tried, "label", "p1", ["table_id"]).collect()}
    out = []
    for name, p in plans.items():
        row = {c.split()[0]: float("nan") for c in SCORES.split(", ")} | {"table_id": str(name), "n_rows": int(p["n"])}
        if name in on_goal:
            g, own = on_goal[name], own_pas.get(name)
            n, mean, square = g["n"], g["c"] / g["n"], g["cc"] / g["n"]
            cross, other = mean - square, 1 - 2 * mean + square
            root = np.sqrt(max(square * other - cross * cross, 0.0))  # singular values s, t: (s + t)^2 = s^2 + t^2 + 2 s t
            row |= {"pas": g["pas"] / n, "spread": float(np.sqrt(max(square - mean**2, 0.0))), "separation": p["separation"]}
            row |= {"tsc": 2 * (aucs[name] - 0.5) if len(p["back"]) else 0.0, "nuclear": float(np.sqrt(square + other + 2 * root) / np.sqrt(n))}
            if own is not None and own >= least_self:
                row["npas"] = float(np.clip(g["part"] / n / own, 0, 2))
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in row.values()))
    for df in (rows, goal, tried):
        df.unpersist()
    return spark.createDataFrame(out, SCORES)


def composite(parts: dict[str, Column]) -> Column:
    """The mean of the scores that are there."""
    there = F.array_compact(F.array(*parts.values()))
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def feature_overlap(ks: DataFrame) -> DataFrame:
    """``overlap``: the mean of 1 - KS over matched columns."""
    return ks.agg(F.round(F.avg(1 - F.col("ks")), 6).alias("overlap"))


def true_composite(scores: DataFrame, n_tables: int, target_rate: float) -> DataFrame:
    """One row: yield, quality, consistency, label agreement and overall from ``discovery_score, positive_rate`` per source."""
    quality = (F.max("discovery_score") + F.avg("discovery_score")) / 2
    consistency = 1 - F.coalesce(F.stddev_pop("discovery_score"), F.lit(0.0))
    label = F.avg(1 - F.abs(F.col("positive_rate") - target_rate))
    out = scores.agg((F.log1p(F.count(F.lit(1))) / F.log1p(F.lit(n_tables))).alias("yield"), quality.alias("quality"), consistency.alias("consistency"), label.alias("label_shift"), F.count(F.lit(1)).alias("n_sources"))
    overall = composite({c: F.col(c) for c in ("yield", "quality", "consistency", "label_shift")})
    return out.withColumn("overall", overall).select(*[F.round(c, 6).alias(c) for c in ("yield", "quality", "consistency", "label_shift", "overall")], "n_sources")


def score_correlations(table: DataFrame, scores: Sequence[str], outcome: str) -> DataFrame:
    """``score, n, pearson, spearman, p_value`` of each score with an outcome; p from the t distribution (two-sided)."""
    from lakeweave.operators.distance import average_rank

    long = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x"), F.col(outcome).cast("double").alias("y")) for s in scores])
    rows = table.select(F.explode(long).alias("r")).select("r.*").dropna()
    ranks = rows.withColumns({"rx": average_rank("x", "score"), "ry": average_rank("y", "score")})
    out = ranks.groupBy("score").agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"))

    @F.pandas_udf("double")
    def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(abs(r) * np.sqrt(max(k - 2, 0) / max(1e-12, 1 - r * r)), k - 2) if k > 2 else np.nan for r, k in zip(rho, n, strict=True)])

    return out.withColumn("p_value", p_value("spearman", "n"))


def t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by integrating its density (cosine form, exact to some 1e-10)."""
    theta = np.arctan2(t, np.sqrt(df))
    grid = lambda a, b: np.linspace(a, b, 20001)
    f = lambda u: np.cos(u) ** (df - 1)
    whole, part = (np.trapezoid(f(g), g) for g in (grid(0, np.pi / 2), grid(0, theta)))
    return float(max(0.0, 1 - part / whole))




def label_consistency(x: np.ndarray, y: np.ndarray, key: np.ndarray, folds: int = 5) -> float:
    """Mean AUC over folds (by a hash of the key, class by class) of a model of the label in its own source; 0.5 if none."""
    fold = np.zeros(len(y), int)
    n = int(min(folds, (y == 1).sum(), (y == 0).sum()))
    if n < 2:
        return 0.5
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at[np.argsort((key[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))]] = np.arange(len(at)) % n
    return float(np.mean([rank_auc(y[fold == f], chances(logistic(x[fold != f], y[fold != f]), x[fold == f])) for f in range(n)]))


def leave_one_out(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> float:
    """2 (AUC - 0.5), in [0, 1]: how well the other sources' model tells each source's labels; 0.5 with fewer than two."""
    if len(parts) < 2:
        return 0.5
    aucs = []
    for i, (x, y) in enumerate(parts):
        rest = [p for j, p in enumerate(parts) if j != i]
        a, b = np.vstack([p[0] for p in rest]), np.concatenate([p[1] for p in rest])
        if 0 < b.mean() < 1 and 0 < y.mean() < 1:
            mean, std = a.mean(0), np.maximum(a.std(0), 1e-9)
            aucs.append(rank_auc(y, chances(logistic((a - mean) / std, b), (x - mean) / std)))
    return float(np.clip(2 * (np.mean(aucs) - 0.5), 0, 1)) if aucs else 0.5


def cross_source_scores(sources: DataFrame, features: Sequence[str], most_rows: int = 300, most_sources: int = 100) -> dict[str, float]:
    """``lcc`` (mean label consistency) and ``cslp`` (leave one source out) over ``most_rows`` rows of each of
    ``most_sources`` sources: the documented bounds on what reaches the driver."""
    from pyspark.sql import Window

    names = list(features)
    some = sources.select("table_id").distinct().orderBy(F.xxhash64("table_id")).limit(most_sources)
    thin = sources.join(F.broadcast(some), "table_id").withColumn("_n", F.row_number().over(Window.partitionBy("table_id").orderBy(F.xxhash64("row_id")))).where(F.col("_n") <= most_rows)
    pdf = thin.select("table_id", "row_id", "label", *names).toPandas()
    parts, keys = [], []
    for _, g in pdf.groupby("table_id"):
        parts.append((np.nan_to_num(g[names].to_numpy(float)), g["label"].to_numpy(float)))
        keys.append(g["row_id"].to_numpy())
    lcc = [label_consistency(x, y, k) for (x, y), k in zip(parts, keys, strict=True)]
    return {"lcc": round(float(np.mean(lcc)), 6) if lcc else 0.5, "cslp": round(leave_one_out(parts), 6)}
