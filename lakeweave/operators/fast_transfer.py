"""The quick scores of how far sources may carry over to a target, without fitting an adapted model.

Every score comes from sums over all rows: moments, ranges and counts are added up per source on the executors, each
source's small plan (centroids, a whitened space) is made there too, and the target's rows are held against the plans in
blocks of bounded size. The driver holds the target's own moments, one block of plans at a time, and nothing of a source
but its scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.adapt import cut
from lakeweave.operators.transfer import _moments, _space, cross_source_scores, label_consistency

#: bytes of plans that are broadcast at once, and steps of the grid on which distributions are compared
MOST_BYTES, STEPS = 32_000_000, 200
#: similarities from which a column counts as matched, for the strict and the lenient scores
TIGHT, LOOSE = 0.60, 0.50

SCORES = ("pas", "pas_loose", "source_pas", "pca_pas", "overlap", "lcc")
_PLAN = "n long, tight array<boolean>, loose array<boolean>, low array<double>, width array<double>, centres array<double>, mean array<double>, std array<double>, into array<double>, moved array<double>, separation double"


def matched_columns(matches: DataFrame, features: Sequence[str]) -> DataFrame:
    """``table_id, tight, loose``: for each feature whether a source has a column for it, from ``table_id, tgt_col, sim``."""
    best = matches.groupBy("table_id").agg(*[F.max(F.when(F.col("tgt_col") == c, F.col("sim"))).alias(f"_{i}") for i, c in enumerate(features)])
    flags = lambda least: F.array(*[F.coalesce(F.col(f"_{i}") >= least, F.lit(False)) for i in range(len(features))])
    return best.select("table_id", flags(TIGHT).alias("tight"), flags(LOOSE).alias("loose"))


def _filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features as numbers, 0 where one is missing."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in names})


def _target_space(goal: DataFrame, names: Sequence[str]) -> dict | None:
    """Standard units of the target and its leading components (half as many as features, 2 to 10); None with fewer
    than four features."""
    if len(names) < 4:
        return None
    k = max(2, min(10, len(names) // 2))
    r = _moments(goal.withColumn("_one", F.lit(0)), names, ["_one"]).first()
    if r is None or r["n"] < k + 1:
        return None
    n, total, outer = r["n"], np.array(r["total"]), np.array(r["outer"]).reshape(len(names), -1)
    mean = total / n
    std = np.sqrt(np.maximum(np.diag(outer) / n - mean**2, 0))
    std = np.where(std > 1e-9 * np.maximum(1, np.abs(mean)), std, 1.0)
    scaled = (outer - n * np.outer(mean, mean)) / np.outer(std, std)
    into = _space(n, np.zeros(len(names)), scaled, k)[1]
    return {"mean": mean, "std": std, "into": into, "spread": float(np.sqrt((n - 1) / n))}


def _plans(rows: DataFrame, names: Sequence[str], space: dict | None, least_rows: int) -> DataFrame:
    """``table_id`` and the columns of ``_PLAN`` for each source: what scoring it takes, from its moments."""
    width = len(names)
    kind = rows.schema["table_id"].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (t, y), g in pdf.groupby(["table_id", "label"], sort=False):
                x = g[list(names)].to_numpy(float)
                out.append((t, y, len(x), x.sum(0), (x.T @ x).ravel(), x.min(0), x.max(0), g["tight"].iloc[0], g["loose"].iloc[0]))
            yield pd.DataFrame(out, columns=["table_id", "label", "n", "total", "outer", "low", "high", "tight", "loose"])

    parts = rows.mapInPandas(sums, f"table_id {kind}, label int, n long, total array<double>, outer array<double>, low array<double>, high array<double>, tight array<boolean>, loose array<boolean>")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        tight, loose = (np.array(pdf[c].iloc[0], bool) for c in ("tight", "loose"))
        each = {}
        for y, g in pdf.groupby("label"):
            each[int(y)] = (int(g["n"].sum()), np.sum(g["total"].to_list(), 0), np.sum(g["outer"].to_list(), 0).reshape(width, width))
        n = sum(v[0] for v in each.values())
        low, high = np.min(pdf["low"].to_list(), 0), np.max(pdf["high"].to_list(), 0)
        row = {"table_id": pdf["table_id"].iloc[0], "n": n, "tight": tight, "loose": loose, "low": low, "width": high - low + 1e-9}
        row |= {c: None for c in ("centres", "mean", "std", "into", "moved", "separation")}
        if set(each) >= {0, 1} and min(each[k][0] for k in (0, 1)) >= least_rows:
            centres = np.stack([each[k][1] / each[k][0] for k in (0, 1)])
            row["centres"] = centres.ravel()
            total, outer = (sum(each[k][i] for k in (0, 1)) for i in (1, 2))
            mean = total / n
            std = np.sqrt(np.maximum(np.diag(outer) / n - mean**2, 0))
            std = np.where(std > 1e-9 * np.maximum(1, np.abs(mean)), std, 1.0)
            used = np.flatnonzero(loose)
            k = min(len(used), max(2, min(10, n // 10)))
            if k >= 2 and n > k:
                scaled = ((outer - n * np.outer(mean, mean)) / np.outer(std, std))[np.ix_(used, used)]
                into = np.zeros((width, k))
                part = _space(n, np.zeros(len(used)), scaled, k)[1]
                into[used, : part.shape[1]] = part
                row |= {"mean": mean, "std": std, "into": into.ravel(), "moved": (((centres - mean) / std) @ into).ravel()}
            if space is not None and tight.any():
                b = np.where(tight[:, None], space["into"] / space["std"][:, None], 0.0)
                inner = sum(b.T @ (each[c][2] - each[c][0] * np.outer(centres[c], centres[c])) @ b for c in (0, 1)) / (n - 2)
                gap = (centres[1] - centres[0]) @ b
                row["separation"] = float(np.sqrt(max(0.0, gap @ np.linalg.pinv(inner + 1e-6 * np.eye(len(gap))) @ gap)))
        return pd.DataFrame([row])

    return parts.groupBy("table_id").applyInPandas(plan, f"table_id {kind}, {_PLAN}")


def _margin(x: np.ndarray, centres: np.ndarray) -> float:
    """The sum over rows of (d2 - d1) / d2 of the distances to two centres."""
    d = np.sort(np.stack([np.linalg.norm(x - c, axis=1) for c in centres], 1), 1)
    return float(((d[:, 1] - d[:, 0]) / (d[:, 1] + 1e-9)).sum())


def _margins(goal: DataFrame, plans: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """``table_id, pas, pas_loose, source_pas``: means over all target rows, for blocks of plans at a time."""
    width = len(names)
    columns = ("centres", "low", "width", "tight", "loose", "mean", "std", "into", "moved")
    size = 8 * (12 * width + 12 * width)
    total = plans.where("centres is not null").count()
    blocks = max(1, -(-total * size // MOST_BYTES))
    spark = goal.sparkSession
    out = None
    for i in range(blocks):
        held = plans.where("centres is not null").where(F.pmod(F.xxhash64("table_id"), F.lit(blocks)) == i).select("table_id", *columns).collect()
        if not held:
            continue
        shared = spark.sparkContext.broadcast([{c: None if r[c] is None else np.array(r[c]) for c in columns} | {"table_id": r["table_id"]} for r in held])
        one = _held_against(goal, names, shared, kind)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return plans.where("false").select("table_id", *[F.lit(None).cast("double").alias(c) for c in ("pas", "pas_loose", "source_pas")])
    sums = out.groupBy("table_id").agg(*[F.sum(c).alias(c) for c in ("rows", "pas", "pas_loose", "source_pas")])
    return sums.select("table_id", *[(F.col(c) / F.col("rows")).alias(c) for c in ("pas", "pas_loose", "source_pas")])


def _held_against(goal: DataFrame, names: Sequence[str], shared, kind: str) -> DataFrame:
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = pdf[list(names)].to_numpy(float)
            for i, p in enumerate(shared.value):
                centres, got = p["centres"].reshape(2, -1), [len(x)]
                for mask in (p["tight"], p["loose"]):
                    at = np.flatnonzero(mask)
                    scale = lambda v, at=at: (v[:, at] - p["low"][at]) / p["width"][at]  # noqa: B023, E731
                    got.append(_margin(scale(x), scale(centres)) if len(at) >= 2 else np.nan)
                if p["into"] is None:
                    got.append(np.nan)
                else:
                    into = p["into"].reshape(len(names), -1)
                    got.append(_margin(((x - p["mean"]) / p["std"]) @ into, p["moved"].reshape(2, -1)))
                sums[i] = sums.get(i, 0.0) + np.array(got)
        rows = [(shared.value[i]["table_id"], *(None if np.isnan(v) else float(v) for v in s)) for i, s in sums.items()]
        yield pd.DataFrame(rows, columns=["table_id", "rows", "pas", "pas_loose", "source_pas"])

    return goal.select(*names).mapInPandas(run, f"table_id {kind}, rows double, pas double, pas_loose double, source_pas double")


def _spread(rows: DataFrame, names: Sequence[str], space: dict | None, grid: list[np.ndarray], kind: str) -> DataFrame:
    """``table_id, inside, below``: the share of a source's values within two deviations of the target, component by
    component, and for each feature and step of the grid the share of its rows up to there."""
    cells = sum(len(g) for g in grid)

    def sums(batches):
        for pdf in batches:
            out = []
            for t, g in pdf.groupby("table_id", sort=False):
                x = g[list(names)].to_numpy(float)
                inside = np.nan
                if space is not None:
                    tight = np.array(g["tight"].iloc[0], bool)
                    z = np.where(tight, (x - space["mean"]) / space["std"], 0.0) @ space["into"]
                    inside = float((np.abs(z) <= 2 * (space["spread"] + 1e-9)).mean(1).sum())
                below = np.concatenate([np.searchsorted(np.sort(x[:, i]), steps, "right") for i, steps in enumerate(grid)]) if cells else np.empty(0)
                out.append((t, len(x), inside, below.astype(float)))
            yield pd.DataFrame(out, columns=["table_id", "n", "inside", "below"])

    parts = rows.mapInPandas(sums, f"table_id {kind}, n long, inside double, below array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        return pd.DataFrame([(pdf["table_id"].iloc[0], pdf["inside"].sum() / n if space is not None else np.nan, np.sum(pdf["below"].to_list(), 0) / n)], columns=["table_id", "inside", "below"])

    return parts.groupBy("table_id").applyInPandas(add, f"table_id {kind}, inside double, below array<double>")


def source_scores(sources: DataFrame, target: DataFrame, features: Sequence[str], matched: DataFrame | None = None, least_rows: int = 5, most_rows: int = 5000) -> DataFrame:
    """``table_id, pas, pas_loose, source_pas, pca_pas, overlap, lcc, n_rows`` of each source (``table_id, row_id, label``
    and the target's features) against all target rows; missing values count 0, as do columns that a source lacks.

    pas, pas_loose: the mean margin of the target's rows between the source's class centroids, scaled by the source's
    ranges, over the columns that match strictly or leniently (``matched``; without it all count). source_pas: the same in
    the source's whitened components. pca_pas: the Mahalanobis distance of the classes in the target's components, times
    the share of the source that lies where the target does, over the root of their number. overlap: 1 - KS over lenient
    columns, on the target's distinct values or STEPS quantiles of them (exact to 1 / STEPS). lcc: AUC of a model of the
    source's own labels over five folds of ``most_rows`` of its rows. Null where a class has under ``least_rows`` rows or
    too few columns match.
    """
    names = list(features)
    kind = sources.schema["table_id"].dataType.simpleString()
    if matched is None:
        every = F.array(*[F.lit(True)] * len(names))
        rows = sources.withColumns({"tight": every, "loose": every})
    else:
        rows = sources.join(matched, "table_id")
    rows = cut(_filled(rows.select("table_id", "row_id", F.col("label").cast("int").alias("label"), "tight", "loose", *names).where("label is not null"), names))
    goal = cut(_filled(target.select(*names), names))
    space = _target_space(goal, names)
    plans = cut(_plans(rows, names, space, least_rows))
    levels = [i / STEPS for i in range(1, STEPS + 1)]
    found = goal.agg(*[F.percentile_approx(c, levels, 10 * STEPS).alias(f"_{i}") for i, c in enumerate(names)]).first()
    grid = [np.unique(np.array(found[f"_{i}"] or [], float)) for i in range(len(names))]
    own = _spread(goal.withColumns({"table_id": F.lit(0), "tight": F.array(*[F.lit(True)] * len(names))}), names, None, grid, "int").first()
    goal_below = np.array(own["below"]) if own else np.zeros(sum(len(g) for g in grid))
    starts = np.cumsum([0, *[len(g) for g in grid]])
    spread = _spread(rows, names, space, grid, kind)

    @F.pandas_udf("double")
    def ks_overlap(below: pd.Series, loose: pd.Series) -> pd.Series:
        gaps = []
        for b, m in zip(below, loose, strict=True):
            gap = np.abs(np.asarray(b) - goal_below)
            used = [1 - gap[starts[i] : starts[i + 1]].max(initial=0.0) for i in np.flatnonzero(m)]
            gaps.append(float(np.mean(used)) if used else None)
        return pd.Series(gaps, dtype="float64")

    def consistency(pdf: pd.DataFrame) -> pd.DataFrame:
        used = np.flatnonzero(np.array(pdf["loose"].iloc[0], bool))
        y = pdf["label"].to_numpy(float)
        ok = len(used) and min((y == 1).sum(), (y == 0).sum()) >= least_rows
        x = pdf[names].to_numpy(float)[:, used]
        scale = x.std(0)
        x = (x - x.mean(0)) / np.where(scale > 0, scale, 1.0)
        return pd.DataFrame([(pdf["table_id"].iloc[0], label_consistency(x, y, pdf["_key"].to_numpy()) if ok else np.nan)], columns=["table_id", "lcc"])

    from pyspark.sql import Window

    key = F.xxhash64("row_id")
    thin = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("table_id").orderBy("_key"))).where(F.col("_n") <= most_rows).drop("_n", "row_id", "tight")
    lcc = thin.groupBy("table_id").applyInPandas(consistency, f"table_id {kind}, lcc double")
    both = plans.join(spread, "table_id", "left").join(_margins(goal, plans, names, kind), "table_id", "left").join(lcc, "table_id", "left")
    root = float(np.sqrt(space["into"].shape[1])) if space is not None else 1.0
    nan = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    pca = F.col("separation") * nan(F.col("inside")) / root
    columns = {"pas": F.col("pas"), "pas_loose": F.col("pas_loose"), "source_pas": F.col("source_pas"), "pca_pas": pca, "overlap": ks_overlap("below", "loose"), "lcc": nan(F.col("lcc"))}
    return both.select("table_id", *[F.round(v, 6).alias(c) for c, v in columns.items()], F.col("n").alias("n_rows"))


def overall(scores: DataFrame, sources: DataFrame, features: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """One row: every score's mean over the sources (by ``weights``: table_id, weight; 0.5 where none has it, pca_pas at
    most 1), ``cslp`` (see ``cross_source_scores``) and ``overall``, the mean of source_pas, overlap and 1 - cslp."""
    w = scores.withColumn("weight", F.lit(1.0)) if weights is None else scores.join(weights.select("table_id", "weight"), "table_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))), F.lit(0.5))
    plain = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    parts = {c: plain(c) if c in ("overlap", "lcc") else mean(c) for c in SCORES} | {"pca_pas": F.least(mean("pca_pas"), F.lit(1.0))}
    cslp = cross_source_scores(sources, features)["cslp"]
    row = w.agg(*[v.alias(c) for c, v in parts.items()]).withColumn("cslp", F.lit(float(cslp)))
    row = row.withColumn("overall", (F.col("source_pas") + F.col("overlap") + 1 - F.col("cslp")) / 3)
    return row.select(*[F.round(c, 6).alias(c) for c in (*SCORES, "cslp", "overall")])
