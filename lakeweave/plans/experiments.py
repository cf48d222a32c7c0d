"""Whole experiments: from a lake and a target to metrics in one call, and sweeps that can be resumed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import adapt, ranking
from lakeweave.operators.sampling import hash_sample, split
from lakeweave.plans import pipeline
from lakeweave.plans.pipeline import Experiment
from lakeweave.sources import lake, store

_METRICS = "level string, accuracy double, f1 double, auc double, accuracy_delta double, f1_delta double, auc_delta double, place int"


def run(spark: SparkSession, manifest: DataFrame, cells: DataFrame, target: DataFrame, features: Sequence[str], e: Experiment, directions: DataFrame | None = None, manual: dict[str, str] | None = None, flipped: Sequence[str] = (), levels: bool = True) -> dict[str, DataFrame]:
    """Discovery, alignment, adaptation and evaluation. ``target``: row_id, label and features.

    Returns what ``discover`` does, and ``sources`` and ``metrics``. Labels of the target are held out: only a test part
    is predicted, and the rest teaches the ``oracle`` alone. With ``manual`` sources ({table_id: proxy column}) nothing is
    scanned, and ``flipped`` names those whose labels speak the other way round. Without any source the metrics are empty.
    """
    known, test = (adapt.stored(df) for df in split(target, "row_id", 0.5))
    found = pipeline.discover(spark, manifest, cells, target, features, e, directions=directions, manual=manual)
    sources = adapt.cut(pipeline.aligned_sources(cells, found, features, e, flipped))
    out = found | {"sources": sources, "metrics": spark.createDataFrame([], _METRICS)}
    if not levels or sources.isEmpty():
        return out
    names = [r[0] for r in sources.select("table_id").distinct().collect()]  # e.k at most
    scores = {r["table_id"]: r["discovery_score"] for r in found["scores"].where(F.col("table_id").isin(*names)).collect()}
    volume = pipeline.volume_rows(cells, found, sources, features, e)
    metrics = pipeline.run_levels(sources, test, features, scores, e.booster, volume=None if volume.isEmpty() else volume, known=known)
    return out | {"metrics": metrics}


def labelled_lake_run(spark: SparkSession, cells: DataFrame, labels: dict[str, str], target: DataFrame, features: Sequence[str], e: Experiment) -> dict[str, DataFrame]:
    """``run`` over a lake whose tables have labels of their own: {table_id: the label's column}."""
    return run(spark, lake.manifest_of(cells), cells, target, features, e, manual=labels)


def lake_of(manifest: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """The manifest's first ``size`` tables in seeded order; all of them without a size."""
    return manifest if size is None else hash_sample(manifest, "table_id", size, seed)


def sweep(spark: SparkSession, root: str, name: str, settings: Iterable[dict], one: Callable[[dict], DataFrame]) -> DataFrame:
    """The metrics of all settings, with each setting's values and ``seconds`` as columns.

    A setting's result is stored under its values; one that is there isn't run again, so a sweep goes on where it stopped.
    """
    out = None
    for s in settings:

        def compute(s=s) -> DataFrame:
            began = time.perf_counter()
            rows = adapt.cut(one(s))
            return rows.withColumn("seconds", F.lit(round(time.perf_counter() - began, 3)))

        rows = store.stage(spark, root, name, s, compute).withColumns({k: F.lit(v) for k, v in s.items()})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def scalability(spark: SparkSession, root: str, manifest: DataFrame, cells: DataFrame, targets: dict[str, tuple[DataFrame, Sequence[str], Experiment]], sizes: Sequence[int]) -> DataFrame:
    """Metrics and seconds of every target over lakes of growing size."""

    def one(s: dict) -> DataFrame:
        some = adapt.cut(lake_of(manifest, s["lake_size"]))
        target, features, e = targets[s["target"]]
        return run(spark, some, cells.join(some.select("table_id"), "table_id", "left_semi"), target, features, e)["metrics"]

    return sweep(spark, root, "scalability", [{"target": t, "lake_size": n} for t in targets for n in sorted(set(sizes))], one)


def sensitivity(spark: SparkSession, root: str, manifest: DataFrame, cells: DataFrame, target: DataFrame, features: Sequence[str], e: Experiment, ks: Sequence[int] = (5, 10, 20, 50), thresholds: Sequence[float] = (0.55, 0.65, 0.70)) -> DataFrame:
    """Metrics by the number of sources (at the experiment's threshold) and by the threshold (at its number)."""
    from dataclasses import replace

    settings = [{"target": e.label, "k": k, "threshold": e.concept} for k in ks] + [{"target": e.label, "k": e.k, "threshold": t} for t in thresholds]
    unique = [dict(x) for x in dict.fromkeys(tuple(s.items()) for s in settings)]
    return sweep(spark, root, "sensitivity", unique, lambda s: run(spark, manifest, cells, target, features, replace(e, k=s["k"], concept=s["threshold"]))["metrics"])


#: fixed values: levels that use no lake, and the one that uses the target's labels
REFERENCES = ("baseline_a", "baseline_b", "baseline_c", "oracle")


def best_levels(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, best, best_value``: the level with the highest AUC among those that adapt."""
    from lakeweave.operators.evaluate import best_row

    return best_row(metrics, list(by), "level", "auc", REFERENCES)


def filter_combinations(found: dict[str, DataFrame], proxies: DataFrame, concepts: DataFrame, self_auc: DataFrame, rates: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """``table_id, combination`` of the sources that each combination of filters keeps: the proxy's meaning, the rate of
    positives and the sources' own AUC. ``proxies``: table_id, vector; ``self_auc``: table_id, self_auc."""
    kept = found["lake"].where("kept").select("table_id", "positive_rate")
    semantic = ranking.semantic_gate(proxies, concepts).select("table_id", F.lit(True).alias("semantic"))
    own = ranking.self_auc_gate(self_auc).select("table_id", F.lit(True).alias("self_auc"))
    marks = kept.join(semantic, "table_id", "left").join(own, "table_id", "left")
    passes = {"semantic": F.coalesce("semantic", F.lit(False)), "posrate": F.col("positive_rate").between(*rates), "self_auc": F.coalesce("self_auc", F.lit(False))}
    names = list(passes)
    combinations = F.array(*[F.lit("+".join(n for i, n in enumerate(names) if c >> i & 1) or "none") for c in range(1 << len(names))])
    needed = F.filter(combinations, lambda c: F.aggregate(F.array(*[passes[n] | ~F.contains(c, F.lit(n)) for n in names]), F.lit(True), lambda a, x: a & x))
    return marks.select("table_id", F.explode(needed).alias("combination"))


#: what is made of a share of the target's labels, by name
METHODS = ("target_only", "pooled", "fine_tuned", "self_trained", "blended", "routed", "stacked")


def _method(name: str, sources: DataFrame, features: Sequence[str], booster: adapt.Booster, evidence: float) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """(labelled rows, rows to tell, seed) -> result, for one of METHODS."""

    def own(known: DataFrame, rest: DataFrame) -> DataFrame:
        return adapt.result(adapt.fit(known, features, booster, None)(rest), "target_only")

    def blended(known: DataFrame, rest: DataFrame) -> DataFrame:
        n = known.count()
        return adapt.blended(adapt.baseline_c(sources, rest, features, booster), own(known, rest), n / (n + evidence) if n + evidence else 0.0)

    def stacked(known: DataFrame, rest: DataFrame) -> DataFrame:
        p = adapt.source_predictions(sources, known.select("row_id", *features).unionByName(rest.select("row_id", *features)), features, booster)
        return adapt.stacked(p, known, rest, features, booster)

    each = {
        "target_only": own, "blended": blended, "stacked": stacked,
        "pooled": lambda known, rest: adapt.pooled_with_validation(sources, known, rest, features, booster),
        "fine_tuned": lambda known, rest: adapt.fine_tuned(sources, known, rest, features, booster),
        "self_trained": lambda known, rest: adapt.self_trained_with_labels(sources, known, rest, features, booster),
        "routed": lambda known, rest: adapt.routed(sources, known, rest, features, booster)[1],
    }
    return lambda known, rest, seed: each[name](known, rest)


def semi_supervised(sources: DataFrame, target: DataFrame, features: Sequence[str], booster: adapt.Booster = adapt.Booster(), fractions: Sequence[float] = (0.05, 0.10, 0.20), seeds: Sequence[int] = (0, 1, 2), methods: Sequence[str] = METHODS, evidence: float = 100.0) -> DataFrame:
    """``method, fraction, auc_mean, auc_std``: what each method makes of a share of the target's labels, judged on the
    rest, over seeds. ``target``: row_id, label and features; ``evidence`` is what the lake's model weighs in rows."""
    from lakeweave.operators.evaluate import over_seeds

    out = None
    for m in methods:
        curve = pipeline.label_curve(target, fractions, seeds, _method(m, sources, features, booster, evidence)).withColumn("method", F.lit(m))
        out = curve if out is None else out.unionByName(curve)
    return over_seeds(out, ["method", "fraction"], ["auc"])


def cold_start(sources: DataFrame, target: DataFrame, features: Sequence[str], scores: dict[str, float], booster: adapt.Booster = adapt.Booster(), weeks: int = 10) -> DataFrame:
    """``week, n_labelled, alpha, auc``: half of the target's labels arrive week by week, the other half judges the blend of
    the lake's model and one of the labels so far. The lake weighs the sum of score x min(rows, 1000) of its sources."""
    known, test = (adapt.cut(df) for df in split(target, "row_id", 0.5))
    names = sources.sparkSession.createDataFrame([(k, float(v)) for k, v in scores.items()], f"table_id {sources.schema['table_id'].dataType.simpleString()}, s double")
    sizes = sources.groupBy("table_id").agg(F.least(F.count(F.lit(1)), F.lit(1000)).alias("n")).join(names, "table_id")
    evidence = sizes.agg(F.sum(F.col("s") * F.col("n"))).first()[0] or 0.0
    told = adapt.cut(adapt.baseline_c(sources, test.drop("label"), features, booster))
    return pipeline.cold_start(known, test, features, told, float(evidence), booster, weeks)


def compare_lakes(spark: SparkSession, root: str, lakes: dict[str, tuple[DataFrame, DataFrame]], target: DataFrame, features: Sequence[str], e: Experiment) -> DataFrame:
    """``target`` and a column for each lake (name: manifest, cells): the gap to the oracle that its best level closes. The
    metrics of each lake are stored, so that a comparison goes on where it stopped."""
    found = sweep(spark, root, "lakes", [{"target": e.label, "lake": name} for name in lakes], lambda s: run(spark, *lakes[s["lake"]], target, features, e)["metrics"])
    return pipeline.compared(found, "lake", list(lakes))
