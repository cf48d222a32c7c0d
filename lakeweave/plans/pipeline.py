"""From a lake and a target to predictions and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.vectors import dot, unit
from lakeweave.operators import adapt, align, distance, evaluate, matching, nets, ranking, repurpose
from lakeweave.operators.binarize import binarize
from lakeweave.sources import lake

#: levels that are fitted side by side
AT_ONCE = 4


@dataclass(frozen=True)
class Experiment:
    """What a run depends on; a stage's stored result is keyed by all of it."""

    label: str
    concepts: tuple[str, ...]
    k: int = 20
    concept: float = 0.70
    table: float = 0.20
    context: float = 0.12
    rest: float = 0.10
    share: float = 0.25
    sibling: float = 0.70
    least_sim: float = 0.35
    least_columns: int = 4
    least_coverage: float = 0.40
    trade: float = 0.7
    booster: adapt.Booster = field(default_factory=adapt.Booster)


def distribution_scores(cells: DataFrame, target: DataFrame, features: Sequence[str]) -> DataFrame:
    """``table_id, dist_sim`` of source cells: by deciles where column names meet the target's, else by KS matching."""
    goal = target.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in features])).alias("c")).select("c.*")
    full = lambda df: df.where("value is not null and not isnan(value)")
    goal, rows = adapt.cut(full(goal)), full(cells.select("table_id", F.col("col").alias("column"), F.col("value").cast("double").alias("value")))
    named = cells.where(F.col("col").isin(*features)).select("table_id").distinct()
    shared = distance.table_similarity(rows.join(named, "table_id", "left_semi"), goal)
    others = rows.join(named, "table_id", "left_anti").select(F.struct("table_id", "column").alias("column"), "value")
    ks = distance.ks_matrix(others, goal).select("left_column.table_id", F.col("left_column.column").alias("src_col"), F.col("right_column").alias("tgt_col"), "ks")
    return shared.unionByName(matching.distribution_matches(ks, len(features)))


def discover(spark: SparkSession, manifest: DataFrame, cells: DataFrame, target: DataFrame | None, features: Sequence[str], e: Experiment, encoder: matching.NameEncoder | None = None, target_rate: float | None = None, directions: DataFrame | None = None, manual: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Steps 0 and 1: labelled sources and their discovery scores.

    Returns ``proxies``, ``lake`` (what became of each proxy), ``scores``, ``matches`` and ``vectors`` (of the proxies'
    names); for cells with a ``text`` also ``categories``, the labels of the words of proxies. Columns of words meet the
    target's columns of words only. Names come from the manifest, so only the proxies' cells and those of the tables that are left are read.
    ``directions`` (``col, direction``) tells which proxies speak against the label. ``manual`` ({table_id: proxy column})
    takes the place of the scan. ``target_rate`` is the mean of the target's ``label`` if that is there and no rate is given. Without a target
    distributions count 0 and rates are left out.
    """
    encoder = encoder or matching.HashedNgramEncoder()
    columns = lake.columns_of(manifest)
    names = adapt.stored(matching.encode_names(columns, encoder))
    concepts = matching.encode_names(spark.createDataFrame([(c,) for c in e.concepts], "name string"), encoder)
    goal = matching.encode_names(spark.createDataFrame([(c,) for c in features], "name string"), encoder)
    if manual is None:
        proxies = adapt.stored(repurpose.scan(columns, names, concepts, goal, e.table, e.concept, e.context, e.rest, e.share, e.sibling))
    else:
        chosen = spark.createDataFrame([(k, v) for k, v in manual.items()], "table_id string, proxy_col string")
        there = columns.join(chosen, "table_id").where("name = proxy_col")
        near = F.max(dot(unit("vector"), unit("_c")))
        sims = names.join(F.broadcast(concepts.select(F.col("vector").alias("_c")))).groupBy("name").agg(F.round(near, 6).alias("similarity"))
        proxies = adapt.stored(there.join(sims, "name").select("table_id", F.col("pos").alias("proxy_pos"), "proxy_col", "similarity"))
    if directions is None:
        directions = spark.createDataFrame([], "col string, direction string")
    categories = None
    if "text" in cells.columns:
        categories = adapt.cut(repurpose.category_labels(cells, proxies, directions, encoder, concepts))
    labelled = adapt.stored(repurpose.labelled_lake(cells, proxies, directions, categories=categories))
    kept = labelled.where("kept").select("table_id", "proxy_col", "positive_rate", "quality", "threshold")
    sources = columns.join(kept.select("table_id", "proxy_col"), "table_id").where("name <> proxy_col").join(names, "name")
    types = lake.column_types(cells.join(kept.select("table_id"), "table_id", "left_semi")).withColumnRenamed("col", "name")
    sources = sources.join(types, ["table_id", "name"], "left").withColumn("is_num", F.coalesce("is_num", F.lit(True)))
    words = [] if target is None else [c for c in features if dict(target.dtypes)[c] == "string"]
    matches = adapt.stored(matching.match_columns(sources.select("table_id", "name", "is_num", "vector"), goal.withColumn("is_num", ~F.col("name").isin(*words))))
    label_sim = proxies.select("table_id", F.col("similarity").alias("label_sim"))
    parts = matching.schema_similarity(matches).join(kept, "table_id").join(label_sim, "table_id").withColumn("label_name", F.col("proxy_col"))
    if target is None:
        parts = parts.withColumn("dist_sim", F.lit(0.0))
    else:
        own = adapt.stored(cells.join(kept.select("table_id", "proxy_col"), "table_id").where("col <> proxy_col").select("table_id", "col", "value"))
        parts = parts.join(adapt.cut(distribution_scores(own, target, features)), "table_id", "left")
        if target_rate is None and "label" in target.columns:
            target_rate = target.agg(F.avg("label")).first()[0]
    scores = align.discovery_scores(parts, target_rate).join(kept.select("table_id", "quality"), "table_id").withColumn("discovery_score", F.round(F.col("discovery_score") * F.col("quality"), 6))
    vectors = kept.join(names, F.col("proxy_col") == F.col("name")).select("table_id", "vector")
    return {"proxies": proxies, "lake": labelled, "scores": adapt.stored(scores.select("table_id", "discovery_score")), "matches": matches, "vectors": adapt.stored(vectors)} | ({} if categories is None else {"categories": categories})


def aligned_sources(cells: DataFrame, found: dict[str, DataFrame], features: Sequence[str], e: Experiment, flipped: Sequence[str] = ()) -> DataFrame:
    """Step 2: ``table_id, row_id, label, weight`` and the target's columns of k good sources with unlike proxies.

    Labels of the tables ``flipped`` are turned round.
    """
    best = found["scores"].agg(F.max("discovery_score")).first()[0] or 1.0
    rated = found["scores"].join(found["vectors"], "table_id").withColumn("_s", F.col("discovery_score") / best)
    top = found["scores"].where(F.col("table_id").isin(ranking.mmr(rated, "table_id", "_s", "vector", e.k, e.trade)))
    good = align.with_fallbacks(found["matches"].join(top.select("table_id"), "table_id", "left_semi"), cells, len(features), e.least_columns, e.least_coverage, e.least_sim)
    matches = found["matches"].join(good.select("table_id"), "table_id", "left_semi").where(F.col("sim") >= e.least_sim)
    kept = found["lake"].where("kept").select("table_id", F.col("proxy_col").alias("col"), "threshold", "direction")
    mine = cells.join(kept, ["table_id", "col"])
    ends = mine.groupBy("table_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    # as they were judged in ``labelled_lake``
    label = binarize("value", F.col("threshold"), F.col("_low"), F.col("_high"), F.col("direction"))
    label = F.when(F.col("table_id").isin(*flipped), 1 - label).otherwise(label) if flipped else label
    labels = mine.where("value is not null").join(ends, "table_id").select("table_id", "row_id", label.alias("label"))
    if "categories" in found:
        said = mine.where("text is not null").join(found["categories"], ["table_id", "text"])
        turned = F.when(F.col("table_id").isin(*flipped), 1 - F.col("label")).otherwise(F.col("label")) if flipped else F.col("label")
        labels = labels.unionByName(said.select("table_id", "row_id", turned.alias("label")))
    rows = align.align_tables(cells, matches, features).join(labels, ["table_id", "row_id"])
    total = top.agg(F.sum("discovery_score").alias("_t"))
    weights = top.join(F.broadcast(total)).select("table_id", (F.col("discovery_score") / F.col("_t")).alias("weight"))
    return rows.join(F.broadcast(weights), "table_id")


def volume_rows(cells: DataFrame, found: dict[str, DataFrame], used: DataFrame, features: Sequence[str], e: Experiment) -> DataFrame:
    """Rows (without labels) of the ``k`` best sources that failed the alignment's gates, aligned without any gate: more of
    the sources' domain for the nets that tell domains apart. ``used``: what ``aligned_sources`` gave."""
    top = ranking.top_k(found["scores"], "discovery_score", e.k, "table_id").select("table_id")
    rest = top.join(used.select("table_id").distinct(), "table_id", "left_anti")
    return align.align_tables(cells, found["matches"].join(rest, "table_id", "left_semi"), features)


def run_levels(sources: DataFrame, target: DataFrame, features: Sequence[str], scores: dict[str, float], booster: adapt.Booster = adapt.Booster(), rounds: Sequence[float] | None = None, volume: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Steps 3 and 4: ``level, accuracy, f1, auc`` and their deltas; ``target`` has a ``label`` for the evaluation only.

    The threshold meets the sources' class rate, never the target's. ``rounds`` of self-training: the operator's, if None. ``volume``: see
    ``volume_rows``; the nets are fitted to all rows of the three. ``known``: labelled rows of the target apart from those; they
    teach the ``oracle`` alone.
    """
    plain = target.drop("label")
    features = adapt.common_features(sources, plain, features)
    best = max(scores, key=lambda k: (scores[k], k))
    schedule = {} if rounds is None else {"rounds": rounds}

    def adapted() -> list[DataFrame]:
        middle = adapt.medians(sources, features)
        goal = nets.filled(plain, features, middle)
        more = None if volume is None else adapt.stored(nets.filled(volume, features, middle).select("row_id", *features))
        (net, conditional), rate = nets.adversarial(nets.filled(sources, features, middle), goal, features, more)
        calmed = nets.test_time_adapted(net, goal, features, rate)
        return [adapt.with_net(n, goal, features, level) for n, level in ((net, "level5"), (conditional, "level55"), (calmed, "level6"))]

    def trained(**how: bool) -> DataFrame:
        return adapt.stored(adapt.self_trained(sources, plain, features, booster, **how, **schedule))

    # no level waits for another: each model is one task or a chain of them, and several are fitted side by side
    steps = [
        lambda: trained(), lambda: trained(shift=True), adapted, lambda: adapt.baseline_c(sources, plain, features, booster),
        lambda: adapt.level0(sources, plain, features, best, booster), lambda: adapt.source_ensemble(sources, plain, features, scores, booster),
        lambda: adapt.oracle(known, plain, features, booster) if known is not None else None,
    ]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        level2, shifted, (level5, level55, level6), base, level0, many, known_best = pool.map(lambda step: step(), steps)
    out = [adapt.baseline_a(plain), base, level0, level2, shifted, level5, level55, level6, adapt.ensemble(level5, level2)]
    out += [r for r in (many, known_best) if r is not None]
    all_levels = out[0]
    for r in out[1:]:
        all_levels = all_levels.unionByName(r)
    rate = sources.agg(F.avg("label")).first()[0]
    judged = adapt.cut(all_levels.join(target.select("row_id", "label"), "row_id"))
    return evaluate.with_deltas(evaluate.level_metrics(judged, rate), "baseline_a")


def label_curve(rows: DataFrame, fractions: Sequence[float], seeds: Sequence[int], method: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """``fraction, seed, auc`` of a method on a labelled share of the rows, judged on the rest."""
    from lakeweave.operators.sampling import stratified_sample

    out = None
    for f in fractions:
        for s in seeds:
            known = adapt.cut(stratified_sample(rows, "label", "row_id", f, s))
            rest = rows.join(known.select("row_id"), "row_id", "left_anti")
            judged = method(known, rest.drop("label"), s).join(rest.select("row_id", "label"), "row_id")
            one = evaluate.auc(judged, "label", "p1").select(F.lit(f).alias("fraction"), F.lit(s).alias("seed"), "auc")
            out = one if out is None else out.unionByName(one)
    return out


def cold_start(rows: DataFrame, target: DataFrame, features: Sequence[str], lake_result: DataFrame, evidence: float, booster: adapt.Booster, batches: int = 10) -> DataFrame:
    """``week, n_labelled, alpha, auc`` as labels arrive: the lake's model blended with one of the labels so far."""
    arrived = adapt.cut(ranking.cumulative_batches(rows, [F.xxhash64("row_id"), "row_id"], batches))
    out = None
    for week in range(1, batches + 1):
        known = arrived.where(F.col("batch") <= week)
        n = known.count()
        alpha = n / (n + evidence) if n + evidence else 0.0
        own = adapt.result(adapt.fit(known.drop("weight"), features, booster)(target.drop("label")), "target_only")
        judged = adapt.blended(lake_result, own, alpha).join(target.select("row_id", "label"), "row_id")
        one = evaluate.auc(judged, "label", "p1").select(F.lit(week).alias("week"), F.lit(n).alias("n_labelled"), F.lit(round(alpha, 6)).alias("alpha"), "auc")
        out = one if out is None else out.unionByName(one)
    return out


def compared(metrics: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """One table over lakes (or sizes, or settings): the best level's AUC and the gap closed to the oracle."""
    best = evaluate.best_row(metrics, ["target", by], "level", "auc", ("baseline_a", "baseline_b", "baseline_c", "oracle"))
    ends = metrics.groupBy("target", by).agg(F.max(F.when(F.col("level") == "baseline_c", F.col("auc"))).alias("base"), F.max(F.when(F.col("level") == "oracle", F.col("auc"))).alias("oracle"))
    rows = best.join(ends, ["target", by]).withColumn("gap_closed", evaluate.gap_closed("best_value", "base", "oracle"))
    return evaluate.pivot(rows, "target", by, values, "gap_closed")


