"""Models that carry labels from lake tables to a target without labels, and with few."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.numeric import clip, correlation, entropy
from lakeweave.operators import boosters, neural, order
from lakeweave.operators.boosters import Booster
from lakeweave.operators.evaluate import auc
from lakeweave.operators.sampling import seeded


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round: a checkpoint in the shared folder, if the session names one."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint() if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, in columns: a fraction of the bytes of a checkpoint, and Spark knows the size, so that joins with few
    rows move nothing else. Without a shared folder it is ``cut``."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        return cut(df)
    path = f"{at.rstrip('/')}/stored-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The median of each feature over all rows; 0 where it has no value."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in features])).alias("_p")).select("_p.*")
    found = order.quantiles(values.where("v is not null and not isnan(v)"), ["c"], [0.5], "v").collect()
    return dict.fromkeys(features, 0.0) | {r["c"]: float(r["v"]) for r in found}


def prepared(df: DataFrame, features: Sequence[str], middle: dict[str, float]) -> DataFrame:
    """``_x``: features with the given medians for missing values, and an indicator for each."""
    plain = df.withColumns({f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(middle[c]))) for c in features} | {f"_n_{c}": F.col(c).isNull().cast("double") for c in features})
    names = [f"_f_{c}" for c in features] + [f"_n_{c}" for c in features]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(plain).drop(*names)


def common_features(source: DataFrame, target: DataFrame, features: Sequence[str], least: float = 0.3) -> list[str]:
    """Features that are filled in at least ``least`` of the rows on both sides."""
    shares = [df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features]).first() for df in (source, target)]
    return [c for c in features if all((s[c] or 0) >= least for s in shares)]


def distributed(train: DataFrame, features: Sequence[str], booster: Booster = Booster(), weight: str | None = "weight") -> Callable[[DataFrame], DataFrame]:
    """A model like that of ``fit``, by Spark's own trees: for more rows than one task should hold."""
    classes = [r[0] for r in train.select("label").where(F.col("label").isNotNull()).distinct().limit(2).collect()]
    if len(classes) < 2:
        only = float(classes[0]) if classes else 0.5
        return lambda df: df.withColumn("p1", F.lit(only))
    train = train.where(F.col("label").isNotNull())
    middle = medians(train, features)
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=booster.trees, maxDepth=booster.depth, stepSize=booster.rate, subsamplingRate=booster.rows, featureSubsetStrategy=booster.columns, seed=booster.seed)
    if weight and weight in train.columns:
        gbt = gbt.setWeightCol(weight)
    model = gbt.fit(prepared(train, features, middle))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(prepared(df, features, middle)).withColumn("p1", F.round(vector_to_array("probability")[1], 9))
        return out.drop("_x", "rawPrediction", "probability", "prediction")

    return predict


def fit(train: DataFrame, features: Sequence[str], booster: Booster = Booster(), weight: str | None = "weight") -> Callable[[DataFrame], DataFrame]:
    """A model of ``label``: a function that adds ``p1`` to rows. With a single class p1 is that class, without rows 0.5.

    Up to ``boosters.MOST_CELLS`` values it is fitted in one task, with more by ``distributed``.
    """
    names = list(features)
    held = train.where(F.col("label").isNotNull())
    n = held.count()
    if n * max(1, len(names)) > boosters.MOST_CELLS:
        return distributed(train, names, booster, weight)
    found = boosters.fit_many(held.withColumn("_model", F.lit(0)), names, booster, ["_model"], weight, bounded=True)[0].collect() if n else []
    if not found:
        return lambda df: df.withColumn("p1", F.lit(0.5))
    trees = boosters.Trees.unpack(found[0])

    @F.pandas_udf("double")
    def chances(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.chances(np.stack([c.to_numpy(float) for c in columns], 1)))

    return lambda df: df.withColumn("p1", F.round(chances(*[F.col(c).cast("double") for c in names]), 9))


@dataclass
class Fitted:
    """Models of many groups: those of one stage, stored, and functions for the groups that were too large for it."""

    models: DataFrame
    large: dict[tuple, Callable[[DataFrame], DataFrame]]
    features: list[str]
    by: list[str]

    def _keyed(self, df: DataFrame, key: tuple) -> DataFrame:
        return df.withColumns({c: F.lit(v).cast(self.models.schema[c].dataType) for c, v in zip(self.by, key, strict=True)})

    def everywhere(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each model, with ``by`` and ``p1``."""
        out = boosters.predict_many(self.models, rows, self.features, self.by)
        for key, predict in self.large.items():
            out = out.unionByName(self._keyed(predict(rows.drop(*self.by)), key).select(*out.columns))
        return out

    def at_home(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p1`` by the model of their own group."""
        out = boosters.predict_own(self.models, rows, self.features, self.by)
        for key, predict in self.large.items():
            own = rows
            for c, v in zip(self.by, key, strict=True):
                own = own.where(F.col(c).eqNullSafe(F.lit(v)))
            out = out.unionByName(predict(own).select(*out.columns))
        return out


def fit_each(train: DataFrame, features: Sequence[str], booster: Booster = Booster(), by: Sequence[str] = ("table_id",), weight: str | None = None, at_once: int = 4) -> Fitted:
    """A model of each value of ``by``, all in one stage; ``at_once`` of the groups that are too large for it at a time."""
    from concurrent.futures import ThreadPoolExecutor

    by, names = list(by), list(features)
    models, large = boosters.fit_many(train, names, booster, by, weight)
    models = cut(models)
    keys = [tuple(r) for r in large.collect()]

    def one(key: tuple) -> Callable[[DataFrame], DataFrame]:
        own = train
        for c, v in zip(by, key, strict=True):
            own = own.where(F.col(c).eqNullSafe(F.lit(v)))
        return distributed(own, names, booster, weight)

    with ThreadPoolExecutor(at_once) as pool:
        return Fitted(models, dict(zip(keys, pool.map(one, keys), strict=True)), names, by)


def confident_weights(rows: DataFrame, p: str = "p1", label: str = "label", weak: float = 0.1) -> DataFrame:
    """``weight`` x ``weak`` where the probability of a row's own label is below the mean of its class."""
    own = F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p))
    means = rows.groupBy(label).agg(F.avg(own).alias("_mean"))
    return rows.join(F.broadcast(means), label).withColumn("weight", F.when(own < F.col("_mean"), F.col("weight") * weak).otherwise(F.col("weight"))).drop("_mean")


def result(rows: DataFrame, level: str) -> DataFrame:
    """``row_id, level, p1, prediction, scored``."""
    return rows.select("row_id", F.lit(level).alias("level"), "p1", (F.col("p1") >= 0.5).cast("int").alias("prediction"), F.lit(True).alias("scored"))


def baseline_a(target: DataFrame) -> DataFrame:
    """Class 0 for every row, with p = 0.5."""
    return target.select("row_id", F.lit("baseline_a").alias("level"), F.lit(0.5).alias("p1"), F.lit(0).alias("prediction"), F.lit(True).alias("scored"))


def baseline_b(sources: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, runs: int = 5, tables: int = 20) -> DataFrame:
    """Mean of models of random tables (by hash) in equal weight; all runs are fitted in one stage."""
    names = sources.select("table_id").distinct()
    picked = None
    for i in range(runs):
        one = names.orderBy(seeded("table_id", i)).limit(tables).withColumn("_run", F.lit(i))
        picked = one if picked is None else picked.unionByName(one)
    p = fit_each(sources.join(F.broadcast(picked), "table_id"), features, booster, ["_run"]).everywhere(target.select("row_id", *features))
    return result(p.groupBy("row_id").agg(F.avg("p1").alias("p1")), "baseline_b")


def baseline_c(sources: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster) -> DataFrame:
    return result(fit(sources.drop("weight"), features, booster)(target), "baseline_c")


def level0(sources: DataFrame, target: DataFrame, features: Sequence[str], best: str, booster: Booster) -> DataFrame:
    """A model of the best source alone."""
    return result(fit(sources.where(F.col("table_id") == best).drop("weight"), features, booster)(target), "level0")


def label_shift_weights(sources: DataFrame, p: DataFrame, most: float = 5.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``sources`` with ``weight`` shifted so that the rates of the classes meet those that ``p1`` expects, mean 1.

    Both rates, the sources' share of 1 and the mean of ``p1``, are held in [low, high]; a class weighs the ratio of its
    rates, at most ``most`` and at least 1 / ``most``.
    """
    have = sources.agg(clip(F.avg("label"), low, high).alias("_s")).join(p.agg(clip(F.avg("p1"), low, high).alias("_t")))  # one row each
    ratio = F.when(F.col("label") == 1, F.col("_t") / F.col("_s")).otherwise((1 - F.col("_t")) / (1 - F.col("_s")))
    shifted = sources.join(F.broadcast(have)).withColumn("weight", F.col("weight") * clip(ratio, 1 / most, most)).drop("_s", "_t")
    mean = shifted.agg(F.avg("weight").alias("_mean"))
    return shifted.join(F.broadcast(mean)).withColumn("weight", F.try_divide(F.col("weight"), F.col("_mean"))).drop("_mean")


def self_trained(sources: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, rounds: Sequence[float] = (0.10, 0.20, 0.35, 0.50, 0.70), least_rows: int = 100, shift: bool = False, pseudo_weight: float = 0.5, patience: float = 0.01) -> DataFrame:
    """Rounds of pseudo-labels: each adds the surest rows of both classes to the sources and fits anew.

    Sources are denoised by the first model. A fifth of the source rows (by hash) is held out; a round that lowers its
    AUC by more than ``patience`` ends the training. With ``shift`` sources are weighed to the target's class rates.
    """
    level = "level2_lsc" if shift else "level2"
    n = target.count()
    held = F.pmod(F.xxhash64("table_id", "row_id"), F.lit(5)) == 0
    train, tried = cut(sources.where(~held)), cut(sources.where(held))
    model = fit(train, features, booster)
    if n < least_rows:
        return result(model(target), level)
    train = cut(confident_weights(model(train)).drop("p1"))
    seen = cut(model(target).select("row_id", "p1"))
    score = auc(cut(model(tried).select("label", "p1")), "label", "p1").first()[0] or 0.5
    for share in rounds:
        sure = seen.withColumn("label", (F.col("p1") >= 0.5).cast("int"))
        sure = sure.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.abs(F.col("p1") - 0.5).desc(), "row_id")))
        many = max(5, int(n * share / 2))
        pseudo = target.join(sure.where(F.col("_n") <= many).select("row_id", "label"), "row_id").withColumns({"weight": F.lit(pseudo_weight), "table_id": F.lit("target")})
        weighed = label_shift_weights(train, seen).select(*train.columns) if shift else train
        model = fit(cut(weighed.unionByName(pseudo.select(*weighed.columns))), features, booster)
        now = auc(cut(model(tried).select("label", "p1")), "label", "p1").first()[0] or 0.5
        if now < score - patience:
            break
        score = max(score, now)
        seen = cut(model(target).select("row_id", "p1"))
    return result(seen, level)


def ensemble(a: DataFrame, b: DataFrame, mode: str = "reference", floor: float = 0.3) -> DataFrame:
    """Two results weighed by entropy. ``reference``: the less sure weighs more, as the levels were tuned with;
    ``confidence``: the surer does. The second weighs ``floor`` at least."""
    h = lambda c: entropy(c) if mode == "reference" else F.lit(float(np.log(2))) - entropy(c)
    mean = lambda df, name: df.agg(F.avg(h("p1")).alias(name))
    w = mean(a, "_a").join(mean(b, "_b")).select(F.greatest(F.lit(floor), F.col("_b") / (F.col("_a") + F.col("_b") + 1e-12)).alias("_w"))
    both = a.select("row_id", F.col("p1").alias("_p")).join(b.select("row_id", F.col("p1").alias("_q")), "row_id").join(F.broadcast(w))
    return result(both.withColumn("p1", (1 - F.col("_w")) * F.col("_p") + F.col("_w") * F.col("_q")), "ensemble")


def source_ensemble(sources: DataFrame, target: DataFrame, features: Sequence[str], scores: dict[str, float], booster: Booster, least: int = 3) -> DataFrame | None:
    """The weighted median of one model a source; None with fewer than ``least`` sources."""
    from lakeweave.operators.ranking import weighted_median

    if len(scores) < least:
        return None
    spark = sources.sparkSession
    weights = spark.createDataFrame([(k, float(v)) for k, v in scores.items()], f"table_id {sources.schema['table_id'].dataType.simpleString()}, w double")
    fitted = fit_each(sources.join(weights.select("table_id"), "table_id", "left_semi"), features, booster)
    out = fitted.everywhere(target.select("row_id", *features)).select("table_id", "row_id", "p1").join(weights, "table_id")
    return result(weighted_median(out, ["row_id"], "p1", "w").withColumnRenamed("weighted_median", "p1"), "source_ensemble")


def committee(sources: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, members: int = 5, least_votes: int = 4) -> DataFrame:
    """Models of resampled sources; only rows on which ``least_votes`` agree teach a last model."""
    drawn = F.filter(F.array(*[F.when(F.pmod(F.xxhash64("table_id", "row_id", F.lit(i)), F.lit(10)) < 7, F.lit(i)) for i in range(members)]), lambda x: x.isNotNull())
    p = fit_each(sources.withColumn("_member", F.explode(drawn)), features, booster, ["_member"], "weight").everywhere(target.select("row_id", *features))
    out = p.select("row_id", (F.col("p1") >= 0.5).cast("int").alias("v"))
    votes = out.groupBy("row_id").agg(F.sum("v").alias("v")).where((F.col("v") >= least_votes) | (F.col("v") <= members - least_votes))
    agreed = target.join(votes.select("row_id", (F.col("v") * 2 > members).cast("int").alias("label")), "row_id").withColumns({"weight": F.lit(0.5), "table_id": F.lit("target")})
    return result(fit(cut(sources.unionByName(agreed.select(*sources.columns))), features, booster)(target), "qbc")


def oracle(labelled: DataFrame, test: DataFrame, features: Sequence[str], booster: Booster) -> DataFrame:
    """What labels of the target itself would give."""
    return result(fit(labelled.dropna(subset=["label"]).drop("weight"), features, booster)(test), "oracle")


def source_predictions(sources: DataFrame, rows: DataFrame, features: Sequence[str], booster: Booster) -> DataFrame:
    """``table_id, row_id, p1``: what the model of each source says of each row, written once."""
    return cut(fit_each(sources, features, booster).everywhere(rows.select("row_id", *features)).select("table_id", "row_id", "p1"))


def self_auc(sources: DataFrame, features: Sequence[str], booster: Booster = Booster(trees=50, depth=3)) -> DataFrame:
    """``table_id, self_auc``: how well each source's own features tell its labels, in sample."""
    seen = fit_each(sources, features, booster).at_home(sources.select("table_id", "label", *features))
    return auc(seen, "label", "p1", ["table_id"]).withColumnRenamed("auc", "self_auc")


def calibrated(p: DataFrame, labelled: DataFrame, least: int = 5) -> DataFrame:
    """Probabilities made monotone in the labels of some rows (``p1, label``); unchanged with too few or one class."""
    stats = labelled.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    if stats["n"] < least or stats["k"] < 2:
        return p
    model = IsotonicRegression(featuresCol="p1", labelCol="label", predictionCol="_p").fit(labelled.select("p1", F.col("label").cast("double").alias("label")))
    return model.transform(p).withColumn("p1", F.col("_p")).drop("_p")


def validated_sources(sources: DataFrame, validation: DataFrame, features: Sequence[str], booster: Booster, scores: dict[str, float] | None = None, least: float = 0.52, replicas: int = 20, most_spread: float = 0.15) -> DataFrame:
    """``table_id, auc, score`` of the sources whose model tells the labels of some target rows; score is auc x sqrt(discovery score).

    With fewer than 10 such rows none is validated; with fewer than 20, 0.60 is needed; with fewer than 30, the AUC is the
    median over ``replicas`` resamples, and a source whose AUCs spread by more than ``most_spread`` is left out.
    """
    from lakeweave.operators.sampling import bootstrap

    n = validation.count()
    empty = sources.sparkSession.createDataFrame([], f"table_id {sources.schema['table_id'].dataType.simpleString()}, auc double, score double")
    if n < 10:
        return empty

    seen = source_predictions(sources, validation, features, booster).join(validation.select("row_id", "label"), "row_id")
    if n >= 30:
        judged = auc(seen, "label", "p1", ["table_id"]).withColumn("spread", F.lit(0.0))
    else:
        times = bootstrap(validation.select("row_id"), "row_id", replicas)
        drawn = seen.join(F.broadcast(times), "row_id").withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("times"))))
        each = auc(drawn, "label", "p1", ["table_id", "replica"])
        judged = each.groupBy("table_id").agg(F.percentile("auc", 0.5).alias("auc"), F.coalesce(F.stddev_pop("auc"), F.lit(1.0)).alias("spread"))
    known = F.create_map(*[F.lit(x) for kv in (scores or {}).items() for x in kv]) if scores else None
    found = F.lit(1.0) if known is None else F.greatest(F.coalesce(known[F.col("table_id")], F.lit(1e-3)), F.lit(1e-6))
    needed = max(least, 0.60) if n < 20 else least
    return judged.where((F.col("auc") >= needed) & (F.col("spread") <= most_spread)).select("table_id", "auc", F.round(F.col("auc") * F.sqrt(found), 6).alias("score"))


def pooled_with_validation(sources: DataFrame, validation: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, boost: float = 3.0) -> DataFrame:
    """Validated sources and the labelled target rows, which weigh ``boost`` times the heaviest source row."""
    heaviest = sources.agg(F.max("weight").alias("_w"))
    mine = validation.withColumn("table_id", F.lit("target")).join(F.broadcast(heaviest)).withColumn("weight", boost * F.coalesce("_w", F.lit(1.0))).drop("_w")
    return result(fit(cut(sources.unionByName(mine.select(*sources.columns))), features, booster)(target), "vla")


def fine_tuned(sources: DataFrame, validation: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, extra: Booster = Booster(trees=50)) -> DataFrame:
    """The lake's model with ``extra`` trees appended to it that are grown on labelled target rows. With more of these than
    a task holds (``boosters.MOST_CELLS`` values), a second model sees the first one's prediction as a feature instead."""
    first = fit(sources, features, booster)
    odds = F.log(F.greatest("p1", F.lit(1e-9)) / F.greatest(1 - F.col("p1"), F.lit(1e-9)))
    if validation.count() * len(features) > boosters.MOST_CELLS:
        stage = lambda df: first(df).withColumnRenamed("p1", "lake_p")
        return result(fit(stage(validation).drop("weight"), [*features, "lake_p"], extra)(stage(target)), "vla_finetune")
    known = first(validation).withColumns({"_start": odds, "_model": F.lit(0)})
    more = cut(boosters.fit_many(known, features, extra, ["_model"], None, bounded=True, start="_start")[0])
    said = first(target.select("row_id", *features)).withColumn("_start", odds).drop("p1")
    both = boosters.predict_many(more, said, features, ["_model"])
    added = F.log(F.greatest("p1", F.lit(1e-9)) / F.greatest(1 - F.col("p1"), F.lit(1e-9)))
    return result(both.withColumn("p1", F.round(1 / (1 + F.exp(-(F.col("_start") + added))), 9)), "vla_finetune")


def blend_weight(n_labelled: Column | int, evidence: Column | float) -> Column:
    """n / (n + evidence), where the evidence is the sum of score x min(rows, 1000) over the sources."""
    n = n_labelled if isinstance(n_labelled, Column) else F.lit(n_labelled)
    e = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.coalesce(F.try_divide(n.cast("double"), n + e), F.lit(0.0))


def blended(lake: DataFrame, own: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) lake + alpha own."""
    both = lake.select("row_id", F.col("p1").alias("_p")).join(own.select("row_id", F.col("p1").alias("_q")), "row_id")
    return result(both.withColumn("p1", (1 - F.lit(alpha)) * F.col("_p") + F.lit(alpha) * F.col("_q")), "blended")


def stacked(predictions: DataFrame, labelled: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, top: int = 5) -> DataFrame:
    """A model over the features and the ``top`` source predictions that correlate most with the labels.

    ``predictions``: table_id, row_id, p1 for labelled and target rows.
    """
    names = predictions.join(labelled.select("row_id", "label"), "row_id").groupBy("table_id").agg(F.abs(correlation("p1", "label")).alias("r"))
    chosen = [r["table_id"] for r in names.orderBy(F.col("r").desc_nulls_last(), "table_id").limit(top).collect()]
    wide = predictions.groupBy("row_id").pivot("table_id", chosen).agg(F.first("p1"))
    wide = wide.select("row_id", *[F.col(f"`{c}`").alias(f"from_{i}") for i, c in enumerate(chosen)])
    used = [*features, *[f"from_{i}" for i in range(len(chosen))]]
    wide = cut(wide)
    return result(fit(labelled.join(wide, "row_id").drop("weight"), used, booster)(target.join(wide, "row_id")), "stacking")


def use_lake(validated: DataFrame, least_sources: int = 2, least_score: float = 0.08) -> bool:
    """Whether validated sources are good enough to be used: enough of them, with a mean score above ``least_score``."""
    row = validated.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s")).first()
    return row["n"] >= least_sources and row["s"] > least_score


def routed(sources: DataFrame, validation: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, scores: dict[str, float] | None = None) -> tuple[str, DataFrame]:
    """(reason, result): the lake's model where validated sources help, else one of the labelled target rows alone.

    With labels of one class nothing can be judged, and the lake's model is taken (``insufficient_classes``).
    """
    classes = validation.select("label").distinct().count()
    good = cut(validated_sources(sources, validation, features, booster, scores))
    if classes < 2 or use_lake(good):
        some = sources.join(F.broadcast(good.select("table_id")), "table_id", "left_semi") if classes >= 2 else sources
        return ("lake_helps" if classes >= 2 else "insufficient_classes"), pooled_with_validation(some, validation, target, features, booster).withColumn("level", F.lit("routed"))
    return "target_only", result(fit(validation.drop("weight"), features, booster)(target), "routed")


def sampled(df: DataFrame, features: Sequence[str], most: int, extra: Sequence[str] = ()) -> pd.DataFrame:
    """``most`` rows by a hash of row_id: the documented bound on what is gathered for the models in NumPy."""
    return df.orderBy(F.xxhash64("row_id")).limit(most).select("row_id", *features, *extra).toPandas()


def spread_labels(labelled: DataFrame, target: DataFrame, features: Sequence[str], most: int = 1000, gamma: float = 0.25, keep: float = 0.8) -> DataFrame:
    """``row_id, p1`` for every target row by label spreading, in standard units of all rows, means for missing values.

    The graph holds ``most`` labelled and ``most`` target rows, the documented bound on what is gathered; all target
    rows are then scored against it in blocks, on the executors.
    """
    names = list(features)
    clean = lambda df: df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names})
    labelled, target = clean(labelled), clean(target)
    stats = labelled.select(*names).unionByName(target.select(*names)).agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = (np.array([stats[f"{k}{i}"] or 0.0 for i in range(len(names))]) for k in "ms")
    scale = np.where(scale > 0, scale, 1.0)
    standard = lambda x: (np.where(np.isnan(x), mean, x) - mean) / scale
    s, b = sampled(labelled, names, most, ("label",)), sampled(target, names, most)
    x = standard(np.vstack([s[names].to_numpy(float), b[names].to_numpy(float)]))
    f = neural.spread(x, np.r_[s["label"].to_numpy(int), np.full(len(b), -1)], gamma, keep)

    @F.pandas_udf("double")
    def p(*columns: pd.Series) -> pd.Series:
        return pd.Series(neural.spread_to(x, f, standard(np.stack([c.to_numpy(float) for c in columns], 1)), gamma))

    return target.select("row_id", F.round(p(*[F.col(c) for c in names]), 6).alias("p1"))


def kernel_weights(sources: DataFrame, target: DataFrame, features: Sequence[str], most: int = 5000) -> DataFrame:
    """``row_id, weight`` of every source row by kernel mean matching: fitted for ``most`` rows (by hash), 1 for the rest.

    The bound is the one on the square kernel matrix. The mean over the target is taken over all its rows, by task.
    """
    names = list(features)
    s = sampled(sources, names, most)
    x = s[names].to_numpy(float)
    gamma = neural.kernel_gamma(x)

    def sums(batches):
        total, n = np.zeros(len(x)), 0
        for pdf in batches:
            total, n = total + neural.kernel_sums(x, pdf.to_numpy(float), gamma), n + len(pdf)
        yield pd.DataFrame({"i": np.arange(len(x)), "total": total, "n": n})

    parts = target.select(*[F.col(c).cast("double") for c in names]).mapInPandas(sums, "i long, total double, n long")
    kappa = parts.groupBy("i").agg((F.sum("total") / F.sum("n")).alias("mean")).toPandas().sort_values("i")["mean"].to_numpy(float) * len(x)
    w = neural.kernel_mean_fit(x, gamma, kappa)
    fitted = sources.sparkSession.createDataFrame([(r, round(float(v), 6)) for r, v in zip(s["row_id"].tolist(), w, strict=True)], f"row_id {sources.schema['row_id'].dataType.simpleString()}, weight double")
    return sources.select("row_id").join(F.broadcast(fitted), "row_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def _medians_of_costs(blocks, goals: dict[int, np.ndarray], bins: int = 4096, passes: int = 3) -> dict[int, float]:
    """Of each class, the median squared distance of its source rows to its goals, by narrowing histograms."""
    sizes = blocks.map(lambda b: {b[0]: (len(b[1]), float((b[1] ** 2).sum(1).max()))}).reduce(lambda p, q: {c: ((p[c][0] + q[c][0], max(p[c][1], q[c][1])) if c in p and c in q else p.get(c, q.get(c))) for c in p | q})
    at = {}
    for c, y in goals.items():
        if c in sizes:
            n = sizes[c][0] * len(y)
            high = (np.sqrt(sizes[c][1]) + np.sqrt((y**2).sum(1).max())) ** 2 * (1 + 1e-9) + 1e-12
            at |= {(c, k): (0.0, high) for k in {(n - 1) // 2, n // 2}}
    for _ in range(passes):

        def counts(b, at=dict(at)):
            d = neural.squared_distances(b[1], goals[b[0]]).ravel() if b[0] in goals else np.empty(0)
            out = {}
            for (c, k), (low, high) in at.items():
                if c == b[0]:
                    own = d[(d >= low) & (d <= high)]
                    out[c, k] = np.r_[(d < low).sum(), np.bincount(np.minimum(((own - low) / (high - low) * bins).astype(int), bins - 1), minlength=bins)]
            return out

        found = blocks.map(counts).reduce(lambda p, q: {k: p.get(k, 0) + q.get(k, 0) for k in p | q})
        for (c, k), (low, high) in at.items():
            i = min(int(np.searchsorted(np.cumsum(found[c, k][1:]), k - found[c, k][0], side="right")), bins - 1)
            at[c, k] = (low + (high - low) * i / bins, low + (high - low) * (i + 1) / bins)
    return {c: float(np.mean([(low + high) / 2 for (d, _), (low, high) in at.items() if d == c])) for c, _ in at}


def transported(sources: DataFrame, target: DataFrame, features: Sequence[str], most: int = 1000, most_rows: int = 5000, strength: float = 0.1, steps: int = 200, close: float = 1e-9, block: int = 500) -> DataFrame:
    """``row_id, moved``: how far each source row moves to the target's rows of its class (see ``neural.transported``).

    All source rows take part: they stay on the executors in blocks and only sums per goal meet, step by step, until the
    plan's sums are met to ``close``. The target's side is ``most`` rows a class (by hash). Pseudo-labels of all target
    rows come from a logistic model of ``most_rows`` source rows. A class that the target lacks stays where it is.
    """
    from lakeweave.operators.transfer import chances, logistic

    names = list(features)
    spark = sources.sparkSession
    s = sampled(sources, names, most_rows, ("label",))
    w = logistic(s[names].to_numpy(float), s["label"].to_numpy(int))

    @F.pandas_udf("int")
    def guess(*columns: pd.Series) -> pd.Series:
        return pd.Series((chances(w, np.stack([c.to_numpy(float) for c in columns], 1)) >= 0.5).astype("int32"))

    guessed = target.withColumn("_c", guess(*[F.col(c).cast("double") for c in names]))
    goals = {c: sampled(guessed.where(F.col("_c") == c), names, most)[names].to_numpy(float) for c in (0, 1)}
    goals = {c: y for c, y in goals.items() if len(y)}

    def in_blocks(rows):
        held: dict[int, list] = {}
        for r in rows:
            own = held.setdefault(r[0], [])
            own.append(r[1])
            if len(own) == block:
                yield r[0], np.array(held.pop(r[0]))
        yield from ((c, np.array(v)) for c, v in held.items())

    rows = sources.select(F.col("label").cast("int"), F.array(*[F.col(c).cast("double") for c in names])).rdd
    blocks = rows.coalesce(min(rows.getNumPartitions(), spark.sparkContext.defaultParallelism)).mapPartitions(in_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    scale = {c: strength * max(1e-9, m) for c, m in _medians_of_costs(blocks, goals).items()}
    g = {c: np.zeros(len(goals[c])) for c in scale}
    shared = spark.sparkContext.broadcast(goals)
    for _ in range(steps if g else 0):

        def met(b, g=dict(g)):
            return {b[0]: (neural.soft_plan(b[1], shared.value[b[0]], g[b[0]], scale[b[0]]).sum(0), len(b[1]))} if b[0] in g else {}

        sums = blocks.map(met).reduce(lambda p, q: {c: ((p[c][0] + q[c][0], p[c][1] + q[c][1]) if c in p and c in q else p.get(c, q.get(c))) for c in p | q})
        share = {c: np.maximum(v / n * len(v), 1e-300) for c, (v, n) in sums.items()}
        g = {c: g[c] - np.log(share[c]) for c in g}
        if max(np.abs(x - 1).max() for x in share.values()) < close:
            break
    blocks.unpersist()

    @F.pandas_udf("double")
    def moved(label: pd.Series, *columns: pd.Series) -> pd.Series:
        x, c = np.stack([v.to_numpy(float) for v in columns], 1), label.to_numpy(int)
        out = np.zeros(len(x))
        for k in g:
            at = np.flatnonzero(c == k)
            for i in range(0, len(at), block):
                some = at[i : i + block]
                out[some] = np.linalg.norm(neural.soft_plan(x[some], goals[k], g[k], scale[k]) @ goals[k] - x[some], axis=1)
        return pd.Series(out)

    return sources.select("row_id", F.round(moved(F.col("label").cast("int"), *[F.col(c).cast("double") for c in names]), 4).alias("moved"))


def with_net(net: neural.Net, df: DataFrame, features: Sequence[str], level: str) -> DataFrame:
    """Predictions of a net over all rows, in batches."""
    names = list(features)

    @F.pandas_udf("double")
    def p(*columns: pd.Series) -> pd.Series:
        return pd.Series(net.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

    return result(df.withColumn("p1", p(*[F.col(c).cast("double") for c in names])), level)


def matrices(sources: DataFrame, target: DataFrame, features: Sequence[str], most: int = 5000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, label, weight, target) from samples, medians for missing values, in standard units of the source."""
    s, t = sampled(sources, features, most, ("label", "weight")), sampled(target, features, most)
    a, b = s[list(features)].to_numpy(float), t[list(features)].to_numpy(float)
    middle = np.nan_to_num(np.nanmedian(a, 0))
    a, b = (np.where(np.isnan(x), middle, x) for x in (a, b))
    return a, s["label"].to_numpy(int), s["weight"].to_numpy(float), b


def self_trained_with_labels(sources: DataFrame, validation: DataFrame, target: DataFrame, features: Sequence[str], booster: Booster, rounds: Sequence[float] = (0.3, 0.4, 0.5), boost: float = 3.0) -> DataFrame:
    """Rounds of pseudo-labels on top of validated sources and labelled target rows, which weigh ``boost`` times as much."""
    n = target.count()
    heaviest = sources.agg(F.max("weight").alias("_w"))
    mine = validation.withColumn("table_id", F.lit("target")).join(F.broadcast(heaviest)).withColumn("weight", boost * F.coalesce("_w", F.lit(1.0))).drop("_w")
    train = cut(sources.unionByName(mine.select(*sources.columns)))
    seen = cut(fit(train, features, booster)(target).select("row_id", "p1"))
    for share in rounds:
        sure = seen.withColumn("label", (F.col("p1") >= 0.5).cast("int"))
        sure = sure.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.abs(F.col("p1") - 0.5).desc(), "row_id")))
        pseudo = target.join(sure.where(F.col("_n") <= max(5, int(n * share / 2))).select("row_id", "label"), "row_id")
        pseudo = pseudo.withColumns({"weight": F.lit(0.5), "table_id": F.lit("target")})
        seen = cut(fit(cut(train.unionByName(pseudo.select(*train.columns))), features, booster)(target).select("row_id", "p1"))
    return result(seen, "vla_self_train")


def importance(train: DataFrame, rows: DataFrame, features: Sequence[str], booster: Booster = Booster(), by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, importance, place``: the mean absolute SHAP value over all ``rows`` of each feature in the model of
    ``train`` (or of each of its groups ``by``). Groups with more than ``boosters.MOST_CELLS`` values have no such model."""
    keys = list(by) or ["_model"]
    train = train if by else train.withColumn("_model", F.lit(0))
    models = cut(boosters.fit_many(train, features, booster, keys)[0])
    return boosters.mean_contributions(boosters.shap_values(models, rows, features, keys), keys).drop("_model")
