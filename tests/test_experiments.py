"""Whole experiments over a small made-up lake, and the operators that they add."""

import random

import pytest
from pyspark.sql import functions as F

from lakeweave import __main__ as cli
from lakeweave.operators import adapt, binarize, ranking, repurpose
from lakeweave.plans import experiments, pipeline
from lakeweave.sources import lake, targets

FEATURES = ["age years", "weekly hours", "education level", "capital gain"]


def tables(n=3, rows=90):
    """Tables whose income follows the first two features; one with income turned round."""
    rng = random.Random(4)
    out = {}
    for t in range(n):
        values = []
        for _ in range(rows):
            x = [round(rng.gauss(0, 1), 1) for _ in FEATURES]
            y = float(round(4 * (x[0] + x[1]) + 20))
            values.append([*x, -y if t == n - 1 else y])
        out[f"t{t}"] = values
    return out


@pytest.fixture(scope="module")
def world(spark):
    names = [*FEATURES, "income"]
    cells = [(t, i, c, v) for t, rows in tables().items() for i, r in enumerate(rows) for c, v in zip(names, r, strict=True)]
    cells = adapt.cut(spark.createDataFrame(cells, lake.CELLS))
    goal = [(i, *r[:4], int(r[4] > 20)) for i, r in enumerate(tables(2, 240)["t0"])]
    target = adapt.cut(spark.createDataFrame(goal, "row_id long, " + ", ".join(f"`{c}` double" for c in FEATURES) + ", label int"))
    return cells, adapt.cut(lake.manifest_of(cells)), target


def test_experiment_sweep_and_manual_sources(spark, world, tmp_path, monkeypatch):
    cells, manifest, target = world
    e = experiments.Experiment("income", ("income",), k=4, booster=adapt.Booster(trees=3))
    seen = []

    def levels(sources, test, features, scores, *a, **k):
        seen.append((set(scores), sources.groupBy("table_id").agg(F.avg("label").alias("r")).collect(), test.count()))
        return spark.createDataFrame([("baseline_c", 0.5, 0.5, 0.5), ("level2", 0.7, 0.7, 0.6 + 0.01 * len(scores))], "level string, accuracy double, f1 double, auc double")

    monkeypatch.setattr(pipeline, "run_levels", levels)
    out = experiments.run(spark, manifest, cells, target, FEATURES, e)
    assert {r.table_id for r in out["lake"].where("kept").collect()} == seen[0][0] == {"t0", "t1", "t2"}
    manual = {"t1": "income", "t2": "income", "nowhere": "income"}
    plain = experiments.run(spark, manifest, cells, target, FEATURES, e, manual=manual)["sources"]
    turned = experiments.run(spark, manifest, cells, target, FEATURES, e, manual=manual, flipped=["t2"])["sources"]
    assert seen[1][0] == {"t1", "t2"}
    both = plain.select("table_id", "row_id", "label").join(turned.select("table_id", "row_id", F.col("label").alias("other")), ["table_id", "row_id"])
    assert both.where("label <> other").select("table_id").distinct().collect()[0][0] == "t2" and both.where("table_id = 't1' and label <> other").isEmpty()
    against = spark.createDataFrame([("Income ", "negative")], "col string, direction string")
    told = experiments.run(spark, manifest, cells, target, FEATURES, e, directions=against, manual=manual)["lake"]
    assert {r.direction for r in told.collect()} == {"NEGATIVE"}
    before = len(seen)
    goal = {"income": (target, FEATURES, e)}
    first = experiments.scalability(spark, f"file://{tmp_path}", manifest, cells, goal, [2, 3, 2])
    assert len(seen) == before + 2 and {(r.lake_size, r.level) for r in first.collect()} == {(n, x) for n in (2, 3) for x in ("baseline_c", "level2")}
    again = experiments.scalability(spark, f"file://{tmp_path}", manifest, cells, goal, [2, 3, 4])
    assert len(seen) == before + 3 and again.where("seconds >= 0").count() == 6
    best = experiments.best_levels(again, ["target", "lake_size"]).collect()
    assert {(r.lake_size, r.best) for r in best} == {(n, "level2") for n in (2, 3, 4)}
    none = experiments.run(spark, manifest, cells, target, FEATURES, e, manual={"nowhere": "income"})
    assert none["metrics"].isEmpty() and none["sources"].isEmpty()
    made = spark.createDataFrame([("t0", [1.0, 0.0]), ("t1", [0.0, 1.0])], "table_id string, vector array<double>")
    own = spark.createDataFrame([("t0", 0.9), ("t1", 0.5), ("t2", None)], "table_id string, self_auc double")
    got = experiments.filter_combinations(out, made, spark.createDataFrame([([1.0, 0.1],)], "vector array<double>"), own)
    kept = {c: {r.table_id for r in got.where(F.col("combination") == c).collect()} for c in ("none", "semantic", "self_auc", "semantic+posrate+self_auc")}
    assert kept == {"none": {"t0", "t1", "t2"}, "semantic": {"t0"}, "self_auc": {"t0", "t2"}, "semantic+posrate+self_auc": {"t0"}}


def test_labels_of_sources_are_those_they_were_judged_by(spark):
    """A threshold at the minimum: only values above it are 1, as in the gate on rates."""
    cells = [("t", i, "p", 0.0 if i < 12 else 1.0) for i in range(20)] + [("t", i, "x", float(i)) for i in range(20)]
    cells = spark.createDataFrame(cells, lake.CELLS)
    found = {
        "scores": spark.createDataFrame([("t", 0.8)], "table_id string, discovery_score double"),
        "vectors": spark.createDataFrame([("t", [1.0, 0.0])], "table_id string, vector array<double>"),
        "matches": spark.createDataFrame([("t", "x", "f", 1.0)], "table_id string, src_col string, tgt_col string, sim double"),
    }
    for direction, rate in (("POSITIVE", 0.4), ("NEGATIVE", 0.6)):
        found["lake"] = spark.createDataFrame([("t", "p", 0.0, direction, True)], "table_id string, proxy_col string, threshold double, direction string, kept boolean")
        got = pipeline.aligned_sources(cells, found, ["f"], experiments.Experiment("l", (), k=2)).agg(F.avg("label")).first()[0]
        assert got == pytest.approx(rate)
    proxies = spark.createDataFrame([("t", "p")], "table_id string, proxy_col string")
    many = spark.createDataFrame([("t", i, "p", float(i)) for i in range(101)], lake.CELLS)
    none = spark.createDataFrame([], "col string, direction string")
    assert repurpose.labelled_lake(many, proxies, none).first().reason == "high_cardinality"
    assert repurpose.labelled_lake(many.where("row_id < 100"), proxies, none).first().reason == ""


def test_answers_and_directions(spark):
    rows = [("a", v, 0.0) for v in ("t", "f")] + [("b", v, 0.0) for v in ("good", "high", "f")] + [("c", v, s) for v, s in (("rich", 0.9), ("poor", 0.1))]
    df = spark.createDataFrame(rows, "column string, value string, similarity double")
    got = {(r.column, r.value): r.label for r in binarize.categorical_binarize(df).collect()}
    assert got == {("a", "t"): 1, ("a", "f"): 0, ("c", "rich"): 1, ("c", "poor"): 0}
    turned = {(r.column, r.value): r.label for r in binarize.categorical_binarize(df.withColumn("direction", F.lit(" negative"))).collect()}
    assert turned == {k: 1 - v for k, v in got.items()}


def test_validation_and_routing(spark, monkeypatch):
    rows = [(f"s{t}", i, (i % 2) if t < 2 else (i // 2) % 2, float(i % 2), 1.0) for t in range(3) for i in range(40)]
    sources = spark.createDataFrame(rows, "table_id string, row_id long, label int, x double, weight double")
    check = lambda n: spark.createDataFrame([(i, i % 2, float(i % 2), 1.0) for i in range(n)], "row_id long, label int, x double, weight double")
    tiny = adapt.Booster(trees=2, depth=2)
    for n, want in ((9, set()), (16, {"s0", "s1"}), (25, {"s0", "s1"}), (40, {"s0", "s1"})):
        got = adapt.validated_sources(sources, check(n), ["x"], tiny, {"s0": 0.25, "s1": 1.0})
        assert {r.table_id: r.score for r in got.collect()} == {k: pytest.approx({"s0": 0.5, "s1": 1.0}[k]) for k in want}
    target = check(6).drop("label", "weight")
    assert adapt.routed(sources, check(40), target, ["x"], tiny)[0] == "lake_helps"
    reason, answer = adapt.routed(sources.where("table_id = 's2'"), check(40), target, ["x"], tiny)
    assert reason == "target_only" and answer.count() == 6 and {r.level for r in answer.collect()} == {"routed"}
    assert adapt.routed(sources, check(40).withColumn("label", F.lit(1)), target, ["x"], tiny)[0] == "insufficient_classes"
    assert {r.table_id for r in adapt.self_auc(sources, ["x"], tiny).where("self_auc > 0.9").collect()} == {"s0", "s1"}


def test_gates_and_means(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "table_id string, vector array<double>")
    near = ranking.semantic_gate(p, spark.createDataFrame([([1.0, 0.2],)], "vector array<double>"))
    assert {r.table_id for r in near.collect()} == {"a", "c"}
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 4.0, 3.0), ("k", None, 9.0), ("z", 1.0, 0.0)], "g string, v double, w double")
    assert {r.g: r.weighted_mean for r in ranking.weighted_mean(df, ["g"], "v", "w").collect()} == {"k": 3.25, "z": None}


def test_target_recipes(spark, tmp_path):
    def csv(name, header, rows):
        (tmp_path / name).write_text("\n".join([header, *rows]))
        return f"file://{tmp_path}/{name}"

    heart = csv("h.csv", "age,Class,chol", ["1,present,3", "2,absent,4", "3,Present,5"])
    assert [r.label for r in targets.load(spark, "heart", heart).orderBy("age").collect()] == [1, 0, 1]
    crime = csv("c.csv", "pop,ViolentCrimesPerPop", ["1,0.1", "2,0.4", "3,0.9"])
    assert [r.label for r in targets.load(spark, "crime", crime).orderBy("pop").collect()] == [0, 1, 1]
    with pytest.raises(ValueError):
        targets.load(spark, "turnover", heart.replace("h.csv", "c.csv")).collect()


def test_command_line(spark, tmp_path, monkeypatch):
    import pandas as pd

    for t, rows in tables(3, 60).items():
        pd.DataFrame(rows, columns=[*FEATURES, "income"]).to_csv(tmp_path / f"{t}.csv", index=False)
    goal = pd.DataFrame(tables(1, 80)["t0"], columns=[*FEATURES, "rich"])
    goal["rich"] = (goal["rich"] > 0).map({True: "yes", False: "no"})
    (tmp_path / "goal").mkdir()
    goal.to_parquet(tmp_path / "goal" / "goal.parquet")
    asked = {}
    monkeypatch.setattr(experiments, "run", lambda s, m, c, t, f, e, **k: asked.update(n=m.count(), f=sorted(f), rows=t.count(), k=e.k) or {x: spark.range(1) for x in ("lake", "scores", "matches", "metrics")})
    cli.main(["run", "--lake", f"file://{tmp_path}/t*.csv", "--target", f"file://{tmp_path}/goal/goal.parquet", "--label", "rich", "--concepts", "income", "--out", f"file://{tmp_path}/out", "--k", "3"])
    assert asked == {"n": 3, "f": sorted(FEATURES), "rows": 80, "k": 3} and (tmp_path / "out" / "metrics" / "_SUCCESS").exists()


def test_labels_by_share_and_by_week(spark, tmp_path, monkeypatch):
    """Every method over a share of labels, labels that arrive, and lakes compared; sources say the opposite of one feature."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}", i, float(x := rng.normal()), float(rng.normal()), int(x > 0), 1.0) for i in range(240)]
    sources = adapt.cut(spark.createDataFrame(rows, "table_id string, row_id long, x double, z double, label int, weight double"))
    target = adapt.cut(spark.createDataFrame([(i, float(x := rng.normal()), float(rng.normal()), int(x > 0)) for i in range(160)], "row_id long, x double, z double, label int"))
    tiny = adapt.Booster(trees=5, depth=2, rate=0.3)
    got = {r.method: (r.fraction, r.auc_mean, r.auc_std) for r in experiments.semi_supervised(sources, target, ["x", "z"], tiny, (0.25,), (1,)).collect()}
    assert set(got) == set(experiments.METHODS) and all(f == 0.25 and m > 0.9 and s == 0 for f, m, s in got.values())
    weeks = experiments.cold_start(sources, target, ["x", "z"], {"s0": 0.5, "s1": 0.1}, tiny, 3).orderBy("week").collect()
    assert [w.week for w in weeks] == [1, 2, 3] and weeks[-1].n_labelled > weeks[0].n_labelled and all(w.auc > 0.9 for w in weeks)
    assert [round(w.n_labelled / (w.n_labelled + 48), 6) for w in weeks] == [w.alpha for w in weeks]
    metrics = {"own": [("baseline_c", 0.6), ("level2", 0.7), ("oracle", 0.8)], "other": [("baseline_c", 0.6), ("level2", 0.75), ("oracle", 0.8)]}
    monkeypatch.setattr(experiments, "run", lambda s, m, c, *a: {"metrics": spark.createDataFrame(metrics[c], "level string, auc double")})
    e = experiments.Experiment("income", ("income",))
    row = experiments.compare_lakes(spark, f"file://{tmp_path}", {"own": (None, "own"), "other": (None, "other")}, target, ["x"], e).first()
    assert (row.target, round(row.own, 6), round(row.other, 6)) == ("income", 0.5, 0.75)


def test_appended_trees_start_from_the_lake(spark):
    """With labels that say the opposite, appended trees turn the lake's model; with none of them it stays."""
    rows = [("s", i, float(i % 50 - 25), int(i % 50 >= 25), 1.0) for i in range(200)]
    sources = spark.createDataFrame(rows, "table_id string, row_id long, x double, label int, weight double")
    turned = spark.createDataFrame([(i, float(i % 50 - 25), int(i % 50 < 25)) for i in range(150)], "row_id long, x double, label int")
    target = spark.createDataFrame([(i, float(i - 25)) for i in range(50)], "row_id long, x double")
    booster, extra = adapt.Booster(trees=10, rate=0.3), adapt.Booster(trees=60, rate=0.3)
    p = {r.row_id: r.p1 for r in adapt.fine_tuned(sources, turned, target, ["x"], booster, extra).collect()}
    assert p[0] > 0.8 and p[49] < 0.2
    plain = {r.row_id: r.p1 for r in adapt.fit(sources, ["x"], booster)(target).collect()}
    same = {r.row_id: r.p1 for r in adapt.fine_tuned(sources, turned, target, ["x"], booster, adapt.Booster(trees=0)).collect()}
    assert all(abs(plain[i] - same[i]) < 1e-6 for i in plain)
    assert plain[0] < 0.2 and plain[49] > 0.8
