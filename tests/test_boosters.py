from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from lakeweave.operators import adapt, boosters
from lakeweave.operators.boosters import Booster, grow
from lakeweave.operators.evaluate import auc

SCHEMA = "table_id string, row_id long, a double, b double, c double, label int, weight double"


def rows_of(n, seed=1, sources=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * (x[:, 0] * x[:, 1] + x[:, 2])))).astype(int)
    hole = rng.random((n, 3)) < 0.1
    return [(f"s{i % sources}", i, *[None if h else float(v) for v, h in zip(x[i], hole[i], strict=True)], int(y[i]), float(1 + i % 3)) for i in range(n)]


def test_as_good_as_distributed_trees(spark):
    df = spark.createDataFrame(rows_of(3000), SCHEMA)
    train, rest, names = df.where("row_id < 2000"), df.where("row_id >= 2000"), ["a", "b", "c"]
    booster = Booster(trees=30, rate=0.2)
    ours, theirs = (auc(f(train, names, booster)(rest), "label", "p1").first()[0] for f in (adapt.fit, adapt.distributed))
    assert ours > theirs - 0.01 and ours > 0.75


def test_one_stage_equals_single_fits(spark, monkeypatch):
    df, names, booster = spark.createDataFrame(rows_of(900), SCHEMA), ["a", "b", "c"], Booster(trees=8)
    df = df.unionByName(df.where("row_id = 0").withColumns({"table_id": F.lit(None).cast("string")}))  # a source of one class, without a name
    target = df.where("row_id % 7 = 0").select("row_id", "table_id", *names)
    many = adapt.fit_each(df, names, booster, ["table_id"], "weight")
    got = {(r.table_id, r.row_id): r.p1 for r in many.everywhere(target).collect()}
    assert len(got) == 4 * target.select("row_id").distinct().count()
    for name in ("s0", "s1", "s2", None):
        own = df.where(F.col("table_id").eqNullSafe(F.lit(name)))
        for r in adapt.fit(own.repartition(5), names, booster)(target).collect():  # the order of rows plays no part
            assert got[name, r.row_id] == r.p1
    home = {(r.table_id, r.row_id): r.p1 for r in many.at_home(target.where("table_id is not null")).collect()}
    assert home == {k: got[k] for k in home} and len(home) == 129
    monkeypatch.setattr(boosters, "MOST_MODELS", 2)  # several blocks
    assert {(r.table_id, r.row_id): r.p1 for r in many.everywhere(target).collect()} == got
    monkeypatch.setattr(boosters, "MOST_CELLS", 600)  # too large for a task: fitted by distributed trees
    large = adapt.fit_each(df, names, Booster(trees=2), ["table_id"])
    assert sorted(large.large) == [("s0",), ("s1",), ("s2",)] and large.everywhere(target).count() == len(got) + 4
    assert large.at_home(target.where("table_id is not null")).count() == target.where("table_id is not null").count()
    assert set(adapt.fit(df, names, Booster(trees=2))(target).toPandas()["p1"].between(0, 1)) == {True}


def test_no_rows_and_no_features(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    target = df.select("row_id", "a")
    assert adapt.fit_each(df.where("false"), ["a"], Booster(trees=2)).everywhere(target).collect() == []
    assert {r.p1 for r in adapt.fit(df.where("false"), ["a"])(target).collect()} == {0.5}
    assert {r.p1 for r in adapt.fit(df.where("label = 1"), ["a"])(target).collect()} == {1.0}
    flat = grow(np.ones((50, 2)), np.arange(50) % 2.0, np.ones(50), Booster(trees=3))
    assert np.allclose(flat.chances(np.ones((2, 2))), 0.5, atol=0.01) and np.isfinite(grow(np.full((9, 1), np.nan), np.arange(9) % 2.0, np.zeros(9), Booster(trees=2)).margin(np.ones((1, 1)))).all()


def expected(model, row, known):
    """The tree's value where only some features are known, by walking both ways at the others."""
    z, n = model.inputs(row[None])[0], len(row)

    def walk(t, node):
        inner = model.feature.shape[1]
        if node >= inner:
            return model.leaf[t, node - inner]
        f, cut = int(model.feature[t, node]), model.threshold[t, node]
        if np.isinf(cut) or f % n in known:
            return walk(t, 2 * node + 1 + (not np.isinf(cut) and z[f] > cut))
        whole = model.cover[t, node]
        return sum(model.cover[t, k] / whole * walk(t, k) for k in (2 * node + 1, 2 * node + 2)) if whole else 0.0

    return model.base + sum(walk(t, 0) for t in range(len(model.leaf)))


def test_contributions_against_all_subsets():
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows_of(250)])
    y = np.array([r[5] for r in rows_of(250)], float)
    model = grow(x, y, np.ones(250), Booster(trees=6, depth=3, rate=0.3))
    values, base = boosters.contributions(model, x)
    assert np.abs(values.sum(1) + base - model.margin(x)).max() < 1e-9
    for r in range(0, 250, 25):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (expected(model, x[r], {*s, i}) - expected(model, x[r], set(s))) for k in range(3) for s in combinations(others, k))
            assert abs(want - values[r, i]) < 1e-9


def test_shap_values_sum_to_the_margin(spark):
    df, names = spark.createDataFrame(rows_of(400), SCHEMA), ["a", "b", "c"]
    fitted = adapt.fit_each(df, names, Booster(trees=10))
    values = boosters.shap_values(fitted.models, df.drop("table_id"), names, ["table_id"])
    margin = values.groupBy("table_id", "row_id").agg(F.sum("contribution").alias("m"), F.count(F.lit(1)).alias("n"))
    both = margin.join(fitted.everywhere(df), ["table_id", "row_id"]).select("m", "n", "p1").toPandas()
    assert len(both) == 1200 and set(both["n"]) == {4} and np.abs(1 / (1 + np.exp(-both["m"])) - both["p1"]).max() < 1e-6
    places = adapt.importance(df, df, names, Booster(trees=10), ["table_id"]).collect()
    assert sorted((r.table_id, r.place) for r in places) == [(f"s{i}", k) for i in range(3) for k in (1, 2, 3)]
