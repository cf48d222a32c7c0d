"""Queries and operators cover all rows and dimensions, beyond the sizes of their samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import adapt, neural, ranking, transfer
from lakeweave.plans import QUERIES, model_queries, pipeline
from lakeweave.sources import lake

N = 5200


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Embeddings whose labels show in the last dimensions only, with more rows than any sample holds."""
    rng = np.random.default_rng(0)
    label = rng.integers(0, 10, N)
    v = rng.normal(0, 1, (N, 64))
    v[:, 32:] += np.where(label < 5, 1.0, -1.0)[:, None]
    at = tmp_path_factory.mktemp("whole")
    rows = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{at}/embeddings.parquet")
    return f"file://{at}", label


def test_label_propagation_scores_all_targets(spark, folder):
    at, label = folder
    got = QUERIES["label_propagation"](spark, at).toPandas()
    assert sorted(got["row_id"]) == list(range(1, N, 2))
    assert transfer.rank_auc((label[got["row_id"]] < 5).astype(int), got["p1"].to_numpy()) > 0.95


def test_kernel_mean_matching_weighs_all_sources(spark, folder):
    at, _ = folder
    got = QUERIES["kernel_mean_matching"](spark, at).toPandas()
    assert sorted(got["row_id"]) == list(range(0, N, 2)) and got["weight"].between(0, 10).all()


def test_kernel_weights_beyond_the_sample_are_one(spark):
    rng = np.random.default_rng(1)
    x, t = rng.normal(0, 1, (300, 2)), rng.normal(1, 1, (200, 2))
    frame = lambda v: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "row_id long, a double, b double")
    got = adapt.kernel_weights(frame(x), frame(t), ["a", "b"], most=100).toPandas()
    assert len(got) == 300 and 200 <= (got["weight"] == 1).sum() < 300
    all_rows = adapt.kernel_weights(frame(x), frame(t), ["a", "b"], most=500).toPandas().set_index("row_id")["weight"]
    order = adapt.sampled(frame(x), ["a", "b"], 500)["row_id"].to_numpy()
    assert np.allclose(all_rows[order], neural.kernel_mean_weights(x[order], t), atol=1e-5)


def test_transport_moves_all_sources(spark, folder):
    at, _ = folder
    got = QUERIES["sinkhorn_transport"](spark, at).toPandas()
    assert sorted(got["row_id"]) == list(range(0, N, 2)) and (got["moved"] > 0).all()


def test_transport_in_blocks_is_the_transport(spark):
    rng = np.random.default_rng(2)
    y, z = np.arange(90) % 2, np.arange(70) % 2
    x, t = rng.normal(0, 1, (90, 2)) + 6 * y[:, None], rng.normal(0.5, 1, (70, 2)) + 6 * z[:, None]
    s = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, label int")
    b = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "row_id long, a double, b double")
    got = adapt.transported(s.repartition(3), b, ["a", "b"], block=7).toPandas().set_index("row_id")["moved"].sort_index()
    guess = (transfer.chances(transfer.logistic(x, y), t) >= 0.5).astype(int)
    assert np.allclose(got, np.linalg.norm(neural.transported(x, y, t, guess) - x, axis=1), atol=1e-3)


def test_sources_are_told_apart_by_distributions(spark):
    """Two sources of the same names: the one with the target's distributions scores higher; rates count."""
    rng = random.Random(7)
    features = ["age years", "weekly hours", "education level", "capital gain"]
    cells, manifest, rows = [], [], []
    for name, far in (("near", 0.0), ("away", 50.0)):
        for i in range(120):
            x = [rng.gauss(0, 1) for _ in features]
            y = round(x[0] + x[1] + rng.gauss(0, 0.3) + (6 if x[0] > 0 else 0), 1)  # 100 values at most
            cells += [(name, i, c, float(v) + far) for c, v in zip(features, x, strict=True)] + [(name, i, "income", y)]
            rows += [(i, *x, int(y > 3))] if not far else []
        manifest.append((name, 120, 5, [*features, "income"], None))
    cells = spark.createDataFrame(cells, lake.CELLS)
    manifest = spark.createDataFrame(manifest, "table_id string, n_rows long, n_cols long, columns array<string>, path string")
    target = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"`{c}` double" for c in features) + ", label int")
    e = pipeline.Experiment("income", ("income", "salary"), k=1, booster=adapt.Booster(trees=5))
    scores = lambda **x: {r.table_id: r.discovery_score for r in pipeline.discover(spark, manifest, cells, target, features, e, **x)["scores"].collect()}
    own = scores()
    assert own["near"] > own["away"] + 0.1
    assert scores(target_rate=1.0)["near"] < own["near"]
    found = pipeline.discover(spark, manifest, cells, target, features, e)
    assert {r.table_id for r in pipeline.aligned_sources(cells, found, features, e).select("table_id").distinct().collect()} == {"near"}


def test_tables_without_shared_names_are_scored_by_ks(spark):
    cells = spark.createDataFrame([("t", i, c, float(i)) for i in range(50) for c in ("p", "q")] + [("u", i, c, i + 900.0) for i in range(50) for c in ("p", "q")], lake.CELLS)
    target = spark.createDataFrame([(i, float(i), float(i)) for i in range(50)], "row_id long, a double, b double")
    assert {r.table_id: r.dist_sim for r in pipeline.distribution_scores(cells, target, ["a", "b"]).collect()} == {"t": 1.0, "u": 0.0}


def test_like_proxies_do_not_crowd_the_places(spark):
    cells = spark.createDataFrame([(t, i, c, float(i)) for t in "abc" for i in range(20) for c in ("x", "y")], lake.CELLS)
    found = {
        "scores": spark.createDataFrame([("a", 0.8), ("b", 0.78), ("c", 0.6)], "table_id string, discovery_score double"),
        "vectors": spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "table_id string, vector array<double>"),
        "matches": spark.createDataFrame([(t, "x", "f", 1.0) for t in "abc"], "table_id string, src_col string, tgt_col string, sim double"),
        "lake": spark.createDataFrame([(t, "y", 10.0, "POSITIVE", True) for t in "abc"], "table_id string, proxy_col string, threshold double, direction string, kept boolean"),
    }
    rows = pipeline.aligned_sources(cells, found, ["f"], pipeline.Experiment("l", (), k=2))
    assert {r.table_id for r in rows.select("table_id").distinct().collect()} == {"a", "c"}


def test_diverse_selection_looks_at_every_candidate(spark):
    rows = [(i, 1.0 - i * 1e-5, [1.0, 0.0]) for i in range(1500)] + [(1500, 0.9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, s double, v array<double>")
    assert ranking.mmr(df, "id", "s", "v", 3) == [0, 1500, 1]


def test_tree_queries_take_defaults_and_all_sources(spark, monkeypatch):
    """What the queries hand to the operators, without fitting: stubs answer with the target's rows."""
    sources = spark.createDataFrame([(i, f"s{i % 7}", i % 2, 0.0, 1.0) for i in range(70)], "row_id long, table_id string, label int, x double, weight double")
    target = spark.createDataFrame([(i, i % 2, 0.0) for i in range(20)], "row_id long, label int, x double")
    monkeypatch.setattr(model_queries, "adaptation_tables", lambda t: (sources, target, ["x"]))
    seen = []
    answer = lambda df: adapt.result(df.withColumn("p1", F.lit(0.5)), "stub")

    def stub(name, at):
        monkeypatch.setattr(adapt, name, lambda *a, **k: (seen.append((name, a, k)), answer(a[at]))[1])

    for name, at in (("self_trained", 1), ("baseline_b", 1), ("baseline_c", 1), ("stacked", 2)):
        stub(name, at)
    fitted = []

    def predictions(train, rows, features, booster):  # a model of each source, in one stage
        fitted.extend((r[0], booster) for r in train.select("table_id").distinct().collect())
        return train.select("table_id").distinct().join(rows.select("row_id")).withColumn("p1", F.lit(0.5))

    monkeypatch.setattr(adapt, "source_predictions", predictions)
    for name in ("gbt_selftrain", "gbt_label_shift", "baselines", "stacking"):
        QUERIES[name](spark, "")
    assert [k for n, _, k in seen] == [{}, {"shift": True}, {}, {}, {}] and {b for _, a, _ in seen for b in a if isinstance(b, adapt.Booster)} == {adapt.Booster()}
    assert sorted(fitted, key=lambda x: x[0]) == [(f"s{i}", adapt.Booster()) for i in range(7)]
    levels = []
    monkeypatch.setattr(pipeline, "run_levels", lambda s, t, f, scores, *a: levels.append(scores))
    QUERIES["adaptation_pipeline"](spark, "")
    assert set(levels[0]) == {f"s{i}" for i in range(7)}


def test_levels_have_label_shift_and_the_default_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 240), rng.integers(0, 2, 240)
    rows = [(i, f"s{i % 2}", int(c), float(v + c), 1.0) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, table_id string, label int, x double, weight double")
    seen = []
    monkeypatch.setattr(adapt, "self_trained", lambda s, t, f, b, **k: (seen.append(k), adapt.result(t.withColumn("p1", F.lit(0.5)), "level2_lsc" if k.get("shift") else "level2"))[1])
    got = pipeline.run_levels(df.where("row_id < 120"), df.where("row_id >= 120").drop("table_id", "weight"), ["x"], {"s0": 1.0, "s1": 0.5}, adapt.Booster(trees=2, depth=2))
    assert {"level2", "level2_lsc"} <= {r.level for r in got.select("level").collect()} and seen == [{}, {"shift": True}]


def test_transfer_scores_cover_all_rows_and_dimensions(spark, folder):
    at, _ = folder
    got = QUERIES["transfer_scores"](spark, at).toPandas()
    assert got["n_rows"].sum() == N // 2 and (got["separation"] > 8).all() and (got["tsc"] > 0.9).all()


def test_transfer_scores_of_all_rows_against_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 600)
    x, t = rng.normal(0, 1, (600, 3)) + y[:, None], rng.normal(0.4, 1, (500, 3))
    s = spark.createDataFrame([(i, "s", int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "row_id long, table_id string, label int, a double, b double, c double")
    b = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "row_id long, a double, b double, c double")
    few, all_rows = (transfer.source_scores(s.repartition(3), b.repartition(3), ["a", "b", "c"], most_rows=n).first() for n in (100, 5000))
    z, u = (x - x.mean(0)) / x.std(0), (t - x.mean(0)) / x.std(0)
    p = transfer.chances(transfer.logistic(z, y), u)
    moved = lambda df: df.withColumns({"a": F.col("a") + 1e6, "k": F.lit(5.0)})
    far = transfer.source_scores(moved(s), moved(b), ["a", "b", "c", "k"]).first()
    assert np.allclose([far[k] for k in ("pas", "tsc", "spread", "separation")], [all_rows[k] for k in ("pas", "tsc", "spread", "separation")], atol=1e-4)
    assert few.n_rows == all_rows.n_rows == 600 and few.pas == all_rows.pas and few.separation == all_rows.separation
    assert abs(all_rows.separation - np.linalg.norm(z[y == 1].mean(0) - z[y == 0].mean(0))) < 1e-5
    assert abs(all_rows.spread - p.std()) < 1e-5 and abs(all_rows.tsc - transfer.round_trip(z, y, u)) < 1e-5
    assert abs(all_rows.nuclear - np.linalg.svd(np.stack([p, 1 - p], 1), compute_uv=False).sum() / len(u)) < 1e-5
    assert abs(all_rows.pas - transfer.pas(z, y, u)) < 1e-5
