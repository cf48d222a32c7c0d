"""Micro fixtures: the places where a plain reading goes wrong, with results by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.functions import numeric, text, vectors
from lakeweave.operators import adapt, align, binarize, distance, evaluate, joins, matching, neural, normalize, profile, ranking, sampling, transfer


def numbers(spark, values, column="x"):
    return spark.createDataFrame([(column, float(v)) for v in values], "column string, value double")


def test_missing_is_null_never_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = {r["level"]: r["value"] for r in profile.quantiles(df, ["x"], (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 1.0: 3.0}
    p = profile.column_profile(df).first()
    assert (p.n_rows, p.n_values, p.n_distinct) == (4, 2, 2)
    assert profile.prune_columns(df.withColumn("c", F.lit(1))).columns == []


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    got = [r["value"] for r in profile.quantiles(df, ["x"], (0.25, 0.5, 0.9)).orderBy("level").collect()]
    assert np.allclose(got, np.quantile([1, 2, 3, 10], [0.25, 0.5, 0.9]))


def otsu_by_hand(values, most=256):
    n = min(most, len(set(values)))
    low, high = min(values), max(values)
    width = (high - low) / n
    counts = [0] * n
    for v in values:
        counts[min(int((v - low) / width), n - 1)] += 1
    centres = [low + (i + 0.5) * width for i in range(n)]
    best, at = -1, None
    for i in range(n - 1):
        w0, w1 = sum(counts[: i + 1]), sum(counts[i + 1 :])
        if w0 and w1:
            m0 = sum(c * x for c, x in zip(counts[: i + 1], centres, strict=False)) / w0
            m1 = sum(c * x for c, x in zip(counts[i + 1 :], centres[i + 1 :], strict=False)) / w1
            if round(w0 * w1 * (m0 - m1) ** 2, 3) > best:
                best, at = round(w0 * w1 * (m0 - m1) ** 2, 3), centres[i]
    return at


def test_otsu(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(200)] + [rng.gauss(8, 1) for _ in range(100)]
    row = profile.otsu(numbers(spark, values)).first()
    assert row.method == "otsu" and abs(row.threshold - otsu_by_hand(values)) < 1e-9
    nine, ten = profile.otsu(numbers(spark, range(9))).first(), profile.otsu(numbers(spark, range(10))).first()
    assert (nine.method, nine.threshold, ten.method) == ("median_fallback", 4.0, "otsu")
    assert profile.otsu(numbers(spark, [5] * 20)).first().threshold == 5.0


def test_threshold_at_the_minimum(spark):
    df = spark.createDataFrame([(0.0,)] * 8 + [(1.0,), (None,)], "x double")
    up = df.select(binarize.binarize("x", F.lit(0.0), F.lit(0.0)).alias("y")).agg(F.sum("y")).first()[0]
    assert up == 1  # missing counts as the threshold, which is not above itself
    down = df.select(binarize.binarize("x", F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(" Negative ")).alias("y")).agg(F.sum("y")).first()[0]
    assert down == 8
    assert binarize.median_binarize(df, "x").where("label = 1").count() == 1


def test_ks_by_hand(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(20) for _ in range(80)], [rng.randrange(5, 30) for _ in range(50)]
    want = max(abs(sum(x <= v for x in a) / 80 - sum(x <= v for x in b) / 50) for v in range(31))
    got = distance.ks_matrix(numbers(spark, a, "a"), numbers(spark, b, "b")).first().ks
    back = distance.ks_matrix(numbers(spark, b, "b"), numbers(spark, a, "a")).first().ks
    assert abs(got - want) < 1e-6 and got == back
    assert distance.ks_matrix(numbers(spark, a, "a"), numbers(spark, a, "a2")).first().ks == 0


def test_auc_ties_and_mirror(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    df = spark.createDataFrame(rows, "y int, p double")
    assert abs(evaluate.auc(df, "y", "p").first().auc - want) < 1e-6
    assert abs(evaluate.auc(df.withColumn("p", 1 - F.col("p")), "y", "p").first().auc - (1 - want)) < 1e-6
    assert evaluate.auc(df.where("y = 1"), "y", "p").first().auc is None
    assert abs(transfer.rank_auc(np.array([y for y, _ in rows]), np.array([p for _, p in rows])) - want) < 1e-9


def test_prior_threshold(spark):
    df = spark.createDataFrame([(0.5,)] * 9, "p double")
    assert evaluate.prior_threshold(df, "p", 0.4).first().threshold == 0.5  # every row is positive then
    df = spark.createDataFrame([(i / 10,) for i in range(10)], "p double")
    assert evaluate.prior_threshold(df, "p", 0.25).first().threshold == 0.7


def test_metrics_keep_unlisted_levels(spark):
    df = spark.createDataFrame([("kmm", 0.9, 0.1, 0.8), ("baseline_a", 0.5, 0.0, 0.5)], "level string, accuracy double, f1 double, auc double")
    got = {r.level: r for r in evaluate.with_deltas(df, "baseline_a").collect()}
    assert got["kmm"].auc_delta == 0.3 and got["kmm"].place > got["baseline_a"].place == 1
    assert evaluate.gap_closed(F.lit(1.0), F.lit(0.5), F.lit(0.5)) is not None


def test_weighted_median_on_the_half(spark):
    df = spark.createDataFrame([(1, 0.2, 1.0), (1, 0.6, 1.0), (1, 0.9, 2.0)], "k int, p double, w double")
    assert ranking.weighted_median(df, ["k"], "p", "w").first().weighted_median == 0.6


def test_day_differences(spark):
    df = spark.sql("SELECT timestamp'2024-05-02 08:00' AS a, timestamp'2024-05-02 09:00' AS b")
    got = df.select(numeric.day_difference("a", "b", -5, 5).alias("x"), numeric.day_difference("a", "b").alias("y"), numeric.day_difference(F.lit(None), "b").alias("z")).first()
    assert (got.x, got.y, got.z) == (-1, 0, None)


def test_ensemble_modes(spark):
    sure = spark.createDataFrame([(1, 0.99)], "row_id long, p1 double")
    unsure = spark.createDataFrame([(1, 0.5)], "row_id long, p1 double")
    reference, confidence = (adapt.ensemble(sure, unsure, m).first().p1 for m in ("reference", "confidence"))
    assert reference < 0.6 < confidence and abs(confidence - (0.7 * 0.99 + 0.3 * 0.5)) < 1e-6


def test_missing_features_reach_trees(spark):
    rows = [(i, float(i % 5) if i % 4 else None, i % 2, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, x double, label int, weight double")
    p = adapt.fit(df, ["x"], adapt.Booster(trees=3))(df.drop("label")).toPandas()["p1"]
    assert p.between(0, 1).all() and len(p) == 60
    assert set(adapt.fit(df.where("label = 1"), ["x"])(df).toPandas()["p1"]) == {1.0}
    assert {r.prediction for r in adapt.baseline_a(df).collect()} == {0}


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = matching.assign(cost)
        small, large = sorted((n, m))
        c = cost if n <= m else cost.T
        best = min(sum(c[i, q[i]] for i in range(small)) for q in itertools.permutations(range(large), small))
        assert len(got) == small == len({i for i, _ in got}) == len({j for _, j in got}) and abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


def test_known_mapping_is_found(spark):
    names = {"age": "Age", "hours_worked": "hours worked weekly", "marital_status": "maritalStatus", "income": "annual income"}
    encoder = matching.HashedNgramEncoder()
    both = spark.createDataFrame([(s, True) for s in [*names, *names.values()]], "name string, is_num boolean")
    named = both.join(matching.encode_names(both, encoder), "name")
    source = named.where(F.col("name").isin(*names.values())).withColumn("table_id", F.lit("t"))
    got = {r.src_col: r.tgt_col for r in matching.match_columns(source, named.where(F.col("name").isin(*names))).collect()}
    assert got == {v: k for k, v in names.items()}
    assert matching.schema_similarity(matching.match_columns(source, named.where(F.col("name").isin(*names)))).first().schema_sim > 0.3


def test_perturbed_schema(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    got = align.perturbed(df, {"a": "A1"}, ["b"], {"c": [0, 3, 5]})
    assert got.columns == ["A1", "c"] and got.first() == (1.0, 0.0)


def test_joins(spark):
    edges = [0.0, 1.0, 2.0]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, -1.0, None)], "k double")
    assert [r.b for r in df.select(joins.bin_number(F.col("k"), edges).alias("b")).collect()] == [0, 0, 0, 1, 1, None, None, None]
    source = spark.createDataFrame([(float(i), float(i * i)) for i in range(80)], "k double, v double")
    out = joins.binned_join(df.where("k >= 0 or k is null"), "k", source, "k", ["v"])
    assert out.count() == 7 and out.where("k is null").first().mean_v > 500
    assert joins.binned_join(df.select((F.col("k") + 1000).alias("k")).dropna(), "k", source, "k", ["v"]) is None


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.random((60, 4)).round(2)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, vector array<double>")
    got = joins.nearest(df.where("id < 7"), df, 5).collect()
    for i in range(7):
        d = np.sqrt(((v - v[i]) ** 2).sum(1)).round(6)
        want = [j for j in np.lexsort((np.arange(60), d)) if j != i][:5]
        assert [r.neighbour for r in sorted((r for r in got if r.id == i), key=lambda r: r.rank)] == want


def test_diverse_top_k(spark):
    rows = [(0, 1.0, [1.0, 0.0]), (1, 0.95, [1.0, 0.01]), (2, 0.7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, s double, v array<double>")
    assert ranking.mmr(df, "id", "s", "v", 2) == [0, 2] and ranking.mmr(df, "id", "s", "v", 2, trade=1.0) == [0, 1]
    assert ranking.greedy_distinct(["a", "b", "c"], np.array([[1, 0], [1, 0.01], [0, 1.0]])) == ["a", "c"]
    assert ranking.greedy_clusters(["a", "b", "c"], np.array([[1, 0], [1, 0.01], [0, 1.0]])) == [["a", "b"], ["c"]]


def test_samples_repeat(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(sampling.hash_sample(df, "id", 20)) == ids(sampling.hash_sample(df.repartition(7), "id", 20))
    s = sampling.stratified_sample(df, "label", "id", 0.1)
    assert s.where("label = 1").count() == 10 and s.count() == 50
    a, b = sampling.split(df, "id")
    assert a.count() + b.count() == 500 and 350 < a.count() < 450
    t = sampling.bootstrap(df, "id", 4).groupBy("replica").agg(F.sum("times").alias("n")).collect()
    assert len(t) == 4 and all(400 < r.n < 600 for r in t)
    assert len(ids(sampling.stride_sample(df, "id", 60))) == 56


def test_quantile_transform(spark):
    df = spark.createDataFrame([(i, float(i), 3.0) for i in range(101)] + [(200, None, 3.0)], "i long, x double, c double")
    got = {r.i: r for r in normalize.quantile_transformed(df, ["x", "c"]).collect()}
    assert abs(got[50].x - 0.5) < 1e-9 and got[0].x == 0 and got[200].x is None and got[3].c == 0.5
    n = {r.i: r.x for r in normalize.quantile_transformed(df, ["x"], normal=True).collect()}
    assert abs(n[50]) < 1e-6 and abs(n[84] - 0.9945) < 1e-3 and n[10] == pytest.approx(-n[90], abs=1e-6)


def test_names_and_replies(spark):
    df = spark.createDataFrame([('<think>0</think>```json\n{"prediction": 1, "confidence": 1.7}```',), ("0",), ("maybe",)], "r string")
    got = df.select(text.reply_prediction("r").alias("p"), text.reply_confidence("r").alias("c"), text.reply_direction("r").alias("d")).collect()
    assert [(g.p, g.c) for g in got] == [(1, 1.0), (0, 0.5), (None, 0.5)] and {g.d for g in got} == {"POSITIVE"}
    one = df.limit(1).select(text.slug(F.lit(" Annual Income ($)")).alias("s"), text.without_tags(F.lit("<b>x</b>y")).alias("t"), text.first_sentence(F.lit("One. Two.")).alias("f"), text.table_number(F.lit("1,234%")).alias("n")).first()
    assert tuple(one) == ("annual_income", "xy", "One.", 1234.0)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.dot("a", "b"), vectors.norm("a"), vectors.cosine("a", "b"), vectors.outer("a", "b"), vectors.cosine("a", F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert tuple(got) == (3.0, 5.0, 0.6, [3.0, 0.0, 4.0, 0.0], None)
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "k int, v array<double>")
    for width in (None, 2):
        assert {r.k: r.centroid for r in vectors.centroids(rows, ["k"], "v", width=width).collect()} == {0: [2.0, 3.0], 1: [5.0, 6.0]}


def test_filter_power_set(spark):
    df = spark.range(12)
    got = {r.combination: r.n_kept for r in ranking.filter_power_set(df, {"even": F.col("id") % 2 == 0, "third": F.col("id") % 3 == 0}).collect()}
    assert got == {"none": 12, "even": 6, "third": 4, "even+third": 2}


def shifted(seed=0, n=400):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, 4)) + y[:, None] * np.array([2.5, 1.5, 0, 0])
    return x, y, rng.normal(0, 1, (n, 4)) + (z := rng.integers(0, 2, n))[:, None] * np.array([2.5, 1.5, 0, 0]) + 1.0, z


@pytest.mark.parametrize("conditional", [False, True])
def test_adversarial_nets_learn(conditional):
    x, y, t, z = shifted()
    net = neural.adversarial(x, y, t, conditional=conditional)
    assert transfer.rank_auc(z, net.predict(t)) > 0.9
    assert transfer.rank_auc(z, neural.test_time_adapted(net, t, 0.5).predict(t)) > 0.85


def test_transport_weights_propagation():
    x, y, t, z = shifted(1, 200)
    moved = neural.transported(x, y, t, z)
    assert np.abs(moved.mean(0) - t.mean(0)).max() < np.abs(x.mean(0) - t.mean(0)).max()
    w = neural.kernel_mean_weights(np.vstack([x, x + 6]), x)
    assert w[:200].mean() > 3 * w[200:].mean() and 0 <= w.min() and w.max() <= 10
    label = np.where(np.arange(200) < 40, y, -1)
    assert transfer.rank_auc(y[40:], neural.propagated(x, label)[40:]) > 0.85


def test_transfer_scores_prefer_the_same_concept():
    x, y, t, _ = shifted(2)
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 2, len(y))
    assert transfer.pas(x, y, t) > transfer.pas(x, noise, t) and transfer.round_trip(x, y, t) > transfer.round_trip(x, noise, t)
    assert np.isnan(transfer.pas(x, np.zeros(len(y)), t))
    assert abs(transfer.t_tail(2.228, 10) - 0.05) < 1e-3


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    a, b = [rng.random() for _ in range(200)], [rng.random() for _ in range(150)]
    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add((distance.ks_matrix(numbers(spark, a), numbers(spark, b)).first().ks, profile.otsu(numbers(spark, a)).first().threshold))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_orphans_are_imputed(spark):
    rng = np.random.default_rng(6)
    src, orph = [], []
    for t in ("a", "b"):
        for i in range(100):
            x = rng.normal(0, 1, 2)
            src.append((t, i, float(x[0]), float(x[1])))
            orph.append((t, i, "extra", float(3 + 2 * x[0] - x[1])))
            orph.append((t, i, "noise", float(rng.normal())))
    sources = spark.createDataFrame(src, "table_id string, row_id long, x double, y double")
    orphans = spark.createDataFrame(orph, "table_id string, row_id long, cluster string, value double")
    target = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "x double, y double")
    got = joins.imputed_orphans(sources, orphans, target, ["x", "y"])
    assert got.columns == ["x", "y", "extra"]
    assert np.allclose(sorted(r.extra for r in got.collect()), [1.0, 5.0], atol=0.2)


def test_index_suggests_tables(spark, tmp_path):
    from lakeweave.operators import index

    encoder = matching.HashedNgramEncoder()
    columns = spark.createDataFrame([("t1", 0, "annual income"), ("t1", 1, "age"), ("t2", 0, "annual income"), ("t3", 0, "age")], "table_id string, pos int, name string")
    index.build_index(columns, encoder, f"file://{tmp_path}")
    names, table_col = (spark.read.parquet(f"file://{tmp_path}/{x}") for x in ("name_dim", "table_col"))
    label = matching.encode_names(spark.createDataFrame([("annual income",)], "name string"), encoder)
    goal = matching.encode_names(spark.createDataFrame([("age",), ("hours",)], "name string"), encoder)
    got = [(r.table_id, r.coverage, r.score) for r in index.candidates(names, table_col, label, goal).collect()]
    assert got == [("t1", 0.5, 1.5), ("t2", 0.0, 1.0)]


def test_importance_and_cross_source_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{i % 3}", i, float(x := rng.normal()), float(rng.normal()), int(x > 0), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "table_id string, row_id long, x double, z double, label int, weight double")
    weights = {r.feature: (r.importance, r.place) for r in adapt.importance(df, df, ["x", "z"], adapt.Booster(trees=3)).collect()}
    assert weights["x"][1] == 1 and weights["x"][0] > 10 * weights["z"][0]
    scores = transfer.cross_source_scores(df, ["x", "z"])
    assert scores["lcc"] > 0.95 and scores["cslp"] > 0.9 and transfer.leave_one_out([]) == 0.5
    p = adapt.self_trained_with_labels(df.where("row_id < 200"), df.where("row_id >= 200 and row_id < 230"), df.where("row_id >= 230").drop("label", "weight"), ["x", "z"], adapt.Booster(trees=3), rounds=(0.3,))
    assert p.count() == 70 and evaluate.auc(p.join(df.select("row_id", "label"), "row_id"), "label", "p1").first().auc > 0.9


@pytest.mark.parametrize("held", [2000, 4])
def test_neighbours_in_a_group_against_all_pairs(spark, monkeypatch, held):
    """Groups of one part and of several, ties, repeated names, zeros and a name alone."""
    monkeypatch.setattr(vectors, "HELD", held)
    rng = random.Random(3)
    rows = [(f"t{i % 3}", f"n{i:02}", [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(45)] + [("t0", "n00", [1.0, 0.0, 0.0]), ("alone", "n", [1.0, 2.0, 2.0]), (None, "x", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "table_id string, name string, vector array<double>").repartition(3)
    size = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda v, w: round(sum(a * b for a, b in zip(v, w, strict=True)) / ((size(v) or 1) * (size(w) or 1)), 9)
    got = {(r.table_id, r.name): [(round(-x.s, 9), x.n) for x in r._near] for r in vectors.nearest_in_group(df, 3).collect()}
    for t, n, v in rows:
        if t in (None, "alone") or (t, n) == ("t0", "n00"):
            continue
        assert got[t, n] == [(s, m) for s, m, _ in sorted(((cos(v, w), m, w) for u, m, w in rows if u == t and m != n), key=lambda x: (-x[0], x[1], x[2]))[:3]]
    blended = {(r.table_id, r.name): r.vector for r in vectors.blended_with_neighbours(df).collect()}
    assert blended["alone", "n"] == [1.0, 2.0, 2.0] and blended[None, "x"] == [1.0, 0.0, 0.0] and len(blended) == 47
