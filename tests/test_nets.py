"""Nets that are fitted to all rows, in blocks."""

import numpy as np
from pyspark.sql import functions as F

from lakeweave.operators import adapt, nets, neural
from lakeweave.plans import pipeline


def frame(spark, x, y=None, w=None):
    rows = [(i, *map(float, r), *([int(y[i]), "s", float(w[i])] if y is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"x{i} double" for i in range(len(x[0]))) + (", label int, table_id string, weight double" if y is not None else ""))


def test_levels_learn_from_rows_beyond_any_sample(spark, monkeypatch):
    """The 5,000 first rows by hash say the contrary of the others, which weigh more; the nets hear all of them."""
    rng = np.random.default_rng(5)
    n, m = 7000, 5500
    x, t = rng.normal(0, 1, (n, 2)), rng.normal(0, 1, (m, 2))
    w, y = np.full(n, 0.01), (x[:, 0] < 0).astype(int)
    first = [r.row_id for r in spark.range(n).select(F.col("id").alias("row_id")).orderBy(F.xxhash64("row_id")).limit(5000).collect()]
    late = np.setdiff1d(np.arange(n), first)
    w[late], y[late] = 1.0, x[late, 0] > 0
    monkeypatch.setattr(adapt, "self_trained", lambda s, t, f, b, **k: adapt.result(t.withColumn("p1", F.lit(0.5)), "level2_lsc" if k.get("shift") else "level2"))
    target = frame(spark, t).withColumn("label", (F.col("x0") > 0).cast("int"))
    got = pipeline.run_levels(frame(spark, x, y, w), target, ["x0", "x1"], {"s": 1.0}, adapt.Booster(trees=2, depth=2))
    auc = {r.level: r.auc for r in got.collect()}
    assert min(auc[k] for k in ("level5", "level55", "level6")) > 0.9


def test_every_row_takes_part_equally_often():
    for rows in (0, 1, 300, 511, 512, 5000, 51199, 51200, 10**7):
        k = nets.parts_of(rows, 200, 256)
        assert 200 % k == 0 and (k == 1 or rows // k >= 256)
    assert nets.parts_of(51200, 200, 256) == 200


def test_blocks_give_the_gradients_of_all_rows(spark, monkeypatch):
    """With few rows each step has all of them: the nets are those of full gradients in one array."""
    rng = np.random.default_rng(6)
    x, t, v = rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (350, 3)), rng.normal(0, 1, (280, 3))
    y, w = (x[:, 0] > 0).astype(int), rng.uniform(0.5, 2, 300)
    monkeypatch.setattr(nets, "BLOCK", 90)
    found, rate = nets.adversarial(frame(spark, x, y, w).repartition(3), frame(spark, t), ["x0", "x1", "x2"], frame(spark, v), steps=30)
    assert rate == y.mean()
    a, b, c = (x - x.mean(0)) / x.std(0), (t - t.mean(0)) / t.std(0), (v - x.mean(0)) / x.std(0)
    every = np.vstack([a, c, b])
    rows = 3 * np.r_[np.full(300, 300), np.full(280, 280), np.full(350, 350)]
    for conditional, net in zip((False, True), found, strict=True):
        own = neural.Net(neural.initial(3, (64, 32), conditional, np.random.default_rng(0)), t.mean(0), t.std(0))
        moments = [{k: np.zeros_like(p) for k, p in own.p.items()} for _ in range(2)]
        for step in range(1, 31):
            g = neural.gradients(own, every, y.astype(float), w / w.mean() / 300, np.r_[np.ones(580), np.zeros(350)], rows, neural.reversal(step, 30), conditional, 0.7)
            neural.descend(own.p, moments, g, step, 3e-3)
        assert np.allclose(net.predict(t), own.predict(t), atol=1e-6)


def test_test_time_adaptation_in_blocks_is_that_of_one_array(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, t = rng.normal(0, 1, (300, 3)), rng.normal(0.5, 1, (260, 3))
    net = neural.adversarial(x, (x[:, 0] > 0).astype(int), t, steps=60)
    monkeypatch.setattr(nets, "BLOCK", 40)
    for neighbours, prior in ((10, 0.4), (0, None), (400, 0.3)):
        got = nets.test_time_adapted(net, frame(spark, t).repartition(3), ["x0", "x1", "x2"], prior, neighbours)
        own = neural.test_time_adapted(net, t, prior, neighbours)
        assert np.allclose(got.predict(t), own.predict(t), atol=1e-8) and abs(got.shift - own.shift) < 1e-9


def test_neighbours_of_repeated_rows(spark, monkeypatch):
    """Copies count as rows of their own; blocks on the other side may come in several parts."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (120, 2))
    n = rng.integers(1, 5, 120)
    net = neural.adversarial(x, (x[:, 0] > 0).astype(int), x, steps=20)
    sc = spark.sparkContext
    blocks = sc.parallelize([((i,), (x[i * 30 : i * 30 + 30], n[i * 30 : i * 30 + 30].astype(float), None)) for i in range(4)], 4)
    got = {}
    for key, (rows, _, near, share) in nets.neighbours_of(blocks, 3000, net, 7).collect():
        got |= {key[0] * 30 + i: (near[i], share[i]) for i in range(len(rows))}
    h = np.repeat(net.hidden(net.standard(x))[1], n, axis=0)
    every, owner = np.repeat(x, n, axis=0), np.repeat(np.arange(120), n)
    for i in range(120):
        d = ((h - h[np.searchsorted(owner, i)]) ** 2).sum(1)
        nearest = every[np.argsort(d, kind="stable")[:7]]
        near, share = got[i]
        assert abs(share.sum() - 1) < 1e-12 and np.allclose((near * share[:, None]).sum(0), nearest.mean(0))
