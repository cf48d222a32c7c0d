"""The quick scores against plain NumPy over all rows."""

import numpy as np

from lakeweave.operators import fast_transfer


def margin(x, centres):
    d = np.sort(np.stack([np.linalg.norm(x - c, axis=1) for c in centres], 1), 1)
    return ((d[:, 1] - d[:, 0]) / (d[:, 1] + 1e-9)).mean()


def whiten(x, k):
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    keep = s[:k] > 1e-7 * s[0]
    return v[:k][keep].T / (s[:k][keep] / np.sqrt(len(x) - 1))


def test_scores_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(6)]
    goal = rng.normal(size=(90, 6)) * [1, 2, 1, 5, 1, 1] + [0, 1, 0, 3, 0, 0]
    tables = {}
    for t, shift in (("a", 0.0), ("b", 1.5), ("few", 0.0), ("c", 4.0)):
        n = 12 if t == "few" else 80
        y = (np.arange(n) % 2) if t != "few" else (np.arange(n) < 2).astype(int)
        x = rng.normal(size=(n, 6)) * [1, 2, 1, 5, 1, 1] + shift + 1.5 * y[:, None]
        tables[t] = (x, y)
    tables["c"][0][::7, 1] = np.nan
    sims = [("a", c, 0.9) for c in names] + [("b", "f0", 0.7), ("b", "f1", 0.55), ("b", "f3", 0.61)] + [("few", c, 1.0) for c in names] + [("c", "f1", 0.9)]
    rows, i = [], 0
    for t, (x, y) in tables.items():
        have = {c for s, c, _ in sims if s == t}
        for r, k in zip(x, y, strict=True):
            rows.append((t, i, int(k), *[float(v) if c in have and v == v else None for c, v in zip(names, r, strict=True)]))
            i += 1
    schema = "table_id string, row_id long, label int, " + ", ".join(f"{c} double" for c in names)
    sources = spark.createDataFrame(rows, schema).repartition(5)
    target = spark.createDataFrame([(j, *map(float, r)) for j, r in enumerate(goal)], "row_id long, " + ", ".join(f"{c} double" for c in names))
    matched = fast_transfer.matched_columns(spark.createDataFrame(sims, "table_id string, tgt_col string, sim double"), names)
    monkeypatch.setattr(fast_transfer, "MOST_BYTES", 1500)  # a plan or two at a time
    scores = fast_transfer.source_scores(sources, target, names, matched)
    got = {r.table_id: r for r in scores.collect()}
    assert set(got) == set(tables) and got["few"].pas is None and got["few"].pca_pas is None and got["few"].n_rows == 12
    m, s = goal.mean(0), goal.std(0)
    into = whiten((goal - m) / s, 3)
    spread = (((goal - m) / s) @ into).std(0)
    for t in ("a", "b", "c"):
        x, y = np.nan_to_num(tables[t][0]), tables[t][1]
        best = {c: v for u, c, v in sims if u == t}
        tight, loose = (np.array([best.get(c, 0) >= least for c in names]) for least in (0.6, 0.5))
        for name, mask in (("pas", tight), ("pas_loose", loose)):
            a, b = x[:, mask], goal[:, mask]
            low, width = a.min(0), np.ptp(a, 0) + 1e-9
            want = margin((b - low) / width, [((a - low) / width)[y == k].mean(0) for k in (0, 1)]) if mask.sum() >= 2 else None
            assert want is None and got[t][name] is None or abs(got[t][name] - want) < 2e-6
        a, b = x[:, loose], goal[:, loose]
        if loose.sum() >= 2:
            z, q = (a - a.mean(0)) / a.std(0), (b - a.mean(0)) / a.std(0)
            w = whiten(z, min(loose.sum(), 8))
            assert abs(got[t].source_pas - margin(q @ w, [(z @ w)[y == k].mean(0) for k in (0, 1)])) < 2e-6
        z = np.where(tight, (x - m) / s, 0) @ into
        inner = sum(np.cov(z[y == k].T) * ((y == k).sum() - 1) for k in (0, 1)) / (len(y) - 2)
        gap = z[y == 1].mean(0) - z[y == 0].mean(0)
        far = np.sqrt(gap @ np.linalg.pinv(inner + 1e-6 * np.eye(3)) @ gap)
        assert abs(got[t].pca_pas - far * (np.abs(z) <= 2 * (spread + 1e-9)).mean() / np.sqrt(3)) < 1e-5
        ks = [max(abs((x[:, j] <= v).mean() - (goal[:, j] <= v).mean()) for v in goal[:, j]) for j in np.flatnonzero(loose)]
        assert abs(got[t].overlap - (1 - np.mean(ks))) < 1e-6
        assert 0.5 < got[t].lcc <= 1
    row = fast_transfer.overall(scores, sources, names, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "table_id string, weight double")).first()
    assert abs(row.pas - (3 * got["a"].pas + got["b"].pas) / 4) < 1e-5 and abs(row.overall - (row.source_pas + row.overlap + 1 - row.cslp) / 3) < 1e-5


def test_no_sources(spark):
    none = spark.createDataFrame([], "table_id string, row_id long, label int, a double, b double")
    target = spark.createDataFrame([(1, 1.0, 2.0)], "row_id long, a double, b double")
    scores = fast_transfer.source_scores(none, target, ["a", "b"])
    assert scores.collect() == [] and fast_transfer.overall(scores, none, ["a", "b"]).first().overall == 0.5
