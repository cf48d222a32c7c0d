"""Order statistics by ranges against NumPy, with ties, nulls, single values, many groups and no rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import joins, order


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    kinds = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randrange(4)), "c": lambda: 7.0, "d": lambda: rng.gauss(1e6, 1)}
    out = [(g, k()) for g, k in kinds.items() for _ in range(n // len(kinds))]
    return out + [("a", None), (None, 1.0), (None, 3.0), ("e", 2.5)]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(rows(), "g string, value double").repartition(5).cache()


def test_quantiles(values):
    levels = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.level): r.value for r in order.quantiles(values, ["g"], levels).collect()}
    groups = {}
    for g, v in rows():
        groups.setdefault(g, []).append(v)
    assert len(got) == len(groups) * len(levels)
    for g, vs in groups.items():
        want = np.quantile([v for v in vs if v is not None], levels)
        assert np.allclose([got[g, x] for x in levels], want, rtol=1e-12)
    whole = order.quantile_arrays(values.drop("g"), [], levels, "q").first()["q"]
    assert np.allclose(whole, np.quantile([v for _, v in rows() if v is not None], levels), rtol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(values, descending):
    counts = order.counted(values.where("value is not null"), ["g"])
    got = order.running(counts, ["g"], "value", ["n"], descending).collect()
    for r in got:
        same = [x for x in got if x.g == r.g]
        upto = sum(x.n for x in same if (x.value >= r.value if descending else x.value <= r.value))
        assert (r.n_upto, r.n_all) == (upto, sum(x.n for x in same))


def test_positions(spark):
    df = spark.createDataFrame([(i % 13, i) for i in range(500)], "a long, b long").repartition(4)
    got = [(r.a, r.b) for r in sorted(order.positions(df, ["a", "b"]).collect(), key=lambda r: r.position)]
    assert got == sorted(got) and len(got) == 500
    assert sorted(r.position for r in order.positions(df, [-F.col("a"), "b"]).collect()) == list(range(500))


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, value double")
    assert order.quantiles(none, ["g"], [0.5]).isEmpty() and order.quantiles(none.drop("g"), [], [0.5]).isEmpty()
    assert order.running(order.counted(none, ["g"]), ["g"], "value", ["n"]).isEmpty() and order.positions(none, ["value"]).isEmpty()


def test_overlaps_of_many_columns_with_common_values(spark):
    rng = random.Random(3)
    sets = {f"c{i}": {"yes", "1", *(f"v{rng.randrange(25)}" for _ in range(rng.randrange(1, 12)))} for i in range(60)}
    df = spark.createDataFrame([(c, v) for c, vs in sets.items() for v in vs], "column string, value string")
    got = {(r.a, r.b): r.jaccard for r in joins.value_overlaps(df).collect()}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.5 * len(x | y)}
    assert got == want
