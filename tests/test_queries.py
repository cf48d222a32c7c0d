"""Every query that has SQL gives the rows that DuckDB gives; the others run and have rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lakeweave.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"gbt_selftrain", "gbt_label_shift", "baselines", "vla_pooled", "stacking", "adaptation_pipeline", "lake_run"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "-"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return f"{float(v):.5f}".rstrip("0").rstrip(".") if abs(float(v)) > 5e-6 else "0"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).where(df.notna(), None).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["gbt_selftrain", "stacking"])
def test_tree_models(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) and got["p1"].between(0, 1).all() and got["row_id"].is_unique


def test_composed_run_has_an_oracle(spark, monkeypatch):
    """The whole run over the tables' own lake: all levels, the oracle, and the gap that is closed."""
    from lakeweave.operators import adapt
    from lakeweave.plans import lake_queries, pipeline

    monkeypatch.setattr(lake_queries, "_experiment", lambda: pipeline.Experiment("price rating", ("price rating",), k=3, table=-1.0, context=-1.0, rest=-1.0, share=0.0, least_columns=3, booster=adapt.Booster(trees=20, rate=0.2)))
    metrics = adapt.cut(QUERIES["lake_run"](spark, SF))
    got = {r.level: r for r in metrics.collect()}
    assert {"baseline_a", "baseline_c", "level0", "level2", "level5", "ensemble", "source_ensemble", "oracle"} <= set(got)
    assert got["oracle"].auc > 0.9 and got["level2"].auc > 0.8
    from pyspark.sql import functions as F

    table = pipeline.compared(metrics.withColumns({"target": F.lit("t"), "lake": F.lit("own")}), "lake", ["own"]).first()
    assert table["own"] is None or table["own"] <= 1.5
