"""Sources, ingestion, the planted source, and that nothing needs the corpus operators."""

import json
import random
import subprocess
import sys
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from lakeweave.operators import adapt, matching, repurpose
from lakeweave.plans import pipeline
from lakeweave.sources import lake, remote, store, targets
from lakeweave.streaming import ingest


def test_directory_of_mixed_files(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    pd.DataFrame({"a": [1, 2], "b": ["x", "3"]}).to_csv(d / "one.csv", index=False)
    pd.DataFrame({"c": [1.5, None]}).to_parquet(d / "two.parquet")
    (d / "broken.parquet").write_bytes(b"no parquet")
    with zipfile.ZipFile(d / "more.zip", "w") as z:
        z.writestr("three.csv", "q\n7\n")
    got = sorted((r.table_id, r.row_id, r.col, r.value) for r in lake.read_directory(spark, f"file://{d}").collect())
    assert got == [("one", 0, "a", 1.0), ("one", 1, "a", 2.0), ("one", 1, "b", 3.0), ("three", 0, "q", 7.0), ("two", 0, "c", 1.5)]
    (d / "notes.txt").write_text("x")
    assert {r.path.rsplit("/", 1)[1] for r in lake.unreadable_files(spark, f"file://{d}").collect()} == {"broken.parquet", "notes.txt"}
    m = {r.table_id: r for r in lake.manifest_of(lake.read_directory(spark, f"file://{d}")).collect()}
    assert m["one"].n_rows == 2 and m["one"].columns == ["a", "b"]


def test_manifest_round_trip(spark, tmp_path):
    rows = [("t1", 5, 2, ["a", "b"], "p"), ("t2", 1, 1, ["c"], None)]
    df = spark.createDataFrame(rows, "table_id string, n_rows long, n_cols long, columns array<string>, path string")
    lake.write_manifest(df, f"file://{tmp_path}/m")
    assert sorted(map(tuple, lake.read_manifest(spark, f"file://{tmp_path}/m").collect())) == rows
    assert lake.columns_of(df).count() == 3
    assert lake.distinct_headers(["a", "a", "", " a ", None]) == ["a", "a_1", "col_2", "a_2", "col_4"]


def test_wiki_tables(spark):
    cell = lambda *v: [{"text": x} for x in v]
    rows = [("w", [cell("n", "share")], [cell(str(i), f"{i * 10}%") for i in range(1, 7)]), ("short", [cell("n", "m")], [cell("1", "2")])]
    df = spark.createDataFrame(rows, "table_id string, tableHeaders array<array<struct<text:string>>>, tableData array<array<struct<text:string>>>")
    got = lake.parse_wiki(df).collect()
    assert len(got) == 12 and {r.table_id for r in got} == {"w"} and max(r.value for r in got) == 60.0


def test_stages_are_kept_by_all_their_parameters(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for threshold in (0.5, 0.5, 0.6):
        assert store.stage(spark, f"file://{tmp_path}", "scan", {"threshold": threshold}, compute).count() == 3
    assert len(calls) == 2


def test_budget(spark):
    df = spark.createDataFrame([("a", 5, 10), ("b", 4, 9), ("c", 3, 1)], "table_id string, bytes long, n long")
    assert {r.table_id for r in lake.within_budget(df, "bytes", 9, "n").collect()} == {"a", "b"}


def test_targets(spark, tmp_path):
    rows = ["ScheduledDay,AppointmentDay,Age,Gender,No-show,PatientId", "2016-04-29T18:38:08Z,2016-04-29T00:00:00Z,30,F,No,1", "2016-04-20T00:00:00Z,2016-04-29T00:00:00Z,40,M,Yes,2", "2016-04-20T00:00:00Z,2016-04-29T00:00:00Z,-1,M,No,3"]
    (tmp_path / "noshow.csv").write_text("\n".join(rows) + "\n")
    got = sorted(map(lambda r: (r.days_ahead, r.label), targets.load(spark, "noshow", f"file://{tmp_path}/noshow.csv").collect()))
    assert got == [(0, 0), (9, 1)]
    assert {"adult", "bank", "heart", "titanic", "stroke", "obesity", "nyhouse"} <= set(targets.LOADERS)
    df = spark.createDataFrame([("b", "yes"), ("a", "no"), ("c", "no")], "f string, answer string")
    assert sorted((r.f, r.label) for r in targets.generic(df, "answer").collect()) == [(0, 0), (1, 1), (2, 0)]


def test_catalogue_and_replies(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"dataset_id": "x", "n_numeric": 5}, {"dataset_id": "y", "n_numeric": 1}]))
    spark.dataSource.register(remote.CatalogSource)
    assert [r.dataset_id for r in spark.read.format("lake_catalog").option("pages", str(tmp_path / "p1.json")).load().collect()] == ["x"]
    (tmp_path / "p2.json").write_text(json.dumps([{"dataset_id": "y", "n_numeric": 3}, {"dataset_id": "z", "n_numeric": 1}, {"dataset_id": "w"}]))
    assert sorted(r.dataset_id for r in spark.read.format("lake_catalog").option("pages", f"{tmp_path}/p*.json").load().collect()) == ["x", "y"]
    assert sorted(r.dataset_id for r in remote.read_catalog(spark, f"file://{tmp_path}/p*.json").collect()) == ["x", "y"]
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "row_id long, x double")
    got = remote.zero_shot(rows, ["x"], "?", lambda p: '{"prediction": 1, "confidence": 0.8}', most=3).collect()
    assert sum(r.scored for r in got) == 3 and {r.p1 for r in got if r.scored} == {0.8}
    pairs = spark.createDataFrame([("l", " Age "), ("l", "debt")], "label string, col string")
    known = spark.createDataFrame([("l", "age", "POSITIVE")], "label string, col string, direction string")
    assert [tuple(r) for r in remote.new_directions(pairs, known, lambda p: "NEGATIVE").collect()] == [("l", "debt", "NEGATIVE")]
    assert remote.concepts_for(spark, "income", {}, lambda p: 'sure: ["salary", "wage"]') == ["income", "salary", "wage"]


def test_tables_arrive_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = (f"file://{source}", f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps({"table_id": f"t{n}", "rows": [["a", "b"], ["1", "2"], ["3", "5"]]}) + "\n")
        ingest.ingest_tables(spark, *args).awaitTermination()
    ingest.ingest_tables(spark, *args).awaitTermination()
    cells = spark.read.parquet(f"file://{tmp_path}/out/cells")
    assert cells.count() == 8 and cells.select("table_id").distinct().count() == 2


def test_arrivals_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", "a", float(i)) for i in range(9)], "event_id long, t string, event_type string, value double")
    events = rows.select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    q = ingest.arrival_counts(stream).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("arrivals")) == key(ingest.arrival_counts(events)) and spark.table("arrivals").count() == 3


def test_planted_source_is_found(spark):
    """A noisy copy of the target among other tables is discovered, aligned and labelled."""
    rng = random.Random(7)
    features = ["age years", "weekly hours", "education level", "capital gain"]
    tables = {"planted": [*features, "income"], "other": ["petal length", "petal width", "sepal length", "sepal width", "species code"], "odd": ["latitude", "longitude", "altitude", "temperature"]}
    cells, manifest = [], []
    for name, columns in tables.items():
        for i in range(120):
            x = [rng.gauss(0, 1) for _ in columns]
            x[-1] = round(x[0] + x[1] + rng.gauss(0, 0.3) + (6 if x[0] > 0 else 0), 1)  # 100 values at most
            cells += [(name, i, c, float(v)) for c, v in zip(columns, x, strict=True)]
        manifest.append((name, 120, len(columns), columns, None))
    cells = spark.createDataFrame(cells, lake.CELLS)
    manifest = spark.createDataFrame(manifest, "table_id string, n_rows long, n_cols long, columns array<string>, path string")
    e = pipeline.Experiment("income", ("income", "salary"), booster=adapt.Booster(trees=5))
    found = pipeline.discover(spark, manifest, cells, None, features, e)
    assert [r.table_id for r in found["scores"].orderBy(F.col("discovery_score").desc()).collect()] == ["planted"]
    rows = pipeline.aligned_sources(cells, found, features, e).toPandas()
    assert len(rows) == 120 and set(features) <= set(rows.columns) and 0.3 < rows["label"].mean() < 0.7 and set(rows["weight"]) == {1.0}


def test_nothing_needs_the_corpus_operators(tmp_path):
    import shutil

    top = Path(__file__).parent.parent
    shutil.copytree(top / "lakeweave", tmp_path / "lakeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})


def test_words_stand_for_a_concept_from_files_to_labels(spark, tmp_path):
    """A proxy of words alone is labelled by the pipeline, and columns of words don't meet columns of numbers."""
    rng = random.Random(4)
    features = ["age years", "weekly hours", "education level"]
    d = tmp_path / "lake"
    d.mkdir()
    for name in ("people", "staff"):
        rows = []
        for _ in range(80):
            x = [round(rng.gauss(0, 1), 2) for _ in features]
            rows.append([*x, "high income" if x[0] + x[1] > 0 else "none at all", rng.choice(["age", "hours"])])
        pd.DataFrame(rows, columns=[*features, "income", "ages years"]).to_csv(d / f"{name}.csv", index=False)
    cells = adapt.cut(lake.read_directory(spark, f"file://{d}", with_text=True))
    types = {(r.table_id, r.col): r.is_num for r in lake.column_types(cells).collect()}
    assert types == {(t, c): c in features for t in ("people", "staff") for c in [*features, "income", "ages years"]}
    target = spark.createDataFrame([(i, *[rng.gauss(0, 1) for _ in features], i % 2) for i in range(60)], "row_id long, " + ", ".join(f"`{c}` double" for c in features) + ", label int")
    e = pipeline.Experiment("income", ("income",), k=2, sibling=1.0, table=-1.0, context=-1.0, rest=-1.0, share=0.0, least_columns=2)
    found = pipeline.discover(spark, lake.manifest_of(cells), cells, target, features, e)
    kept = {r.table_id: r for r in found["lake"].collect()}
    assert {t: (r.method, r.threshold, r.kept, r.quality) for t, r in kept.items()} == {t: ("categorical_semantic", None, True, 1.0) for t in ("people", "staff")}
    assert {(r.src_col, r.tgt_col) for r in found["matches"].collect()} == {(c, c) for c in features}
    rows = pipeline.aligned_sources(cells, found, features, e).toPandas()
    assert len(rows) == 160 and ((rows["age years"] + rows["weekly hours"] > 0).astype(int) == rows["label"]).all()
    turned = pipeline.aligned_sources(cells, found, features, e, flipped=["staff"]).where("table_id = 'staff'").toPandas()
    assert ((turned["age years"] + turned["weekly hours"] > 0).astype(int) == 1 - turned["label"]).all()


def test_words_of_nested_tables_and_hopeless_categories(spark):
    rows = [["k", "state", "same", "mixed"]] + [[str(i), ["yes", "no", ""][i % 3], "x", "7" if i % 2 else "n/a"] for i in range(9)]
    nested = spark.createDataFrame([("n", rows)], "table_id string, rows array<array<string>>")
    cells = lake.parse_nested(nested, with_text=True)
    assert {(r.col, r.is_num) for r in lake.column_types(cells).collect()} == {("k", True), ("state", False), ("mixed", False)}
    assert {r.col for r in lake.parse_nested(nested).collect()} == {"k"}
    many = spark.createDataFrame([("m", i, "p", None, f"w{i}") for i in range(20)] + [("u", i, "p", None, f"w{i % 3}") for i in range(20)], lake.TYPED_CELLS)
    cells = cells.unionByName(many)
    proxies = spark.createDataFrame([("n", "state"), ("m", "p"), ("u", "p")], "table_id string, proxy_col string")
    none = spark.createDataFrame([], "col string, direction string")
    encoder = matching.HashedNgramEncoder()
    categories = repurpose.category_labels(cells, proxies, none, encoder, matching.encode_names(spark.createDataFrame([("zebra",)], "name string"), encoder))
    got = {r.table_id: (r.method, r.reason, r.positive_rate) for r in repurpose.labelled_lake(cells, proxies, none, categories=categories).collect()}
    assert got == {"n": ("categorical_affirmative", "", 0.5), "m": (None, "high_cardinality", None), "u": (None, "cat_no_mapping", None)}


def test_rows_of_tables_that_share_names(spark):
    """Every table with two names of the target takes part; missing values become its own medians."""
    cells = [(t, i, c, float(i)) for t in ("a", "b") for i in range(5) for c in (" Age", "hours")] + [("a", 9, "hours", 4.0), ("c", 0, "age", 1.0), ("b", 7, "hours", 100.0)]
    cells = spark.createDataFrame(cells, lake.CELLS)
    got = {(r.table_id, r.row_id): (r.age, r.hours) for r in lake.unlabelled_rows(lake.manifest_of(cells), cells, ["age", "hours"]).collect()}
    assert len(got) == 12 and got["a", 9] == (2.0, 4.0) and got["b", 7] == (2.0, 100.0) and got["b", 3] == (3.0, 3.0)


def test_a_lake_is_not_copied(spark, tmp_path, monkeypatch):
    """Discovery moves and writes the proxies' cells and those of the tables that are kept, not the lake's."""
    from pyspark.sql import functions as F

    from lakeweave.operators import adapt
    from lakeweave.plans import lake_queries, pipeline
    from lakeweave.plans.registry import Tables

    rows = spark.range(6000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 40 + 1).alias("l_suppkey"))
    rows = rows.withColumns({"l_quantity": (F.col("l_orderkey") * 7 % 50).cast("double"), "l_discount": (F.col("l_orderkey") % 11 / 100), "l_tax": (F.col("l_orderkey") % 9 / 100), "l_shipdate": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("l_orderkey") % 300).cast("int"))})
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    for name in [x for x in ("cut", "stored") if hasattr(adapt, x)]:
        monkeypatch.setattr(adapt, name, lambda df, old=getattr(adapt, name): written.append(old(df)) or written[-1])
    manifest, cells, target = lake_queries.lake_and_target(Tables(spark, str(tmp_path)))
    found = pipeline.discover(spark, manifest, cells, target, lake_queries.FEATURES, lake_queries._experiment())
    kept = found["lake"].where("kept").count()
    assert kept == 3 and found["lake"].count() == 36
    assert max(df.count() for df in written) < cells.count() / 6


def test_levels_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.sql import functions as F

    from lakeweave.operators import adapt
    from lakeweave.plans import pipeline

    rows = spark.range(240).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    sources = rows.withColumns({"table_id": F.lit("a"), "weight": F.lit(1.0)})
    together = threading.Barrier(2)
    old = adapt.self_trained

    def waits(*args, **kwargs):
        together.wait(60)  # both kinds of self-training run, or this breaks
        return old(*args, **kwargs)

    monkeypatch.setattr(adapt, "self_trained", waits)
    found = pipeline.run_levels(sources, rows, ["x", "y"], {"a": 1.0}, adapt.Booster(trees=3), rounds=(0.2,), known=rows.withColumn("weight", F.lit(1.0)))
    levels = {r["level"]: r["auc"] for r in found.collect()}
    assert list(sorted(levels)) == ["baseline_a", "baseline_c", "ensemble", "level0", "level2", "level2_lsc", "level5", "level55", "level6", "oracle"] and levels["oracle"] > 0.99
