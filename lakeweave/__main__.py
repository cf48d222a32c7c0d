"""``python -m lakeweave run|sweep``: an experiment over a lake's folder and a target file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeweave.plans import experiments
from lakeweave.plans.pipeline import Experiment
from lakeweave.sources import lake, store, targets


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lakeweave", description=__doc__)
    parser.add_argument("command", choices=("run", "sweep"))
    parser.add_argument("--lake", required=True, help="folder of CSV, Parquet and zip files")
    parser.add_argument("--target", required=True, help="the target's file")
    parser.add_argument("--loader", help=f"how the target is read: {', '.join(sorted(targets.LOADERS))}")
    parser.add_argument("--label", required=True, help="the label's name (its column, without a loader)")
    parser.add_argument("--concepts", nargs="*", default=[], help="more names of the label's concept")
    parser.add_argument("--directions", help="CSV of col and direction (POSITIVE or NEGATIVE): what proxies say of the label")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--k", type=int, default=20)
    parser.add_argument("--threshold", type=float, default=0.70)
    parser.add_argument("--sizes", nargs="*", type=int, default=[], help="lake sizes of a sweep")
    parser.add_argument("--trees", type=int, default=200)
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    spark = SparkSession.builder.appName("lakeweave").getOrCreate()
    from lakeweave.operators import adapt

    raw = targets.load(spark, a.loader, a.target) if a.loader else targets.generic(targets._read(spark, a.target), a.label)
    target = adapt.cut(raw.select(F.monotonically_increasing_id().alias("row_id"), "*"))
    features = [c for c in target.columns if c not in ("row_id", "label")]
    cells = adapt.cut(lake.read_directory(spark, a.lake, with_text=True))
    manifest = adapt.cut(lake.manifest_of(cells))
    e = Experiment(a.label, (a.label, *a.concepts), k=a.k, concept=a.threshold, booster=adapt.Booster(trees=a.trees))
    if a.command == "run":
        directions = lake.read_csv(spark, a.directions, "col string, direction string") if a.directions else None
        out = experiments.run(spark, manifest, cells, target, features, e, directions=directions)
        for name in ("lake", "scores", "matches", "metrics"):
            store.save(out[name], f"{a.out}/{name}", "csv")
    else:
        store.save(experiments.scalability(spark, f"{a.out}/stages", manifest, cells, {a.label: (target, features, e)}, a.sizes), f"{a.out}/scalability", "csv")


if __name__ == "__main__":
    main()
