"""Joins that enrich a table from others, and matches by name, value and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import lookup_key
from lakeweave.functions.vectors import dot, unit
from lakeweave.operators import order


def lookup(df: DataFrame, column: str, mapping: dict, out: str) -> DataFrame:
    """A value map as a column; null for values without an entry."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, pairs[F.col(column)])


def quantile_edges(df: DataFrame, key: str, bins: int = 8) -> list[float]:
    """Distinct quantile edges of a key (bins + 1 numbers at most)."""
    levels = [i / bins for i in range(bins + 1)]
    found = order.quantile_arrays(df.select(F.col(key).cast("double").alias("value")), [], levels, "q").first()
    edges = found["q"] if found else []
    return sorted(set(edges))


def bin_number(key: Column, edges: Sequence[float]) -> Column:
    """The right-closed bin of a key, the lowest edge included; null outside. A binary search over an array of edges."""
    inner = F.array(*[F.lit(float(e)) for e in edges])
    below = F.size(F.filter(inner, lambda e: e < key))
    return F.when((key >= float(edges[0])) & (key <= float(edges[-1])), F.greatest(below, F.lit(1)) - 1)


def binned_join(target: DataFrame, target_key: str, source: DataFrame, source_key: str, columns: Sequence[str], bins: int = 8, least_coverage: float = 0.45) -> DataFrame | None:
    """``target`` with ``bin`` and the mean of each source column in the target key's bin.

    Bins are quantiles of the source key; a missing target key counts as the source's median. None if fewer than
    ``least_coverage`` of the target rows get a bin. The source is reduced to a row per bin before it meets the target.
    """
    edges = quantile_edges(source, source_key, bins)
    if len(edges) < 2:
        return None
    found = order.median(source, source_key).first()
    middle = found["_m"] if found else None
    means = source.withColumn("bin", bin_number(F.col(source_key), edges)).where("bin is not null").groupBy("bin").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    placed = target.withColumn("bin", bin_number(F.coalesce(F.col(target_key), F.lit(middle)), edges))
    if placed.agg(F.avg(F.col("bin").isNotNull().cast("double"))).first()[0] < least_coverage:
        return None
    return placed.join(F.broadcast(means), "bin", "left")  # a row per bin


def key_join(target: DataFrame, target_key: str, sources: Sequence[tuple[DataFrame, str, Sequence[str]]], groups: tuple[int, int] = (2, 200), least_sources: int = 2, most_columns: int = 8) -> DataFrame:
    """``target`` with columns that are means per key, averaged over the sources that have them.

    A source counts if its key has a number of groups within ``groups``; a column counts if ``least_sources`` have it.
    """
    long = None
    for df, key, columns in sources:
        means = df.groupBy(F.col(key).cast("string").alias("_k")).agg(*[F.avg(c).alias(c) for c in columns])
        if not groups[0] <= means.limit(groups[1] + 1).count() <= groups[1]:
            continue
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
        rows = means.select("_k", F.explode(pairs).alias("p")).select("_k", "p.*")
        long = rows if long is None else long.unionByName(rows)
    if long is None:
        return target
    seen: dict[str, int] = {}
    for _, _, columns in sources:
        for c in columns:
            seen[c] = seen.get(c, 0) + 1
    chosen = sorted(c for c, n in seen.items() if n >= least_sources)[:most_columns]
    wide = long.groupBy("_k").pivot("column", chosen).agg(F.avg("value"))
    wide = wide.select("_k", *[F.col(c).alias(f"key_{c}") for c in chosen])
    return target.join(F.broadcast(wide), F.col(target_key).cast("string") == F.col("_k"), "left").drop("_k")  # groups[1] rows at most


def value_overlaps(values: DataFrame, least: float = 0.5, cardinality: tuple[int, int] = (2, 30)) -> DataFrame:
    """``a, b, jaccard``: columns that share values, from ``column, value``; keys of few distinct values only.

    Columns that share ``least`` of their values share one of the first n - ceil(least n) + 1 of them, rarest first, so
    only columns that meet in those are compared. A value that very many columns have, as "1" or "yes", comes last and
    pairs few; a column is an array of at most ``cardinality`` values, which is then compared as a whole.
    """
    distinct = values.where("value is not null").select("column", lookup_key(F.col("value").cast("string")).alias("v")).distinct()
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(*cardinality))
    kept = distinct.join(sizes, "column")
    often = kept.groupBy("v").agg(F.count(F.lit(1)).alias("f"))
    sets = kept.join(often, "v").groupBy("column", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("vs"))
    first = sets.select("column", "n", F.explode(F.slice("vs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("v"))
    one, two = (first.select(F.col("column").alias(x), "v", F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    near = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")) & (F.col("a") < F.col("b"))
    met = one.join(two, "v").where(near).select("a", "b").distinct()
    both = met.join(sets.select(F.col("column").alias("a"), F.col("vs").alias("x")), "a").join(sets.select(F.col("column").alias("b"), F.col("vs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    jaccard = F.round(shared / (F.size("x") + F.size("y") - shared), 6)
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_name, right_name`` of columns whose names are equal but for case and outer space."""
    a, b = left.select(F.col("name").alias("left_name")), right.select(F.col("name").alias("right_name"))
    return a.join(b, lookup_key("left_name") == lookup_key("right_name"))


def common_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """``name``: the names that both sides have, compared without case and outer space, as the left side writes them."""
    keys = right.select(lookup_key("name").alias("_k")).distinct()
    return left.select("name", lookup_key("name").alias("_k")).join(keys, "_k", "left_semi").select("name").distinct()


def name_density(source: DataFrame, target: DataFrame) -> DataFrame:
    """``table_id, density``: the share of target names that contain, or are part of, one of the table's names.

    Names are few and distinct; the target's (one table's columns) are broadcast.
    """
    a = source.select("table_id", lookup_key("name").alias("a")).distinct()
    b = target.select(lookup_key("name").alias("b")).distinct()
    n = target.select(lookup_key("name")).distinct().count()
    met = a.join(F.broadcast(b), F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a")), "left")
    return met.groupBy("table_id").agg(F.round(F.countDistinct("b") / F.lit(n), 6).alias("density"))


def best_matches(left: DataFrame, right: DataFrame, least: float = -1.0) -> DataFrame:
    """``left_id, right_id, similarity``: for each left vector the nearest right one by cosine (ties: smallest id).

    ``id, vector`` each; the right side is a list of concepts or centroids, whose number is fixed by the caller.
    """
    a = left.select(F.col("id").alias("left_id"), unit("vector").alias("_a"))
    b = right.select(F.col("id").alias("right_id"), unit("vector").alias("_b"))
    sims = a.join(F.broadcast(b)).select("left_id", "right_id", F.round(dot("_a", "_b"), 6).alias("similarity"))
    best = sims.groupBy("left_id").agg(F.min_by("right_id", F.struct(-F.col("similarity"), F.col("right_id"))).alias("right_id"), F.max("similarity").alias("similarity"))
    return best.where(F.col("similarity") >= least)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``id, neighbour, distance, rank``: the k nearest rows of each query, by Euclidean distance, itself left out.

    Blocks of at most some 1,000 queries and 5,000 rows meet as matrices; each pair of blocks gives k candidates a query,
    and the k best of those are the result, so no distance but the candidates' leaves a task.
    """
    import numpy as np
    import pandas as pd

    parts = [max(1, -(-df.count() // size)) for df, size in ((queries, 1000), (rows, 5000))]
    q = queries.select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    held = q.groupBy(F.pmod(F.xxhash64("qid"), F.lit(parts[0])).alias("_q")).agg(F.collect_list(F.struct("qid", "qv")).alias("qs"))
    data = rows.select("id", "vector").groupBy(F.pmod(F.xxhash64("id"), F.lit(parts[1])).alias("_b")).agg(F.collect_list(F.struct("id", "vector")).alias("rs"))

    def blockwise(batches):
        for pdf in batches:
            out = []
            for qs, rs in zip(pdf["qs"], pdf["rs"], strict=True):
                qi, ri = np.array([x["qid"] for x in qs]), np.array([x["id"] for x in rs])
                qv, rv = np.array([x["qv"] for x in qs], float), np.array([x["vector"] for x in rs], float)
                d = np.sqrt(np.maximum(((qv[:, None, :] - rv[None, :, :]) ** 2).sum(2) if qv.shape[0] * rv.size < 20_000_000 else (qv**2).sum(1)[:, None] + (rv**2).sum(1)[None] - 2 * qv @ rv.T, 0))
                d = np.where(qi[:, None] == ri[None, :], np.inf, d).round(6)
                for i, x in enumerate(qi):
                    order = np.lexsort((ri, d[i]))[:k]
                    out += [(int(x), int(ri[j]), float(d[i, j])) for j in order if np.isfinite(d[i, j])]
            yield pd.DataFrame(out, columns=["id", "neighbour", "distance"])

    pairs = held.join(data.hint("shuffle_replicate_nl"))  # blocks x blocks
    found = pairs.select("qs", "rs").mapInPandas(blockwise, "id long, neighbour long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def neighbour_context(columns: DataFrame, centroid: Column) -> DataFrame:
    """``table_id, pos, context``: the mean similarity of a column's left and right neighbours to a centroid."""
    near = columns.withColumn("_s", dot(unit("vector"), unit(centroid)))
    w = Window.partitionBy("table_id").orderBy("pos")
    sides = F.array_compact(F.array(F.lag("_s").over(w), F.lead("_s").over(w)))
    mean = F.try_divide(F.aggregate(sides, F.lit(0.0), lambda s, x: s + x), F.size(sides))
    return near.select("table_id", "pos", F.round(mean, 6).alias("context"))


def not_yet_done(tables: DataFrame, done: DataFrame, key: str = "table_id") -> DataFrame:
    return tables.join(done, key, "left_anti")


def pooled(sources: Sequence[tuple[str, float, DataFrame]], power: float = 1.0) -> DataFrame:
    """All source rows with ``table_id`` and ``weight`` = score^p / sum of score^p over the sources (not over rows)."""
    total = sum(s**power for _, s, _ in sources)
    out = None
    for name, score, df in sources:
        part = df.withColumns({"table_id": F.lit(name), "weight": F.lit(score**power / total)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pool_unlabelled(sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Feature rows of all sources; a missing column or value counts as 0."""
    out = None
    for df in sources:
        part = df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def content_fingerprints(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``table_id, fingerprint``: the sum of the hashes of all rows (with their row_id), independent of column names."""
    return rows.groupBy("table_id").agg(F.sum(F.xxhash64("row_id", *columns).cast("decimal(38,0)")).alias("fingerprint"))


def first_of_equal(fingerprints: DataFrame) -> DataFrame:
    """The first table of each fingerprint."""
    return fingerprints.groupBy("fingerprint").agg(F.min("table_id").alias("table_id")).select("table_id")


def imputed_orphans(sources: DataFrame, orphans: DataFrame, target: DataFrame, features: Sequence[str], penalty: float = 1.0, least_r2: float = 0.10, least_sources: int = 2, most_columns: int = 8, most_rows: int = 10_000) -> DataFrame:
    """``target`` with columns it lacks, as ridge models of several sources predict them from the features.

    ``sources``: table_id, row_id and features; ``orphans``: table_id, row_id, cluster, value (columns of one meaning have
    one cluster). Each (table, cluster) is a model of its own, in standard units of its source; those that explain less
    than ``least_r2`` don't count. A model sees ``most_rows`` rows, a documented bound. Only coefficients leave the groups.
    """
    import numpy as np
    import pandas as pd

    names = list(features)
    order = Window.partitionBy("table_id", "cluster").orderBy(F.xxhash64("row_id"))
    rows = orphans.join(sources, ["table_id", "row_id"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[names].to_numpy(float), pdf["value"].to_numpy(float)
        mean, std = np.nan_to_num(np.nanmean(x, 0)), np.maximum(np.nan_to_num(np.nanstd(x, 0)), 1e-9)
        z = np.nan_to_num((x - mean) / std)
        w = np.linalg.solve(z.T @ z + penalty * np.eye(len(names)), z.T @ (y - y.mean()))
        r2 = 1 - ((y - y.mean() - z @ w) ** 2).sum() / max(1e-12, ((y - y.mean()) ** 2).sum())
        return pd.DataFrame([(pdf["table_id"].iloc[0], pdf["cluster"].iloc[0], float(y.mean()), mean.tolist(), (w / std).tolist(), float(r2))], columns=["table_id", "cluster", "base", "mean", "w", "r2"])

    models = rows.groupBy("table_id", "cluster").applyInPandas(fit, "table_id string, cluster string, base double, mean array<double>, w array<double>, r2 double")
    good = models.where(F.col("r2") >= least_r2).groupBy("cluster").agg(F.collect_list(F.struct("base", "mean", "w")).alias("m"), F.count(F.lit(1)).alias("n"))
    chosen = good.where(F.col("n") >= least_sources).orderBy(F.col("n").desc(), "cluster").limit(most_columns).collect()
    out = target
    for r in chosen:  # most_columns clusters, each a few numbers a source
        guesses = [
            F.lit(m["base"]) + sum((F.coalesce(F.col(c).cast("double") - b, F.lit(0.0)) * w for c, b, w in zip(names, m["mean"], m["w"], strict=True)), F.lit(0.0))
            for m in r["m"]
        ]
        out = out.withColumn(r["cluster"], sum(guesses[1:], guesses[0]) / len(guesses))
    return out
