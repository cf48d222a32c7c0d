"""Vectors as arrays: products, norms, similarities as expressions; centroids as aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.numeric import col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; zeros stay."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    parts = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def outer(a: Column | str, b: Column | str) -> Column:
    """The products of all elements, flattened."""
    return F.flatten(F.transform(col(a), lambda x: F.transform(col(b), lambda y: x * y)))


def centroids(df: DataFrame, by: list[str], vector: str = "embedding", name: str = "centroid", width: int | None = None) -> DataFrame:
    """The mean vector of each group, element by element.

    With ``width`` it is one aggregation with a mean per element (map-side, no explosion of the rows).
    """
    if width:
        means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(width)])
        return df.groupBy(*by).agg(means.alias(name), F.count(F.lit(1)).alias("rows"))
    each = df.select(*by, F.posexplode(vector).alias("_i", "_x"))
    means = each.groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda x: x["_m"]).alias(name), F.max("_n").alias("rows"))


#: vectors of a group that a task holds as one matrix
HELD = 2000


def nearest_in_group(vectors: DataFrame, k: int, by: str = "table_id", name: str = "name", vector: str = "vector") -> DataFrame:
    """``by, name, _near``: for each vector the ``k`` most similar others of its group by cosine (to 9 digits; ties go to
    the first name), as (s, n, w): less the similarity, name, vector. Vectors without others are absent.

    A task holds HELD vectors of a group as a matrix and multiplies the group's vectors with it, a batch at a time; ``k``
    of each batch leave it. A group of any size is dealt in such parts.
    """
    own = vectors.select(F.col(by).alias("g"), F.col(name).alias("n"), F.col(vector).cast("array<double>").alias("v")).dropna()
    large = own.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("parts")).where("parts > 1")
    placed = own.join(large, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = placed.select("g", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "n", "v")
    asked = placed.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "n", "v")
    dealt = held.unionByName(asked).repartition("g", "part").sortWithinPartitions("g", "part", "role", "n")

    def run(batches):
        place, names, rows, matrix, at = None, [], [], None, {}
        for pdf in batches:
            out = []
            for (g, part, role), own in pdf.groupby(["g", "part", "role"], sort=False):
                if (g, part) != place:
                    place, names, rows, matrix = (g, part), [], [], None
                if role == 0:
                    names += own["n"].tolist()
                    rows += own["v"].tolist()
                    continue
                if matrix is None:
                    matrix = _units(np.array(rows, float)) if rows else np.empty((0, 0))
                    at = {}
                    for i, n in enumerate(names):
                        at.setdefault(n, []).append(i)  # names may repeat
                if not names:
                    continue
                s = np.round(_units(np.array(own["v"].tolist(), float)) @ matrix.T, 9)
                for i, n in enumerate(own["n"].tolist()):
                    if n in at:
                        s[i, at[n]] = -np.inf
                    few = np.flatnonzero(s[i] >= np.partition(s[i], -k)[-k]) if len(names) > k else np.arange(len(names))
                    best = sorted(((-s[i, j], names[j], rows[j]) for j in few if s[i, j] > -np.inf), key=lambda x: x[:2])[:k]
                    if best:
                        out.append((g, n, [{"s": float(a), "n": b, "w": w} for a, b, w in best]))
            yield pd.DataFrame(out, columns=["g", "n", "near"])

    kinds = [own.schema[c].dataType.simpleString() for c in ("g", "n")]
    found = dealt.mapInPandas(run, f"g {kinds[0]}, n {kinds[1]}, near array<struct<s:double,n:{kinds[1]},w:array<double>>>")
    met = found.groupBy("g", "n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("_near"))
    return met.select(F.col("g").alias(by), F.col("n").alias(name), "_near")


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=rows.copy(), where=length > 0)


def blended_with_neighbours(vectors: DataFrame, k: int = 3, alpha: float = 0.2) -> DataFrame:
    """``table_id, name, vector``: each column's vector drawn to the mean of its table's ``k`` nearest others, of length 1.

    (1 - alpha) own + alpha mean, so that a name takes on what its table is about. A column without others stays as it is.
    """
    own = vectors.select("table_id", "name", F.col("vector").cast("array<double>").alias("_v"))
    both = own.join(nearest_in_group(vectors, k), ["table_id", "name"], "left")
    width = F.size("_v")
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(F.col("_near"), F.lit(0.0), lambda a, x: a + x["w"][i]) / F.size("_near"))
    mixed = F.zip_with("_v", mean, lambda a, b: (1 - alpha) * a + alpha * b)
    return both.select("table_id", "name", F.when(F.col("_near").isNull(), F.col("_v")).otherwise(unit(mixed)).alias("vector"))
