"""Similarity, context and transfer over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.vectors import centroids, dot
from lakeweave.operators import fast_transfer, joins, transfer
from lakeweave.plans.registry import Tables, query

WIDTH = 64


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_MEAN = "[" + ", ".join(f"avg(v[{i}])" for i in range(1, WIDTH + 1)) + "]"
_C = f"c AS (SELECT label AS k, {_MEAN} AS m FROM e GROUP BY 1)"
_COS = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})))"


@query(f"""WITH {_E}, {_C}, s AS (SELECT vec_id, k, round({_COS.format("v", "m")}, 6) AS s FROM e, c)
SELECT vec_id AS left_id, arg_min(k, (-s, k)) AS right_id, max(s) AS similarity FROM s GROUP BY 1 HAVING max(s) >= 0.2""")
def cosine_topk(t: Tables) -> DataFrame:
    v = _vectors(t)
    means = centroids(v, ["label"], "vector", "vector", WIDTH).select(F.col("label").alias("id"), "vector")
    return joins.best_matches(v.select("id", "vector"), means, 0.2)


@query(f"WITH {_E}, {_C} SELECT k AS label, round(sqrt(list_inner_product(m, m)), 6) AS length, (SELECT count(*) FROM e WHERE label = k) AS n FROM c")
def class_centroids(t: Tables) -> DataFrame:
    means = centroids(_vectors(t), ["label"], "vector", "centroid", WIDTH)
    return means.select("label", F.round(F.sqrt(dot("centroid", "centroid")), 6).alias("length"), F.col("rows").alias("n"))


@query(f"""WITH {_E}, m AS (SELECT {_MEAN} AS m FROM e), s AS (SELECT vec_id, label, {_COS.format("v", "m.m")} AS s FROM e, m),
 w AS (SELECT vec_id, label, lag(s) OVER w AS a, lead(s) OVER w AS b FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label AS table_id, vec_id AS pos, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS context FROM w""")
def neighbour_context(t: Tables) -> DataFrame:
    v = _vectors(t)
    mean = centroids(v.withColumn("g", F.lit(1)), ["g"], "vector", "_c", WIDTH).select("_c")
    columns = v.select(F.col("label").alias("table_id"), F.col("id").alias("pos"), "vector").join(F.broadcast(mean))
    return joins.neighbour_context(columns, F.col("_c"))


@query(f"""WITH {_E}, {_C}, q AS (SELECT * FROM e WHERE vec_id % 2 = 0), r AS (SELECT label AS k, {_MEAN} AS m FROM e WHERE vec_id % 2 = 1 GROUP BY 1),
 d AS (SELECT vec_id, sqrt(list_inner_product(list_transform(list_zip(v, m), lambda x: x[1] - x[2]), list_transform(list_zip(v, m), lambda x: x[1] - x[2]))) AS d FROM q, r),
 g AS (SELECT vec_id, list_sort(list(d))[1] AS a, list_sort(list(d))[2] AS b FROM d GROUP BY 1) SELECT round(avg((b - a) / b), 6) AS margin, count(*) AS n FROM g""")
def class_centroid_margin(t: Tables) -> DataFrame:
    v = _vectors(t)
    return transfer.centroid_margin(v.where("id % 2 = 0"), v.where("id % 2 = 1"), "vector", WIDTH)


_MS = "m AS (SELECT " + _MEAN + " AS m, [" + ", ".join(f"stddev_pop(v[{i}])" for i in range(1, WIDTH + 1)) + "] AS s FROM e WHERE vec_id % 2 = 0)"


@query(f"""WITH {_E}, {_MS}, z0 AS (SELECT vec_id, label, [CASE WHEN m.s[i] > 0.01 THEN (v[i] - m.m[i]) / m.s[i] ELSE 0.0 END FOR i IN range(1, {WIDTH + 1})] AS z FROM e, m),
 z AS (SELECT vec_id, label, [x / sqrt(list_inner_product(z, z)) FOR x IN z] AS v FROM z0), c AS (SELECT label AS k, {_MEAN} AS m FROM z WHERE vec_id % 2 = 1 GROUP BY 1),
 s AS (SELECT vec_id, {_COS.format("v", "m")} AS s FROM z, c WHERE vec_id % 2 = 0), g AS (SELECT vec_id, list_sort(list(s), 'DESC') AS l FROM s GROUP BY 1)
SELECT round(avg(l[1] - l[2]), 6) AS margin FROM g""")
def zscore_cosine_pas(t: Tables) -> DataFrame:
    v = _vectors(t)
    return transfer.zscore_cosine_margin(v.where("id % 2 = 0").select("id", "vector"), v.where("id % 2 = 1").select("vector", "label"), WIDTH)


@query(f"""WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
 d AS (SELECT q.vec_id AS id, e.vec_id AS n, e.label AS l, round(sqrt(list_inner_product(list_transform(list_zip(q.v, e.v), lambda x: x[1] - x[2]), list_transform(list_zip(q.v, e.v), lambda x: x[1] - x[2]))), 6) AS d FROM q, e WHERE q.vec_id <> e.vec_id),
 r AS (SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY d, n) AS r FROM d), c AS (SELECT id, l, count(*) AS k FROM r WHERE r <= 10 GROUP BY ALL)
SELECT id, arg_min(l, (-k, l)) AS vote, max(k) AS votes FROM c GROUP BY 1""")
def knn_label_vote(t: Tables) -> DataFrame:
    v = _vectors(t)
    near = joins.nearest(v.where("id % 100 = 0").select("id", "vector"), v.select("id", "vector"), 10)
    votes = near.join(v.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.count(F.lit(1)).alias("k"))
    return votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("k"), F.col("label"))).alias("vote"), F.max("k").alias("votes"))


@query(f"""WITH {_E}, g AS (SELECT {_MEAN} AS m FROM e WHERE label = 0), s AS (SELECT label AS t, vec_id, {_COS.format("v", "g.m")} AS s FROM e, g),
 n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM s WINDOW w AS (PARTITION BY t ORDER BY vec_id)),
 b AS (SELECT t, arg_min(vec_id, (-round(s, 6), vec_id)) AS best, max(round(s, 6)) AS best_s, avg(s) AS mean_s, avg((s > 0.05)::INT) AS share FROM s GROUP BY 1)
SELECT b.t AS table_id, best AS best_id, best_s AS best_similarity, round(mean_s, 6) AS mean_similarity, round(share, 6) AS close_share,
 best_s >= 0.2 AND coalesce(CASE WHEN a IS NULL THEN n.b WHEN n.b IS NULL THEN a ELSE (a + n.b) / 2 END, 0) >= -0.5 AND share >= 0.25 AS passes FROM b JOIN n ON n.vec_id = best""")
def repurpose_gates(t: Tables) -> DataFrame:
    from lakeweave.operators.repurpose import concept_gates

    v = _vectors(t)
    goal = centroids(v.where("label = 0").withColumn("g", F.lit(1)), ["g"], "vector", "_c", WIDTH).select("_c")
    columns = v.select(F.col("label").alias("table_id"), F.col("id").alias("pos"), "vector").join(F.broadcast(goal))
    return concept_gates(columns, F.col("_c"), least_best=0.2, least_context=-0.5, least_share=0.25).select("table_id", F.col("best_pos").alias("best_id"), "best_similarity", "mean_similarity", "close_share", "passes")


@query(None)
def transfer_scores(t: Tables) -> DataFrame:
    v = _vectors(t).select("id", "label", *[F.col("vector")[i].cast("double").alias(f"x{i}") for i in range(WIDTH)])
    sources = v.where("id % 2 = 1").select((F.col("id") % 5).cast("string").alias("table_id"), F.col("id").alias("row_id"), (F.col("label") < 5).cast("int").alias("label"), *[f"x{i}" for i in range(WIDTH)])
    return transfer.source_scores(sources, v.where("id % 2 = 0").withColumnRenamed("id", "row_id"), [f"x{i}" for i in range(WIDTH)])




def _pseudo_sources(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """The odd vectors as five labelled sources, the even ones as the target."""
    names = [f"x{i}" for i in range(WIDTH)]
    v = _vectors(t).select("id", "label", *[F.col("vector")[i].cast("double").alias(f"x{i}") for i in range(WIDTH)])
    sources = v.where("id % 2 = 1").select((F.col("id") % 5).cast("string").alias("table_id"), F.col("id").alias("row_id"), (F.col("label") < 5).cast("int").alias("label"), *names)
    return sources, v.where("id % 2 = 0").withColumnRenamed("id", "row_id"), names


_LOW, _HIGH = ("[" + ", ".join(f"{f}(v[{i}])" for i in range(1, WIDTH + 1)) + "]" for f in ("min", "max"))


@query(f"""WITH {_E}, s AS (SELECT vec_id % 5 AS t, (label < 5)::INT AS y, v FROM e WHERE vec_id % 2 = 1),
 r AS (SELECT t, {_LOW} AS lo, {_HIGH} AS hi, count(*) AS n FROM s GROUP BY t), c AS (SELECT t, y, {_MEAN} AS m FROM s GROUP BY t, y),
 d AS (SELECT vec_id, t, sqrt(list_sum([((v[i] - m[i]) / (hi[i] - lo[i] + 1e-9)) ** 2 FOR i IN range(1, {WIDTH + 1})])) AS d FROM e, c JOIN r USING (t) WHERE vec_id % 2 = 0),
 g AS (SELECT vec_id, t, min(d) AS a, max(d) AS b FROM d GROUP BY ALL)
SELECT t::VARCHAR AS table_id, round(avg((b - a) / (b + 1e-9)), 6) AS pas, any_value(n) AS n_rows FROM g JOIN r USING (t) GROUP BY t""")
def minmax_pas(t: Tables) -> DataFrame:
    sources, target, names = _pseudo_sources(t)
    return fast_transfer.source_scores(sources, target, names).select("table_id", "pas", "n_rows")


@query(None)
def fast_transfer_overall(t: Tables) -> DataFrame:
    sources, target, names = _pseudo_sources(t)
    return fast_transfer.overall(fast_transfer.source_scores(sources, target, names), sources, names)
