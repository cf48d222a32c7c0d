"""Single operators over the test tables: pruning, gates, lookups, samples, replies, selection, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import numeric, text
from lakeweave.functions.vectors import blended_with_neighbours, centroids
from lakeweave.operators import adapt, align, distance, evaluate, index, joins, matching, profile, ranking, sampling, transfer
from lakeweave.plans.model_queries import mini_lake
from lakeweave.plans.registry import Tables, query
from lakeweave.plans.vector_queries import _C, _COS, _E, WIDTH
from lakeweave.sources import targets

_UNIFORM = "('0x' || substr(md5({} || '#42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("SELECT event_id, ts, user_id, event_type, value, props, event_id % 10 AS digit FROM events")
def prune_columns(t: Tables) -> DataFrame:
    n = F.col("event_id")
    wide = t.events.withColumns({"digit": n % 10, "constant": F.lit(1), "empty": F.lit(None).cast("double"), "half": F.when(n % 2 == 0, n)})
    return profile.prune_columns(wide)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS custkey, (o_orderstatus = 'F')::INT AS label FROM orders),
 c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM o WHERE custkey IS NOT NULL))
SELECT o_orderkey, o_totalprice, custkey, label, code AS o_orderpriority FROM o JOIN c USING (o_orderpriority) WHERE custkey IS NOT NULL""")
def generic_target(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.when(n % 7 != 0, F.col("o_custkey")).alias("custkey"), F.when(n % 2 == 0, n).alias("sparse"))
    return targets.generic(rows, "o_orderstatus", [" f "])


_CODES = {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS code FROM orders")
def lookup_join(t: Tables) -> DataFrame:
    return joins.lookup(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", _CODES, "code").drop("o_orderpriority")


_MATCHES = [("customer", "nationkey", "a", 0.9), ("customer", "acctbal", "b", 0.6), ("part", "size", "a", 0.3), ("part", "retailprice", "b", 0.8), ("orders", "custkey", "a", 0.7), ("supplier", "acctbal", "b", 0.2)]
_MATCHES_SQL = "m(table_id, src_col, tgt_col, sim) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _MATCHES) + ")"


def _matches(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_MATCHES, "table_id string, src_col string, tgt_col string, sim double")


@query(f"""WITH {_MATCHES_SQL}, c AS (SELECT 'customer' AS table_id, c_custkey AS r, 'nationkey' AS col, c_nationkey::DOUBLE AS v FROM customer UNION ALL SELECT 'customer', c_custkey, 'acctbal', c_acctbal FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, 'nationkey', s_nationkey FROM supplier UNION ALL SELECT 'supplier', s_suppkey, 'acctbal', s_acctbal FROM supplier
 UNION ALL SELECT 'part', p_partkey, 'size', p_size FROM part UNION ALL SELECT 'part', p_partkey, 'retailprice', p_retailprice FROM part
 UNION ALL SELECT 'orders', o_orderkey, 'custkey', o_custkey FROM orders UNION ALL SELECT 'orders', o_orderkey, 'totalprice', o_totalprice FROM orders),
 k AS (SELECT * FROM m WHERE sim >= 0.35), n AS (SELECT table_id, count(*) AS n_matched FROM k GROUP BY 1), r AS (SELECT table_id, count(DISTINCT r) AS n FROM c GROUP BY 1)
SELECT n.table_id, n_matched, round(cells / (r.n * 3), 6) AS coverage FROM n JOIN r USING (table_id) JOIN (SELECT c.table_id, count(*) AS cells FROM c JOIN k ON c.table_id = k.table_id AND c.col = k.src_col WHERE v IS NOT NULL GROUP BY 1) USING (table_id)
WHERE n_matched >= 1 AND round(cells / (r.n * 3), 6) >= 0.3""")
def coverage_gates(t: Tables) -> DataFrame:
    return align.alignment_gates(_matches(t), mini_lake(t), 3, least_columns=1, least_coverage=0.3, least_sim=0.35)


@query("SELECT p_brand AS table_id, round(avg(round(p_size / 50.0, 6)), 6) AS schema_sim FROM part GROUP BY 1")
def schema_similarity(t: Tables) -> DataFrame:
    """Brands as tables whose parts are columns, matched as well as they are large."""
    matches = t.part.select(F.col("p_brand").alias("table_id"), F.col("p_name").alias("src_col"), F.col("p_type").alias("tgt_col"), F.round(F.col("p_size") / 50.0, 6).alias("sim"))
    return matching.schema_similarity(matches)


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 1000.0 WHEN 4 THEN -1000.0 ELSE least(greatest(l_extendedprice, -1000.0), 1000.0) END::DOUBLE AS x FROM lineitem""")
def finite_numbers(t: Tables) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).when(F.col("l_linenumber") == 3, 1e300).when(F.col("l_linenumber") == 4, -1e300)
    return t.lineitem.select("l_orderkey", "l_linenumber", numeric.finite(odd.otherwise(F.col("l_extendedprice")), 1000.0).alias("x"))


_BODY = r"regexp_replace(split_part(reply, '</think>', -1), '```(json)?', '', 'g')"
#: turns as replies, by turn: stated, after a reasoning part and fenced, bare, in words, and as they are
_REPLY_SQL = """CASE turn % 5 WHEN 0 THEN '{"prediction": ' || conv_id % 2 || ', "confidence": 0.' || conv_id % 10 || '}' WHEN 1 THEN '<think>' || t || ' label: 0</think> ```json {"label": ' || conv_id % 2 || ', "probability": 1.7}```'
 WHEN 2 THEN ' ' || conv_id % 3 || ' ' WHEN 3 THEN 'The answer = ' || conv_id % 2 || CASE conv_id % 3 WHEN 0 THEN ' (negative)' ELSE ' positive' END ELSE t END"""


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REPLY_SQL} AS reply FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)), b AS (SELECT *, {_BODY} AS b FROM r)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(b, '(?i)"?(?:prediction|label|answer)"?\s*[:=]\s*"?([01])', 1), ''), nullif(regexp_extract(b, '^\s*([01])\s*$', 1), ''))::INT AS prediction,
 least(greatest(coalesce(try_cast(regexp_extract(reply, '(?i)"?(?:confidence|probability)"?\s*[:=]\s*"?([0-9]*\.?[0-9]+)', 1) AS DOUBLE), 0.5), 0), 1) AS confidence,
 CASE WHEN upper(reply) LIKE '%NEGATIVE%' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS direction FROM b""")
def reply_parsing(t: Tables) -> DataFrame:
    said, c = F.coalesce("text", F.lit("")), F.col("conv_id")
    digit = lambda n: (c % n).cast("string")
    kinds = [
        F.concat(F.lit('{"prediction": '), digit(2), F.lit(', "confidence": 0.'), digit(10), F.lit("}")),
        F.concat(F.lit("<think>"), said, F.lit(' label: 0</think> ```json {"label": '), digit(2), F.lit(', "probability": 1.7}```')),
        F.concat(F.lit(" "), digit(3), F.lit(" ")),
        F.concat(F.lit("The answer = "), digit(2), F.when(c % 3 == 0, " (negative)").otherwise(" positive")),
        said,
    ]
    rows = t.conversations.select("conv_id", "turn", F.element_at(F.array(*kinds), (F.col("turn") % 5 + 1).cast("int")).alias("reply"))
    return rows.select("conv_id", "turn", text.reply_prediction("reply").alias("prediction"), text.reply_confidence("reply").alias("confidence"), text.reply_direction("reply").alias("direction"))


@query(f"""WITH {_E}, {_C}, g AS (SELECT m FROM c WHERE k IN (0, 1)), s AS (SELECT vec_id, max({_COS.format("v", "m")}) AS s FROM e, g GROUP BY 1) SELECT vec_id AS table_id, round(s, 6) AS similarity FROM s WHERE round(s, 6) >= 0.1""")
def semantic_proxy_filter(t: Tables) -> DataFrame:
    proxies = t.embeddings.select(F.col("vec_id").alias("table_id"), F.col("embedding").alias("vector"))
    means = centroids(t.embeddings.select("label", F.col("embedding").alias("vector")), ["label"], "vector", "vector", WIDTH)
    return ranking.semantic_gate(proxies, means.where("label in (0, 1)"), least=0.1)


_SCORED = "d AS (SELECT doc_id, source, quality, round(n_chars / (n_chars + 1500.0::DOUBLE), 4) AS p FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_SCORED}, r AS (SELECT source, quality, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM d),
 a AS (SELECT source, round((sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0), 6) AS self_auc FROM r GROUP BY 1)
SELECT * FROM a WHERE self_auc IS NULL OR self_auc >= 0.6""")
def self_auc_gate(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn("p", F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4))
    return ranking.self_auc_gate(evaluate.auc(rows, "quality", "p", ["source"]).withColumnRenamed("auc", "self_auc"))


@query(f"""WITH {_E}, x AS (SELECT a.label AS t, a.vec_id AS i, a.v AS v, b.vec_id AS j, b.v AS w, round({_COS.format("a.v", "b.v")}, 9) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
 n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j::VARCHAR) <= 3),
 m AS (SELECT t, i, any_value(v) AS v, [{", ".join(f"avg(w[{i}])" for i in range(1, WIDTH + 1))}] AS w FROM n GROUP BY t, i), z AS (SELECT t, i, [0.8 * v[k] + 0.2 * w[k] FOR k IN range(1, {WIDTH + 1})] AS z FROM m)
SELECT t AS table_id, i::VARCHAR AS name, round(z[1] / sqrt(list_inner_product(z, z)), 6) AS first, round(list_sum([k * z[k] FOR k IN range(1, {WIDTH + 1})]) / sqrt(list_inner_product(z, z)), 5) AS moment FROM z""")
def neighbour_blend(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("table_id"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    out = blended_with_neighbours(rows)
    moment = F.aggregate(F.transform("vector", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("table_id", "name", F.round(F.col("vector")[0], 6).alias("first"), F.round(moment, 5).alias("moment"))


_PICKS = 20


@query(f"""WITH RECURSIVE {_E}, b AS (SELECT vec_id AS id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS u, round(list_sum(v) / (sqrt(list_inner_product(v, v)) * sqrt({WIDTH}.0::DOUBLE)) + 1, 6) AS s FROM e),
 r(rank, id, u, s, sim) AS (SELECT 0::BIGINT, id, u, s, NULL::DOUBLE FROM b
  UNION ALL (WITH scored AS (SELECT rank, id, u, s, sim, row_number() OVER (ORDER BY CASE WHEN sim IS NULL THEN 0.7 * s ELSE round(0.7 * s - 0.3 * sim, 12) END DESC, s DESC, id) AS n FROM r)
   SELECT x.rank + 1, x.id, x.u, x.s, greatest(coalesce(x.sim, -2), list_inner_product(x.u, p.u)) FROM scored x, (SELECT u FROM scored WHERE n = 1) p WHERE x.n > 1 AND x.rank < {_PICKS} - 1)),
 w AS (SELECT rank, id, row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN sim IS NULL THEN 0.7 * s ELSE round(0.7 * s - 0.3 * sim, 12) END DESC, s DESC, id) AS n FROM r)
SELECT rank + 1 AS rank, id FROM w WHERE n = 1""")
def mmr_select(t: Tables) -> DataFrame:
    from lakeweave.functions.vectors import cosine

    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    v = v.withColumn("score", F.round(cosine("vector", F.array(*[F.lit(1.0)] * WIDTH)) + 1, 6))
    chosen = ranking.mmr(v, "id", "score", "vector", _PICKS)
    return t.spark.createDataFrame([(i + 1, k) for i, k in enumerate(chosen)], "rank long, id long")


@query(f"""WITH {_SCORED}, g AS (SELECT p, sum(quality)::DOUBLE AS y, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY p) AS i FROM d GROUP BY p),
 c AS (SELECT i, p, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn, y, n FROM g),
 m AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
 l AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS low FROM m),
 f AS (SELECT b AS i, max(low) AS fit FROM l GROUP BY 1) SELECT d.doc_id AS row_id, round(fit, 6) AS p1 FROM d JOIN g ON d.p = g.p JOIN f ON f.i = g.i""")
def isotonic_calibration(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    rows = rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4).alias("p1"))
    return adapt.calibrated(rows.select("row_id", "p1"), rows.select("p1", "label")).select("row_id", F.round("p1", 6).alias("p1"))


_MARKS = 1000


@query(f"""WITH k AS (SELECT least({_MARKS}, count(c_acctbal)) AS n FROM customer), q AS (SELECT unnest(range(n)) AS i, n FROM k),
 s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r, count(*) OVER () AS rows FROM customer WHERE c_acctbal IS NOT NULL),
 m AS (SELECT i, n, i / (n - 1) AS at, lo.v + (hi.v - lo.v) * ((rows.c - 1) * (i / (n - 1)) - floor((rows.c - 1) * (i / (n - 1)))) AS mark FROM q, (SELECT count(*) AS c FROM s) rows
  JOIN s lo ON lo.r = floor((rows.c - 1) * (i / (n - 1))) JOIN s hi ON hi.r = least(rows.c - 1, floor((rows.c - 1) * (i / (n - 1))) + 1)),
 u AS (SELECT c_custkey, c_acctbal AS x, max(CASE WHEN mark <= c_acctbal THEN i END) AS a, min(CASE WHEN mark >= c_acctbal THEN i END) AS b,
  max(CASE WHEN mark = c_acctbal THEN i END) AS ea, min(CASE WHEN mark = c_acctbal THEN i END) AS eb FROM customer, m GROUP BY 1, 2)
SELECT u.c_custkey, round(CASE WHEN ea IS NOT NULL THEN (lo.at + hi.at) / 2 ELSE lo.at + (hi.at - lo.at) * (x - lo.mark) / (hi.mark - lo.mark) END, 6) AS c_acctbal
FROM u JOIN m lo ON lo.i = coalesce(eb, a) JOIN m hi ON hi.i = coalesce(ea, b)""")
def quantile_transform(t: Tables) -> DataFrame:
    from lakeweave.operators.normalize import quantile_transformed

    return quantile_transformed(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))
