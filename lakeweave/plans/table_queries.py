"""Gates, joins, samples and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import numeric
from lakeweave.operators import evaluate, joins, ranking, sampling
from lakeweave.plans.registry import Tables, query


def _scores(t: Tables) -> DataFrame:
    """A score for each nation: its share of the largest mean balance."""
    return t.customer.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("score"))


_SCORES = "s AS (SELECT c_nationkey, round(avg(c_acctbal) / 10000, 6) AS score FROM customer GROUP BY 1)"


@query(f"WITH {_SCORES} SELECT c_nationkey, score FROM s WHERE score >= greatest(0.05, 0.9 * (SELECT max(score) FROM s))")
def score_gate(t: Tables) -> DataFrame:
    return ranking.score_gate(_scores(t), "score", share=0.9)


@query(f"WITH {_SCORES} SELECT c_nationkey, score FROM s WHERE score >= greatest((SELECT quantile_cont(score, 0.5) FROM s) - 0.02, 0.05)")
def median_gap_gate(t: Tables) -> DataFrame:
    return ranking.median_gap_gate(_scores(t), "score", gap=0.02)


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, c_nationkey) AS rank FROM s) SELECT c_nationkey, score, rank FROM r WHERE rank <= 20 AND (rank <= 3 OR score >= 0.95 * (SELECT max(score) FROM s))")
def dynamic_topk(t: Tables) -> DataFrame:
    return ranking.dynamic_top_k(_scores(t), "score", "c_nationkey", share=0.95)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20")
def top_k_sources(t: Tables) -> DataFrame:
    return ranking.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(lang)) ORDER BY doc_id) <= 3")
def cap_per_group(t: Tables) -> DataFrame:
    return ranking.cap_per_group(t.documents.select("doc_id", "lang"), "lang", 3, "doc_id")


@query("""WITH d AS (SELECT doc_id, source, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)),
 g AS (SELECT (CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN quality = 1 THEN 2 ELSE 0 END) + (CASE WHEN toxic = 0 THEN 4 ELSE 0 END) AS m FROM d),
 c AS (SELECT unnest(range(8)) AS c)
SELECT CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'long' WHEN 2 THEN 'quality' WHEN 3 THEN 'long+quality' WHEN 4 THEN 'clean' WHEN 5 THEN 'long+clean' WHEN 6 THEN 'quality+clean' ELSE 'long+quality+clean' END AS combination,
 (SELECT count(*) FROM g WHERE m & c = c) AS n_kept FROM c""")
def filter_power_set(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return ranking.filter_power_set(rows, {"long": F.col("n_chars") >= 1000, "quality": F.col("quality") == 1, "clean": F.col("toxic") == 0})


@query("""WITH d AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text) SELECT doc_id, copies FROM d""")
def content_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


_EDGES = "SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM orders"


@query(f"""WITH e AS ({_EDGES}),
 b AS (SELECT greatest(len([x FOR x IN e.e IF x < o_totalprice]), 1) - 1 AS bin, o_orderkey FROM orders, e),
 m AS (SELECT bin, avg(l_quantity) AS mean_q, avg(l_discount) AS mean_d FROM b JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
 c AS (SELECT c_custkey, c_acctbal * 40 AS k FROM customer),
 p AS (SELECT c_custkey, CASE WHEN k BETWEEN e.e[1] AND e.e[len(e.e)] THEN greatest(len([x FOR x IN e.e IF x < k]), 1) - 1 END AS bin FROM c, e)
SELECT c_custkey, bin::DOUBLE AS bin, round(mean_q, 6) AS mean_l_quantity, round(mean_d, 6) AS mean_l_discount FROM p LEFT JOIN m USING (bin)""")
def binned_join_augment(t: Tables) -> DataFrame:
    edges = joins.quantile_edges(t.orders, "o_totalprice")
    source = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_totalprice", "l_quantity", "l_discount")
    binned = source.withColumn("bin", joins.bin_number(F.col("o_totalprice"), edges)).groupBy("bin").agg(F.avg("l_quantity").alias("mean_l_quantity"), F.avg("l_discount").alias("mean_l_discount"))
    target = t.customer.select("c_custkey", joins.bin_number(F.col("c_acctbal") * 40, edges).alias("bin"))
    out = target.join(F.broadcast(binned), "bin", "left")
    return out.select("c_custkey", F.col("bin").cast("double"), F.round("mean_l_quantity", 6).alias("mean_l_quantity"), F.round("mean_l_discount", 6).alias("mean_l_discount"))


@query("""WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1),
 m AS (SELECT k, avg(v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT n_nationkey, round(v, 6) AS key_acctbal FROM nation LEFT JOIN m ON n_nationkey = k""")
def key_join_augment(t: Tables) -> DataFrame:
    a = t.customer.select("c_nationkey", F.col("c_acctbal").alias("acctbal"))
    b = t.supplier.select("s_nationkey", F.col("s_acctbal").alias("acctbal"))
    out = joins.key_join(t.nation.select("n_nationkey"), "n_nationkey", [(a, "c_nationkey", ["acctbal"]), (b, "s_nationkey", ["acctbal"])])
    return out.select("n_nationkey", F.round("key_acctbal", 6).alias("key_acctbal"))


_VALUES = [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("customer", "c_mktsegment")]


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS c, lower(trim({c}::VARCHAR)) AS v FROM {x}" for x, c in _VALUES) + """),
 n AS (SELECT c, count(*) AS n FROM v GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), k AS (SELECT v.c, v, n FROM v JOIN n USING (c))
SELECT a.c AS a, b.c AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS jaccard FROM k a JOIN k b ON a.v = b.v AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING round(count(*) / (a.n + b.n - count(*)), 6) >= 0.5""")
def value_overlap_join(t: Tables) -> DataFrame:
    values = None
    for table, c in _VALUES:
        one = getattr(t, table).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        values = one if values is None else values.unionByName(one)
    return joins.value_overlaps(values)


@query("""WITH l AS (SELECT DISTINCT upper(p_type) || ' ' AS a FROM part), r AS (SELECT DISTINCT ' ' || p_type AS b FROM part WHERE p_size < 25)
SELECT a AS left_name, b AS right_name FROM l JOIN r ON lower(trim(a)) = lower(trim(b))""")
def name_align(t: Tables) -> DataFrame:
    left = t.part.select(F.concat(F.upper("p_type"), F.lit(" ")).alias("name")).distinct()
    return joins.name_matches(left, t.part.where("p_size < 25").select(F.concat(F.lit(" "), F.col("p_type")).alias("name")).distinct())


@query("""WITH s AS (SELECT DISTINCT p_brand AS table_id, lower(trim(p_type)) AS a FROM part), g AS (SELECT DISTINCT lower(trim(p_type)) AS b FROM part WHERE p_size <= 2)
SELECT table_id, round(count(DISTINCT b) / (SELECT count(*) FROM g), 6) AS density FROM s LEFT JOIN g ON contains(a, b) OR contains(b, a) GROUP BY 1""")
def substring_theta_join(t: Tables) -> DataFrame:
    source = t.part.select(F.col("p_brand").alias("table_id"), F.col("p_type").alias("name")).distinct()
    return joins.name_density(source, t.part.where("p_size <= 2").select(F.col("p_type").alias("name")))


@query("""SELECT o_orderkey, md5(o_orderkey::VARCHAR || '#42') AS h FROM orders ORDER BY h, o_orderkey LIMIT 100""")
def hash_sample(t: Tables) -> DataFrame:
    return sampling.hash_sample(t.orders.select("o_orderkey"), "o_orderkey", 100).withColumn("h", sampling.seeded("o_orderkey"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % ceil((SELECT count(*) FROM documents) / 100)::BIGINT = 0")
def stride_sample(t: Tables) -> DataFrame:
    return sampling.stride_sample(t.documents.select("doc_id", "n_chars"), "doc_id", 100)


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality FROM r WHERE r <= round(n * 0.2)""")
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.labels.select("doc_id", "quality"), "quality", "doc_id", 0.2)


@query("""WITH r AS (SELECT c_custkey, (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () AS p FROM customer) SELECT c_custkey, (p >= 0.5)::INT AS label FROM r""")
def pct_rank_binarize(t: Tables) -> DataFrame:
    return ranking.percent_rank_label(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "label")


@query("""WITH b AS (SELECT event_id, value, ntile(10) OVER (ORDER BY ts, event_id) AS b FROM events), g AS (SELECT b, count(*) AS n, sum(value) AS s FROM b GROUP BY 1)
SELECT b AS batch, (sum(n) OVER w)::BIGINT AS n_seen, round(sum(s) OVER w / sum(n) OVER w, 4) AS mean_value FROM g WINDOW w AS (ORDER BY b ROWS UNBOUNDED PRECEDING)""")
def cumulative_arrivals(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = ranking.cumulative_batches(t.events.select("event_id", "ts", "value"), ["ts", "event_id"])
    up = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return sums.select("batch", F.sum("n").over(up).alias("n_seen"), F.round(F.sum("s").over(up) / F.sum("n").over(up), 4).alias("mean_value"))


def _scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    return docs.withColumn("p", F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4))


_SCORED = "d AS (SELECT doc_id, lang, source, n_chars, quality, toxic, round(n_chars / (n_chars + 1500.0::DOUBLE), 4) AS p FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_SCORED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM d)
SELECT lang, round((sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)), 6) AS auc FROM r GROUP BY 1""")
def auc_rank_sum(t: Tables) -> DataFrame:
    return evaluate.auc(_scored(t), "quality", "p", ["lang"])


@query(f"""WITH {_SCORED}, c AS (SELECT lang, quality AS y, (p >= 0.5)::INT AS h FROM d)
SELECT lang, round(avg((y = h)::INT), 6) AS accuracy, round(coalesce(2.0 * sum((y = 1 AND h = 1)::INT) / nullif(2.0 * sum((y = 1 AND h = 1)::INT) + sum((y <> h)::INT), 0), 0), 6) AS f1 FROM c GROUP BY 1""")
def f1_accuracy(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("h", (F.col("p") >= 0.5).cast("int"))
    return rows.groupBy("lang").agg(*[v.alias(k) for k, v in evaluate.confusion("quality", "h").items()])


@query(f"""WITH {_SCORED}, g AS (SELECT lang, p, count(*) AS n FROM d GROUP BY ALL), a AS (SELECT lang, p, sum(n) OVER (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY lang) AS s FROM g)
SELECT lang, max(p) AS threshold FROM a WHERE s > 0.3 GROUP BY 1""")
def prior_threshold(t: Tables) -> DataFrame:
    return evaluate.prior_threshold(_scored(t), "p", 0.3, ["lang"])


@query(f"""WITH {_SCORED}, m AS (SELECT lang, round(avg((quality = (p >= 0.5)::INT)::INT), 6) AS accuracy FROM d GROUP BY 1)
SELECT 'accuracy' AS metric, max(CASE WHEN lang = 'de' THEN a END) AS de, max(CASE WHEN lang = 'en' THEN a END) AS en, max(CASE WHEN lang = 'es' THEN a END) AS es, max(CASE WHEN lang = 'fr' THEN a END) AS fr
FROM (SELECT lang, round(accuracy - (SELECT accuracy FROM m WHERE lang = 'en'), 6) AS a FROM m)""")
def metrics_delta_pivot(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("h", (F.col("p") >= 0.5).cast("int"))
    metrics = rows.groupBy("lang").agg(evaluate.confusion("quality", "h")["accuracy"].alias("accuracy"))
    deltas = evaluate.with_deltas(metrics, "en", ["accuracy"], "lang").withColumn("metric", F.lit("accuracy"))
    return evaluate.pivot(deltas, "metric", "lang", ["de", "en", "es", "fr"], "accuracy_delta")


@query(f"""WITH {_SCORED}, m AS (SELECT source, lang, round(avg((quality = (p >= 0.5)::INT)::INT), 6) AS a FROM d GROUP BY ALL),
 b AS (SELECT source, arg_min(lang, (-a, lang)) AS best, max(a) AS best_value, min(a) AS base FROM m GROUP BY 1)
SELECT source, best, best_value, round(CASE WHEN abs(1.0 - base) >= 1e-6 THEN (best_value - base) / (1.0 - base) END, 6) AS closed FROM b""")
def gap_closed_argmax(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("h", (F.col("p") >= 0.5).cast("int"))
    metrics = rows.groupBy("source", "lang").agg(evaluate.confusion("quality", "h")["accuracy"].alias("a"))
    best = evaluate.best_row(metrics, ["source"], "lang", "a").join(metrics.groupBy("source").agg(F.min("a").alias("base")), "source")
    return best.select("source", "best", "best_value", F.round(evaluate.gap_closed("best_value", "base", F.lit(1.0)), 6).alias("closed"))


@query(f"""WITH {_SCORED}, m AS (SELECT source, lang, avg(p) AS p FROM d GROUP BY ALL) SELECT source, round(avg(p), 6) AS p_mean, round(stddev_pop(p), 6) AS p_std FROM m GROUP BY 1""")
def seed_summary(t: Tables) -> DataFrame:
    return evaluate.over_seeds(_scored(t).groupBy("source", "lang").agg(F.avg("p").alias("p")), ["source"], ["p"])


@query("""SELECT table_id, round(weight, 6) AS weight, count(*) AS n, round(avg(acctbal), 6) AS mean FROM (
 SELECT 'customer' AS table_id, 0.8 * 0.8 / (0.8 * 0.8 + 0.4 * 0.4) AS weight, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', 0.4 * 0.4 / (0.8 * 0.8 + 0.4 * 0.4), s_acctbal FROM supplier) GROUP BY ALL""")
def pooled_weights(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_acctbal").alias("acctbal")), t.supplier.select(F.col("s_acctbal").alias("acctbal"))
    rows = joins.pooled([("customer", 0.8, a), ("supplier", 0.4, b)], power=2.0)
    return rows.groupBy("table_id", F.round("weight", 6).alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("acctbal"), 6).alias("mean"))


@query("""WITH e AS (SELECT event_type, value, 1 + user_id % 3 AS w FROM events), g AS (SELECT event_type, value, sum(w) AS w FROM e GROUP BY ALL),
 c AS (SELECT event_type, value, sum(w) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY event_type) AS t FROM g)
SELECT event_type, min(value) AS weighted_median FROM c WHERE c >= 0.5 * t - 1e-12 GROUP BY 1""")
def weighted_median(t: Tables) -> DataFrame:
    rows = t.events.withColumn("w", 1 + F.col("user_id") % 3)
    return ranking.weighted_median(rows, ["event_type"], "value", "w")


@query("""WITH e AS (SELECT event_id, event_type, value, count(*) OVER () AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM e)
SELECT event_id, event_type FROM r WHERE r <= greatest(5, floor(n * 0.01 / 2))""")
def class_balanced_topn(t: Tables) -> DataFrame:
    return ranking.balanced_top(t.events.select("event_id", "event_type", "value"), "event_type", "value", 0.01, "event_id").select("event_id", "event_type")


@query("""WITH t AS (SELECT r_regionkey FROM region), d AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) AND c_nationkey NOT IN (SELECT n_nationkey FROM d)""")
def semi_anti_join(t: Tables) -> DataFrame:
    known = t.customer.select("c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return joins.not_yet_done(known, t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@query("""SELECT n_regionkey, round(ln(1 + count(DISTINCT c_custkey)) / ln(1 + (SELECT count(*) FROM customer)), 6) AS yield FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def log_ratio_yield(t: Tables) -> DataFrame:
    n = t.customer.agg(F.count(F.lit(1)).alias("of"))
    found = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.countDistinct("c_custkey").alias("n"))
    return found.join(F.broadcast(n)).select("n_regionkey", F.round(numeric.log_yield("n", "of"), 6).alias("yield"))
