"""Matching, weighting and adaptation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.numeric import entropy
from lakeweave.operators import adapt, align, joins, matching, neural, order, repurpose
from lakeweave.plans.registry import Tables, query
from lakeweave.plans.vector_queries import WIDTH
from lakeweave.sources import lake

_TABLES = {"customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"]}
_BOOSTER = adapt.Booster()


_DECILES = [i / 10 for i in range(11)]
_DECILES_SQL = "[" + ", ".join(str(x) for x in _DECILES) + "]"
_LAKE_SQL = """c AS (SELECT 'customer' AS table_id, 'nationkey' AS col, c_nationkey::DOUBLE AS v FROM customer UNION ALL SELECT 'customer', 'acctbal', c_acctbal FROM customer
 UNION ALL SELECT 'supplier', 'nationkey', s_nationkey FROM supplier UNION ALL SELECT 'supplier', 'acctbal', s_acctbal FROM supplier
 UNION ALL SELECT 'part', 'size', p_size FROM part UNION ALL SELECT 'part', 'retailprice', p_retailprice FROM part
 UNION ALL SELECT 'orders', 'custkey', o_custkey FROM orders UNION ALL SELECT 'orders', 'totalprice', o_totalprice FROM orders)"""
_DECILE_COS = "round(list_inner_product(a.q, b.q) / sqrt(list_inner_product(a.q, a.q) * list_inner_product(b.q, b.q)), 6)"


def _described(cells: DataFrame) -> DataFrame:
    """``table_id, name, is_num, vector``: columns by the deciles of their values, or of the lengths of their words."""
    text = F.length("text") if "text" in cells.columns else F.lit(None)
    values = cells.select("table_id", "col", F.coalesce("value", text).cast("double").alias("value"))
    deciles = order.quantile_arrays(values, ["table_id", "col"], _DECILES, "vector")
    return deciles.join(lake.column_types(cells), ["table_id", "col"]).select("table_id", F.col("col").alias("name"), "is_num", "vector")


@query(f"""WITH {_LAKE_SQL}, d AS (SELECT table_id, col, quantile_cont(v, {_DECILES_SQL}) AS q FROM c GROUP BY ALL),
 s AS (SELECT a.table_id, a.col AS src_col, b.col AS tgt_col, {_DECILE_COS} AS sim, list_inner_product(a.q, b.q) / sqrt(list_inner_product(a.q, a.q) * list_inner_product(b.q, b.q)) AS x
    FROM d a, d b WHERE a.table_id <> 'supplier' AND b.table_id = 'supplier'),
 p AS (SELECT x.table_id, x.src_col AS a1, x.tgt_col AS b1, y.src_col AS a2, y.tgt_col AS b2, x.sim AS s1, y.sim AS s2, x.x + y.x AS total FROM s x JOIN s y ON x.table_id = y.table_id AND x.src_col < y.src_col AND x.tgt_col <> y.tgt_col),
 w AS (SELECT table_id, arg_max([{{'s': a1, 't': b1, 'v': s1}}, {{'s': a2, 't': b2, 'v': s2}}], total) AS m FROM p GROUP BY 1), u AS (SELECT table_id, unnest(m) AS m FROM w)
SELECT table_id, m.s AS src_col, m.t AS tgt_col, m.v AS sim FROM u""")
def hungarian_align(t: Tables) -> DataFrame:
    """Columns of three tables, matched to the supplier's by what they hold."""
    columns = adapt.cut(_described(mini_lake(t)))
    return matching.match_columns(columns.where("table_id <> 'supplier'"), columns.where("table_id = 'supplier'").drop("table_id"), typed=False)


@query(f"""WITH c AS (SELECT 'customer' AS table_id, 'c_mktsegment' AS col, length(c_mktsegment)::DOUBLE AS v, false AS is_num FROM customer UNION ALL SELECT 'customer', 'c_acctbal', c_acctbal, true FROM customer
 UNION ALL SELECT 'orders', 'o_orderstatus', length(o_orderstatus), false FROM orders UNION ALL SELECT 'orders', 'o_totalprice', o_totalprice, true FROM orders
 UNION ALL SELECT 'part', 'p_name', length(p_name), false FROM part UNION ALL SELECT 'part', 'p_size', p_size, true FROM part),
 d AS (SELECT table_id, col, is_num, quantile_cont(v, {_DECILES_SQL}) AS q FROM c WHERE v IS NOT NULL GROUP BY ALL)
SELECT a.table_id, a.col AS src_col, b.col AS tgt_col, {_DECILE_COS} AS sim FROM d a JOIN d b ON a.is_num = b.is_num WHERE a.table_id <> 'part' AND b.table_id = 'part'""")
def type_gated_align(t: Tables) -> DataFrame:
    """Numbers meet numbers and words meet words, whatever else they are near to."""
    cells = None
    for name in ("customer", "orders", "part"):
        one = lake.to_cells(getattr(t, name), name, *_WORDS[name], with_text=True)
        cells = one if cells is None else cells.unionByName(one)
    columns = adapt.cut(_described(cells))
    return matching.match_columns(columns.where("table_id <> 'part'"), columns.where("table_id = 'part'").drop("table_id"), typed=True)


def _scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    return docs.select(F.col("doc_id").alias("row_id"), "source", F.col("quality").alias("label"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4).alias("p1"))


_SCORED = "d AS (SELECT doc_id AS row_id, source, quality AS label, round(n_chars / (n_chars + 1500.0::DOUBLE), 4) AS p1 FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_SCORED}, s AS (SELECT least(greatest(avg(p1), 0.05), 0.95) AS q, least(greatest(avg(label), 0.05), 0.95) AS prior FROM d),
 w AS (SELECT row_id, (1 + row_id % 3) * CASE WHEN label = 1 THEN least(greatest(q / prior, 0.2), 5.0) ELSE least(greatest((1 - q) / (1 - prior), 0.2), 5.0) END AS w FROM d, s)
SELECT row_id, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def label_shift_weights(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn("weight", (1 + F.col("row_id") % 3).cast("double"))
    return adapt.label_shift_weights(rows, rows).select("row_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_SCORED}, o AS (SELECT *, CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END AS own FROM d)
SELECT row_id, CASE WHEN own < avg(own) OVER (PARTITION BY label) THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM o""")
def confident_denoise(t: Tables) -> DataFrame:
    return adapt.confident_weights(_scored(t).withColumn("weight", F.lit(1.0))).select("row_id", F.round("weight", 6).alias("weight"))


_H = "-(x * ln(x) + (1 - x) * ln(1 - x))"


@query(f"""WITH {_SCORED}, a AS (SELECT row_id, p1 AS p, round(p1 * p1, 6) AS q FROM d),
 h AS (SELECT avg({_H.replace("x", "least(greatest(p, 1e-9), 1 - 1e-9)")}) AS a, avg({_H.replace("x", "least(greatest(q, 1e-9), 1 - 1e-9)")}) AS b FROM a),
 w AS (SELECT greatest(0.3, b / (a + b + 1e-12)) AS w FROM h)
SELECT row_id, round((1 - w) * p + w * q, 6) AS p1 FROM a, w""")
def ensemble_entropy(t: Tables) -> DataFrame:
    a = _scored(t).select("row_id", "p1")
    b = a.select("row_id", F.round(F.col("p1") * F.col("p1"), 6).alias("p1"))
    return adapt.ensemble(a, b).select("row_id", F.round("p1", 6).alias("p1"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, count(*) AS n, round(avg(c_acctbal) / 10000, 6) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, round(sum(n) / (sum(n) + sum(s * least(n, 1000))), 6) AS alpha FROM n GROUP BY 1""")
def blend_weight(t: Tables) -> DataFrame:
    n = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal") / 10000, 6).alias("s"))
    sums = n.groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.least(F.col("n"), F.lit(1000))).alias("e"))
    return sums.select("n_regionkey", F.round(adapt.blend_weight(F.col("n"), F.col("e")), 6).alias("alpha"))


@query(f"""WITH {_SCORED} SELECT row_id, round(-(p1 * ln(p1) + (1 - p1) * ln(1 - p1)), 6) AS h FROM d WHERE p1 > 0.0001 AND p1 < 0.9999""")
def prediction_entropy(t: Tables) -> DataFrame:
    return _scored(t).where("p1 > 0.0001 and p1 < 0.9999").select("row_id", F.round(entropy("p1"), 6).alias("h"))


_FINGERPRINTS = """WITH c AS (SELECT 'a' AS t, n_nationkey AS r, n_regionkey AS v FROM nation UNION ALL SELECT 'b', n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c', n_nationkey, n_regionkey + 1 FROM nation),
 l AS (SELECT t, string_agg(r || ':' || v, ',' ORDER BY r) AS s FROM c GROUP BY 1) SELECT min(t) AS table_id FROM l GROUP BY s"""


@query(_FINGERPRINTS)
def table_fingerprint_dedup(t: Tables) -> DataFrame:
    one = t.nation.select(F.col("n_nationkey").alias("row_id"), F.col("n_regionkey").alias("v"))
    rows = one.withColumn("table_id", F.lit("a")).unionByName(one.withColumn("table_id", F.lit("b"))).unionByName(one.withColumns({"table_id": F.lit("c"), "v": F.col("v") + 1}))
    return joins.first_of_equal(joins.content_fingerprints(rows, ["v"]))


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_id, o_orderkey::DOUBLE AS k, o_totalprice::DOUBLE AS p, (o_orderkey % 3)::DOUBLE AS s FROM orders),
 c AS (SELECT table_id, row_id, 'key' AS col, k AS value FROM o UNION ALL SELECT table_id, row_id, 'price', p FROM o UNION ALL SELECT table_id, row_id, 'price_1', s FROM o WHERE s > 0),
 v AS (SELECT table_id, col FROM c GROUP BY ALL HAVING min(value) < max(value))
SELECT table_id, row_id, col, value FROM c JOIN v USING (table_id, col)""")
def nested_table_parse(t: Tables) -> DataFrame:
    """Each customer's orders as a table of text: repeated and empty headers, thousands separators, per cent signs, words."""
    share = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit("%")))
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.format_number("o_totalprice", 2), share, F.lit(""))
    rows = t.orders.groupBy(F.col("o_custkey").cast("string").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    header = F.array(*[F.lit(h) for h in ("key", "priority", "price", "price", "")])
    return lake.parse_nested(rows.select("table_id", F.concat(F.array(header), "rows").alias("rows"))).select("table_id", "row_id", "col", "value")


def mini_lake(t: Tables) -> DataFrame:
    """Cells of the numeric columns of four tables, named without their prefix."""
    out = None
    for name, columns in _TABLES.items():
        df = getattr(t, name).select(F.col(columns[0]).alias("row_id"), *[F.col(c).alias(c.split("_", 1)[1]) for c in columns[1:]])
        cells = lake.to_cells(df, name, "row_id", [c.split("_", 1)[1] for c in columns[1:]])
        out = cells if out is None else out.unionByName(cells)
    return out


@query("""SELECT table_id, count(DISTINCT row_id) AS n_rows, count(DISTINCT col) AS n_cols, count(*) AS n_cells FROM (
 SELECT 'customer' AS table_id, c_custkey AS row_id, 'nationkey' AS col FROM customer UNION ALL SELECT 'customer', c_custkey, 'acctbal' FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, 'nationkey' FROM supplier UNION ALL SELECT 'supplier', s_suppkey, 'acctbal' FROM supplier
 UNION ALL SELECT 'part', p_partkey, 'size' FROM part UNION ALL SELECT 'part', p_partkey, 'retailprice' FROM part
 UNION ALL SELECT 'orders', o_orderkey, 'custkey' FROM orders UNION ALL SELECT 'orders', o_orderkey, 'totalprice' FROM orders) GROUP BY 1""")
def lake_cells(t: Tables) -> DataFrame:
    return mini_lake(t).groupBy("table_id").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col").alias("n_cols"), F.count(F.lit(1)).alias("n_cells"))


_WORDS = {"customer": ("c_custkey", ["c_mktsegment", "c_acctbal"]), "orders": ("o_orderkey", ["o_orderstatus", "o_totalprice"]), "lineitem": ("l_orderkey", ["l_returnflag", "l_quantity"]), "part": ("p_partkey", ["p_name", "p_size"])}
_PROXIES = [("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("part", "p_name")]


@query("""WITH c AS (SELECT 'customer' AS table_id, 'c_mktsegment' AS proxy_col, c_mktsegment AS text, (c_mktsegment = 'BUILDING')::INT AS label, 'POSITIVE' AS direction FROM customer
 UNION ALL SELECT 'orders', 'o_orderstatus', o_orderstatus, (o_orderstatus <> 'F')::INT, 'NEGATIVE' FROM orders
 UNION ALL SELECT 'lineitem', 'l_returnflag', l_returnflag, NULL, 'POSITIVE' FROM lineitem
 UNION ALL SELECT 'part', 'p_name', p_name, NULL, 'POSITIVE' FROM part),
 s AS (SELECT table_id, proxy_col, direction, count(*) AS n_rows, round(avg(label), 6) AS positive_rate, count(DISTINCT text) AS d, count(label) AS told FROM c WHERE text IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, CASE WHEN d > 15 THEN 'high_cardinality' WHEN told = 0 THEN 'cat_no_mapping' WHEN d < 2 THEN 'no_variance' WHEN positive_rate NOT BETWEEN 0.03 AND 0.90 THEN 'extreme_pos_rate' ELSE '' END AS reason FROM s)
SELECT table_id, proxy_col, direction, CASE WHEN told > 0 THEN 'categorical_semantic' END AS method, n_rows, positive_rate, reason = '' AS kept, reason FROM r""")
def text_proxy_labels(t: Tables) -> DataFrame:
    """Proxy columns of words, labelled by what their words are near to."""
    cells = None
    for name, (key, columns) in _WORDS.items():
        one = lake.to_cells(getattr(t, name), name, key, columns, with_text=True)
        cells = one if cells is None else cells.unionByName(one)
    encoder = matching.HashedNgramEncoder()
    cells = adapt.cut(cells)
    proxies = t.spark.createDataFrame(_PROXIES, "table_id string, proxy_col string")
    directions = t.spark.createDataFrame([("O_ORDERSTATUS", "negative")], "col string, direction string")
    concepts = matching.encode_names(t.spark.createDataFrame([("building",), ("f",)], "name string"), encoder)
    categories = adapt.cut(repurpose.category_labels(cells, proxies, directions, encoder, concepts))
    out = repurpose.labelled_lake(cells, proxies, directions, categories=categories)
    return out.select("table_id", "proxy_col", "direction", "method", "n_rows", "positive_rate", "kept", "reason")


@query("""WITH c AS (SELECT 'customer' AS table_id, 'c_mktsegment' AS col, count(c_mktsegment) AS n, false AS is_num FROM customer UNION ALL SELECT 'customer', 'c_acctbal', count(c_acctbal), true FROM customer
 UNION ALL SELECT 'orders', 'o_orderstatus', count(o_orderstatus), false FROM orders UNION ALL SELECT 'orders', 'o_totalprice', count(o_totalprice), true FROM orders)
SELECT table_id, col, is_num FROM c WHERE n > 0""")
def column_types(t: Tables) -> DataFrame:
    one, two = (lake.to_cells(getattr(t, n), n, *_WORDS[n], with_text=True) for n in ("customer", "orders"))
    return lake.column_types(one.unionByName(two))


@query("""SELECT c_custkey AS row_id, c_nationkey::DOUBLE AS nationkey, c_acctbal AS acctbal FROM customer""")
def align_projection(t: Tables) -> DataFrame:
    matches = t.spark.createDataFrame([("customer", "nationkey", "nationkey", 1.0), ("customer", "acctbal", "acctbal", 1.0)], "table_id string, src_col string, tgt_col string, sim double")
    return align.align_tables(mini_lake(t), matches, ["nationkey", "acctbal"]).drop("table_id")


_GENERIC = "CASE p_brand[-1:] WHEN '1' THEN ' Label ' WHEN '2' THEN 'BinaryClass' ELSE min(p_type) END"


@query(f"""WITH p AS (SELECT p_brand AS table_id, round(avg(p_size) / 50, 6) AS schema_sim, round(min(p_size) / 50.0, 6) AS dist_sim, round(max(p_size) / 50.0, 6) AS label_sim, {_GENERIC} AS label_name, round(avg((p_size > 25)::INT), 6) AS positive_rate FROM part GROUP BY p_brand),
 s AS (SELECT table_id, round((0.6 * (0.7 * schema_sim + 0.3 * dist_sim) + 0.4 * CASE WHEN lower(trim(label_name)) IN ('label','class','target','y','binaryclass','labels','classes','targets') THEN 0 ELSE label_sim END) * greatest(0, 1 - 0.15 * abs(positive_rate - 0.4)), 6)::DOUBLE AS discovery_score FROM p)
SELECT * FROM s WHERE discovery_score >= 0.3""")
def discovery_score(t: Tables) -> DataFrame:
    """Brands as sources, with scores made of their parts' sizes; some have labels that say nothing."""
    last = F.substring("table_id", -1, 1)
    size = F.col("p_size").cast("double")
    parts = t.part.groupBy(F.col("p_brand").alias("table_id")).agg(F.round(F.avg(size) / 50, 6).alias("schema_sim"), F.round(F.min(size) / 50, 6).alias("dist_sim"), F.round(F.max(size) / 50, 6).alias("label_sim"), F.min("p_type").alias("_type"), F.round(F.avg((size > 25).cast("int")), 6).alias("positive_rate"))
    named = parts.withColumn("label_name", F.when(last == "1", " Label ").when(last == "2", "BinaryClass").otherwise(F.col("_type")))
    return align.discovery_scores(named, 0.4, least=0.3)


def adaptation_tables(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents as pseudo-sources with labels, and others as the target: (sources, target with label, features)."""
    text = F.col("text")
    docs = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("table_id"), F.col("quality").alias("label"),
        F.length(text).cast("double").alias("chars"), F.size(F.split(text, r"\s+")).cast("double").alias("words"),
        (F.regexp_count(text, F.lit(r"[^\w\s]")) / (F.length(text) + 1)).alias("marks"), (F.size(F.array_distinct(F.split(text, r"\s+"))) / F.size(F.split(text, r"\s+"))).alias("variety"),
    )
    docs = adapt.cut(docs)
    target = docs.where("row_id % 3 = 0")
    return docs.where("row_id % 3 <> 0").withColumn("weight", F.lit(1.0)), target, ["chars", "words", "marks", "variety"]


@query(None)
def gbt_selftrain(t: Tables) -> DataFrame:
    sources, target, features = adaptation_tables(t)
    return adapt.self_trained(sources, target.drop("label"), features, _BOOSTER)


@query(None)
def gbt_label_shift(t: Tables) -> DataFrame:
    sources, target, features = adaptation_tables(t)
    return adapt.self_trained(sources, target.drop("label"), features, _BOOSTER, shift=True)


@query(None)
def baselines(t: Tables) -> DataFrame:
    sources, target, features = adaptation_tables(t)
    out = adapt.baseline_a(target).unionByName(adapt.baseline_b(sources, target.drop("label"), features, _BOOSTER))
    return out.unionByName(adapt.baseline_c(sources, target.drop("label"), features, _BOOSTER))


@query(None)
def vla_pooled(t: Tables) -> DataFrame:
    sources, target, features = adaptation_tables(t)
    return adapt.pooled_with_validation(sources, target.where("row_id % 2 = 0"), target.where("row_id % 2 = 1").drop("label"), features, _BOOSTER)


@query(None)
def stacking(t: Tables) -> DataFrame:
    sources, target, features = adaptation_tables(t)
    p = adapt.source_predictions(sources, target, features, _BOOSTER)
    return adapt.stacked(p, target.where("row_id % 2 = 0"), target.where("row_id % 2 = 1").drop("label"), features, _BOOSTER)


@query(None)
def tree_shap(t: Tables) -> DataFrame:
    """How much each feature adds in the model of each source, over all target rows."""
    sources, target, features = adaptation_tables(t)
    return adapt.importance(sources, target, features, _BOOSTER, ["table_id"])


@query(None)
def source_self_auc(t: Tables) -> DataFrame:
    sources, _, features = adaptation_tables(t)
    return adapt.self_auc(sources, features)


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    features = [f"x{i}" for i in range(WIDTH)]
    rows = t.embeddings.select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("label"), F.lit(1.0).alias("weight"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(WIDTH)])
    return rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1").drop("label", "weight"), features


@query(None)
def kernel_mean_matching(t: Tables) -> DataFrame:
    sources, target, features = _vectors(t)
    return adapt.kernel_weights(sources, target, features)


@query(None)
def sinkhorn_transport(t: Tables) -> DataFrame:
    sources, target, features = _vectors(t)
    return adapt.transported(sources, target, features)


def _adversarial(t: Tables, conditional: bool, level: str) -> DataFrame:
    sources, target, features = _vectors(t)
    x, y, w, z = adapt.matrices(sources, target, features)
    return adapt.with_net(neural.adversarial(x, y, z, w, conditional), target, features, level)


@query(None)
def dann(t: Tables) -> DataFrame:
    return _adversarial(t, False, "level5")


@query(None)
def cdan(t: Tables) -> DataFrame:
    return _adversarial(t, True, "level55")


@query(None)
def ftta(t: Tables) -> DataFrame:
    sources, target, features = _vectors(t)
    x, y, w, z = adapt.matrices(sources, target, features)
    net = neural.test_time_adapted(neural.adversarial(x, y, z, w), z, float(y.mean()))
    return adapt.with_net(net, target, features, "level6")


@query(None)
def label_propagation(t: Tables) -> DataFrame:
    sources, target, features = _vectors(t)
    return adapt.spread_labels(sources, target, features)


@query(None)
def adaptation_pipeline(t: Tables) -> DataFrame:
    """The levels side by side, with their metrics and what they gain on the baseline."""
    from lakeweave.plans.pipeline import run_levels

    sources, target, features = adaptation_tables(t)
    return run_levels(sources, target, features, {r["table_id"]: float(r["n"]) for r in sources.groupBy("table_id").agg((F.count(F.lit(1)) / 100).alias("n")).collect()}, _BOOSTER)
