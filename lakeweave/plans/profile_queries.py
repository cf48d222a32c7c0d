"""Profiling, distances and labels of columns over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import numeric, text
from lakeweave.operators import binarize, distance, profile, ranking
from lakeweave.plans.registry import Tables, query

_NAMES = ("nation", "region", "customer", "supplier", "part", "orders")
_NUMERIC = {"nation": 2, "region": 1, "customer": 3, "supplier": 3, "part": 3, "orders": 3}
_COLS = {"nation": 3, "region": 2, "customer": 5, "supplier": 4, "part": 6, "orders": 6}


def _manifest(t: Tables) -> DataFrame:
    out = None
    for n in _NAMES:
        one = getattr(t, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_id"), "n_rows", F.lit(_COLS[n]).cast("long").alias("n_cols"), F.lit(_NUMERIC[n]).cast("long").alias("n_numeric"))
        out = one if out is None else out.unionByName(one)
    return out


_MANIFEST_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_id, count(*) AS n_rows, {_COLS[n]}::BIGINT AS n_cols, {_NUMERIC[n]}::BIGINT AS n_numeric FROM {n}" for n in _NAMES)


@query(f"""WITH m AS ({_MANIFEST_SQL})
SELECT count(*) AS n_tables, sum(n_rows)::BIGINT AS total_rows, min(n_rows) AS min_rows, round(quantile_cont(n_rows, 0.5), 6) AS median_rows,
 max(n_rows) AS max_rows, round(avg(n_rows), 6) AS mean_rows, min(n_cols) AS min_cols, round(quantile_cont(n_cols, 0.5), 6) AS median_cols,
 max(n_cols) AS max_cols, round(avg(n_cols), 6) AS mean_cols FROM m""")
def lake_stats(t: Tables) -> DataFrame:
    return profile.table_stats(_manifest(t))


@query(f"WITH m AS ({_MANIFEST_SQL}) SELECT * FROM m WHERE n_rows BETWEEN 30 AND 10000 AND n_cols BETWEEN 3 AND 50 AND n_numeric / n_cols >= 0.3")
def quality_gate(t: Tables) -> DataFrame:
    return profile.quality_gate(_manifest(t))


@query("""SELECT "column", count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS n_distinct FROM (
 SELECT 'event_type' AS "column", event_type AS v FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events
 UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
 UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders) GROUP BY 1""")
def null_constant_prune(t: Tables) -> DataFrame:
    a = profile.column_profile(t.events, ["event_type", "user_id"])
    return a.unionByName(profile.column_profile(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query(r"""WITH h AS (SELECT DISTINCT name FROM (SELECT left(text, (1 + doc_id % 75)::INT) AS name FROM documents UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation
 UNION ALL SELECT CASE o_orderkey % 4 WHEN 0 THEN ' Row_Num' WHEN 1 THEN 'PK ' WHEN 2 THEN 'order ' || o_orderkey || '?' ELSE o_orderkey::VARCHAR END FROM orders) WHERE name IS NOT NULL)
SELECT name, length(trim(name)) > 0 AND length(trim(name)) <= 60 AND len(regexp_split_to_array(trim(name), '\s+')) <= 5
 AND NOT contains(trim(name), '?') AND NOT ends_with(trim(name), '.') AND NOT regexp_matches(trim(name), '^(?i:id|idx|index|row_id|rowid|row_num|rownum|seq|key|pk|uuid|guid)$') AS is_feature,
 length(trim(name)) <= 1 OR try_cast(name AS DOUBLE) IS NOT NULL AS is_cryptic FROM h""")
def feature_name_predicate(t: Tables) -> DataFrame:
    """Heads of documents, names of parts and nations, and keys as column names."""
    key = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderkey") % 4 == 0, " Row_Num").when(F.col("o_orderkey") % 4 == 1, "PK ").when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("order "), key, F.lit("?"))).otherwise(key)
    heads = t.documents.select(F.substring("text", F.lit(1), (1 + F.col("doc_id") % 75).cast("int")).alias("name"))
    names = heads.unionByName(t.part.select(F.col("p_name").alias("name"))).unionByName(t.nation.select(F.col("n_name").alias("name"))).unionByName(t.orders.select(kind.alias("name")))
    return names.where("name is not null").distinct().select("name", text.is_feature_name("name").alias("is_feature"), text.is_cryptic_name("name").alias("is_cryptic"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)(?:steel)|(?:brass)|(?:^a)|(?:9$)')")
def name_regex_exclude(t: Tables) -> DataFrame:
    return t.part.where(~text.matches_any("p_name", ["steel", "brass", "^a", "9$"])).select("p_partkey", "p_name")


@query("""WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
SELECT * FROM r WHERE rank <= 3""")
def col_profile_top3(t: Tables) -> DataFrame:
    a = profile.top_values(t.orders, "o_orderpriority").withColumn("column", F.lit("o_orderpriority"))
    return a.unionByName(profile.top_values(t.documents, "lang").withColumn("column", F.lit("lang")))


@query("""SELECT "column", level, round(value, 6) AS value FROM (
 SELECT 'l_quantity' AS "column", unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])::DOUBLE AS level, unnest(quantile_cont(l_quantity, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS value FROM lineitem
 UNION ALL SELECT 'l_extendedprice', unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])::DOUBLE, unnest(quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) FROM lineitem)""")
def decile_vector(t: Tables) -> DataFrame:
    return profile.quantiles(t.lineitem, ["l_quantity", "l_extendedprice"]).withColumn("value", F.round("value", 6))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1,0.25,0.5,0.75,0.9]) AS a FROM lineitem),
 p AS (SELECT quantile_cont(o_totalprice, [0.1,0.25,0.5,0.75,0.9]) AS b, max(o_totalprice) - min(o_totalprice) AS span FROM orders)
SELECT 'l_extendedprice' AS left_column, 'o_totalprice' AS right_column,
 round((abs(a[1]-b[1])+abs(a[2]-b[2])+abs(a[3]-b[3])+abs(a[4]-b[4])+abs(a[5]-b[5])) / 5 / span, 6) AS distance FROM q, p""")
def quantile_distance(t: Tables) -> DataFrame:
    return distance.quantile_distance(profile.long_numbers(t.lineitem, ["l_extendedprice"]), profile.long_numbers(t.orders, ["o_totalprice"]))


_Q9 = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


@query(f"""WITH a AS (SELECT quantile_cont(c_acctbal, {_Q9}) AS q FROM customer), b AS (SELECT quantile_cont(s_acctbal, {_Q9}) AS q, max(s_acctbal) - min(s_acctbal) AS span FROM supplier)
SELECT 'acctbal' AS "column", round(greatest(0, 1 - list_sum([abs(a.q[i] - b.q[i]) FOR i IN range(1, 10)]) / 9 / (span + 1e-9)), 6) AS similarity FROM a, b""")
def dist_similarity(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_acctbal").alias("acctbal"))
    b = t.supplier.select(F.col("s_acctbal").alias("acctbal"))
    return distance.distribution_similarity(profile.long_numbers(a, ["acctbal"]), profile.long_numbers(b, ["acctbal"]))


def _ks_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = profile.long_numbers(t.customer, ["c_acctbal"]).unionByName(profile.long_numbers(t.part, ["p_retailprice", "p_size"]))
    right = profile.long_numbers(t.supplier, ["s_acctbal"]).unionByName(profile.long_numbers(t.orders, ["o_totalprice"]))
    return left, right


@query("""WITH l AS (SELECT 'c_acctbal' AS c, c_acctbal AS v FROM customer UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'p_size', p_size FROM part),
 r AS (SELECT 's_acctbal' AS c, s_acctbal AS v FROM supplier UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders),
 s AS (SELECT l.c AS left_column, x.c AS right_column, v, 1 AS a, 0 AS b FROM l, (SELECT DISTINCT c FROM r) x UNION ALL SELECT x.c, r.c, v, 0, 1 FROM r, (SELECT DISTINCT c FROM l) x),
 g AS (SELECT left_column, right_column, v, sum(a) AS a, sum(b) AS b FROM s GROUP BY ALL),
 k AS (SELECT left_column, right_column, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM g
  WINDOW p AS (PARTITION BY left_column, right_column), w AS (PARTITION BY left_column, right_column ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT left_column, right_column, round(max(gap), 6) AS ks FROM k GROUP BY ALL""")
def ks_matrix(t: Tables) -> DataFrame:
    return distance.ks_matrix(*_ks_sides(t))


@query(f"""WITH a AS (SELECT quantile_cont(l_extendedprice, {_Q9}) AS q FROM lineitem), b AS (SELECT quantile_cont(p_retailprice, {_Q9}) AS q FROM part),
 u AS (SELECT unnest(a.q) AS x, unnest(b.q) AS y FROM a, b) SELECT 'price' AS "column", round(corr(x, y), 6) AS correlation, round(corr(x, y), 6) >= 0.2 AS passes FROM u""")
def quantile_corr_filter(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_extendedprice").alias("price"))
    b = t.part.select(F.col("p_retailprice").alias("price"))
    found = distance.quantile_correlation(profile.long_numbers(a, ["price"]), profile.long_numbers(b, ["price"]))
    return found.withColumn("passes", F.col("correlation") >= 0.2)


@query("""WITH v AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem),
 s AS (SELECT "column", min(v) AS low, max(v) AS high, least(256, count(DISTINCT v)) AS bins FROM v GROUP BY 1),
 h AS (SELECT v."column", least(floor((v - low) / ((high - low) / bins)), bins - 1) AS b, low, (high - low) / bins AS w, count(*) AS n FROM v JOIN s USING ("column") GROUP BY ALL),
 c AS (SELECT *, low + (b + 0.5) * w AS centre FROM h),
 o AS (SELECT "column", b, centre, sum(n) OVER u AS w0, sum(n * centre) OVER u AS s0, sum(n) OVER p AS nn, sum(n * centre) OVER p AS ss FROM c
  WINDOW p AS (PARTITION BY "column"), u AS (PARTITION BY "column" ORDER BY b ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT "column", b, centre, round(w0 * (nn - w0) * (s0 / w0 - (ss - s0) / (nn - w0)) * (s0 / w0 - (ss - s0) / (nn - w0)), 3) AS d FROM o WHERE nn > w0)
SELECT "column", round(arg_min(centre, (-d, b)), 6) AS threshold, 'otsu' AS method FROM g GROUP BY 1""")
def otsu_threshold(t: Tables) -> DataFrame:
    values = profile.long_numbers(t.events, ["value"]).unionByName(profile.long_numbers(t.lineitem, ["l_quantity"]))
    return profile.otsu(values).withColumn("threshold", F.round("threshold", 6))


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m, min(value) AS lo FROM events GROUP BY 1)
SELECT event_type, label, count(*) AS n FROM (SELECT e.event_type, CASE WHEN m <= lo THEN (coalesce(value, m) > m)::INT ELSE (coalesce(value, m) >= m)::INT END AS label FROM events e JOIN m USING (event_type)) GROUP BY ALL""")
def median_binarize(t: Tables) -> DataFrame:
    return binarize.median_binarize(t.events.select("event_type", "value"), "value", ["event_type"]).groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer)
SELECT c_custkey, (c_acctbal >= m)::INT AS positive, (c_acctbal <= m)::INT AS negative FROM customer, m""")
def directional_binarize(t: Tables) -> DataFrame:
    stats = t.customer.agg(F.percentile("c_acctbal", 0.5).alias("m"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    both = t.customer.join(F.broadcast(stats))
    args = ("c_acctbal", F.col("m"), F.col("lo"), F.col("hi"))
    return both.select("c_custkey", binarize.binarize(*args, F.lit(" positive ")).alias("positive"), binarize.binarize(*args, F.lit("negative")).alias("negative"))


_ANSWERS = "CASE o_orderstatus WHEN 'F' THEN ' Found' WHEN 'O' THEN 'f' WHEN 'P' THEN 'high' ELSE 'present' END"


@query(f"""WITH a AS (SELECT {_ANSWERS} AS answer FROM orders UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT CASE WHEN l_linenumber = 1 THEN 'T' WHEN l_linenumber = 2 THEN 'Y ' WHEN l_linenumber = 3 THEN 'pos' ELSE l_linenumber::VARCHAR END FROM lineitem)
SELECT answer, regexp_matches(answer, '^\\s*(?i:yes|y|true|t|1|positive|pos|present|found)\\s*$')::INT AS label, count(*) AS n FROM a GROUP BY ALL""")
def affirmative_binarize(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.expr("CASE WHEN l_linenumber = 1 THEN 'T' WHEN l_linenumber = 2 THEN 'Y ' WHEN l_linenumber = 3 THEN 'pos' ELSE string(l_linenumber) END").alias("answer"))
    answers = t.orders.select(F.expr(_ANSWERS).alias("answer")).unionByName(t.orders.select(F.col("o_orderpriority").alias("answer"))).unionByName(lines)
    return answers.groupBy("answer", binarize.affirmative_binarize("answer").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_QUALITY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in _QUALITY_COLUMNS) + """),
 m AS (SELECT "column", quantile_cont(v, 0.5) AS m FROM v GROUP BY 1),
 s AS (SELECT "column", count(*) AS n, count(DISTINCT v) AS d, stddev_samp(v) AS sd, avg(v) AS mean, avg((v > m)::INT) AS rate FROM v JOIN m USING ("column") GROUP BY 1)
SELECT "column", round(CASE WHEN d <= 2 THEN 1.0 ELSE least(1.0, d / (0.2 * n)) END * least(1.0, sd / (abs(mean) + 1e-9) / 0.5) * greatest(0.1, 1 - 2 * greatest(0.0, abs(rate - 0.5) - 0.25)), 6) AS quality, round(rate, 6) AS rate FROM s""")
def proxy_quality(t: Tables) -> DataFrame:
    return profile.proxy_quality(profile.long_numbers(t.lineitem, _QUALITY_COLUMNS))


@query("""SELECT source, round(avg(quality), 6) AS rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING round(avg(quality), 6) BETWEEN 0.05 AND 0.95""")
def pos_rate_gate(t: Tables) -> DataFrame:
    rates = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    return ranking.rate_gate(rates, "rate")


@query("""WITH r AS (SELECT c_nationkey, c_acctbal, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
 k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS q, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS e,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS d FROM lineitem)
SELECT 'l_discount' AS a, 'l_extendedprice' AS b, round(corr(d, e), 6) AS rho FROM k UNION ALL SELECT 'l_discount', 'l_quantity', round(corr(d, q), 6) FROM k UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(e, q), 6) FROM k""")
def spearman_matrix(t: Tables) -> DataFrame:
    return distance.spearman_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("""WITH k AS (SELECT l_returnflag AS f, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS q,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS e,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_returnflag, l_tax) - 1) / 2.0 AS x FROM lineitem WHERE l_returnflag IN ('A', 'N')),
 m AS (SELECT f, round(corr(e, q), 6) AS r1, round(corr(e, x), 6) AS r2, round(corr(q, x), 6) AS r3 FROM k GROUP BY 1)
SELECT round((2 * (a.r1*b.r1 + a.r2*b.r2 + a.r3*b.r3) + 3) / sqrt((2 * (a.r1*a.r1 + a.r2*a.r2 + a.r3*a.r3) + 3) * (2 * (b.r1*b.r1 + b.r2*b.r2 + b.r3*b.r3) + 3)), 6) AS alignment
FROM m a, m b WHERE a.f = 'A' AND b.f = 'N'""")
def corr_structure_alignment(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    sides = [distance.spearman_matrix(t.lineitem.where(F.col("l_returnflag") == f), columns) for f in ("A", "N")]
    return distance.structure_alignment(*sides)


@query("""SELECT o_orderkey, l_linenumber, greatest(least(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400)::BIGINT, 365), 0) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def day_diff_clip(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("o_orderkey", "l_linenumber", numeric.day_difference("l_shipdate", "o_orderdate").alias("days"))


@query("""WITH s AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), c AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, round(s.lo + (c_acctbal - c.lo) / (c.hi - c.lo + 1e-9) * (s.hi - s.lo), 4) AS scaled FROM customer, s, c""")
def minmax_to_target(t: Tables) -> DataFrame:
    from lakeweave.operators.normalize import to_range_of

    out = to_range_of(t.customer.select("c_custkey", F.col("c_acctbal").alias("x")), t.supplier.select(F.col("s_acctbal").alias("x")), ["x"])
    return out.select("c_custkey", F.round("x", 4).alias("scaled"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / (stddev_samp(c_acctbal) OVER () + 1e-9), 6) AS z FROM customer")
def zscore_columns(t: Tables) -> DataFrame:
    from lakeweave.operators.normalize import standardized

    return standardized(t.customer.select("c_custkey", F.col("c_acctbal").alias("z")), ["z"]).withColumn("z", F.round("z", 6))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def label_encode(t: Tables) -> DataFrame:
    from lakeweave.operators.normalize import label_encoded

    return label_encoded(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")
