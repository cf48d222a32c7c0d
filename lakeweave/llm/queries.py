"""The corpus operators as queries over the whole tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import exact_dedup, mixing, ngram_join, packing, page_text, quality, runs, search, secrets, sharding, token_files, toxicity, warc
from lakeweave.llm.common import WORD, scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedup_plan(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read_token_index(spark, path)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


#: commits that the history of op6 has
COMMITS = 2


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, scratch(spark, "ledger"))
    # all documents, as a history of commits: an increment scans what no commit before it had
    commit = F.pmod(F.xxhash64("doc_id"), F.lit(COMMITS))
    for i in range(COMMITS):
        ledger.add(docs.where(commit == i))
    found = secrets.findings(docs, ledger.rows())
    none = F.array().cast(found.schema["found"].dataType)
    found = found.select("doc_id", F.coalesce("found", none).alias("found"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_lines(docs, with_text=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.rate(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


#: the drill of op9: records of these pages are damaged in the second replica
DRILL = (997, 7)


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages twice, damages records of the second replica and audits it against the first."""
    first, second = scratch(spark, "warc"), scratch(spark, "warc")
    index = warc.write_archive(_table(spark, sf_dir, "pages"), first)
    warc.copy_archive(index, first, second, lambda page_id: F.pmod(page_id, F.lit(DRILL[0])) == DRILL[1])
    found = warc.audit(*(warc.merkle_tree(warc.hash_ranges(index, p)) for p in (first, second)))
    both = index.join(found.withColumn("_bad", F.lit(True)), ["file", "record"], "left")
    return both.select("page_id", "payload_sha256", "payload_bytes", F.coalesce("_bad", F.lit(False)).alias("damaged"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which every tenth document, by the CRC-32 of its id's digits (none for a null one), ends in
    a part that repeats itself: from word a on, word i is the one at a + (i - a) mod p."""
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("w").cast("long"))
    words = words.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    of = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), of), " ")
    return words.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    exponent = F.floor(1000 * length / period).cast("long")
    return found.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_exact_dedup, op3_shard, op4_token_files, op5_pack_sequences, op6_secret_scan, op7_quality_rules, op8_toxicity, op9_warc_fixity, op10_ngram_join, op11_periodic_runs, op12_lexical_search, op13_main_text, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _secrets_sql() -> str:
    """Matches and what lies between them alternate, so a match starts after the lengths before it."""
    kinds = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{kind}' AS kind, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, {least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        for i, (kind, p, group, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
l AS (SELECT doc_id, k, kind, least, [length(x) FOR x IN b] AS b, [length(x) FOR x IN m] AS m, [length(x) FOR x IN g] AS g FROM m),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM l),
s AS (SELECT doc_id, k, kind, (list_sum(b[:i]) + coalesce(list_sum(m[:i - 1]), 0))::BIGINT AS a, m[i] AS n FROM e WHERE g[i] >= least),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON j.doc_id = d.doc_id"""


def _quality_sql() -> str:
    """The base measures, and the line rules with their limits in full."""
    phrases = " OR ".join("contains(lower(l), '" + p.replace("'", "''") + "')" for p in quality.BOILERPLATE)
    separators = ", ".join(f"'{x}'" for x in quality.SEPARATORS)
    word, ink = r"[^\x20\x09-\x0D]+", r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{word}') AS w FROM d),
x AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM x),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM c, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
q AS (SELECT r, l, regexp_extract_all(l, '{ink}') AS v, len(list_filter(regexp_extract_all(l, '[\p{{P}}\p{{S}}]'), lambda y: unicode(y) < 65536)) AS marks,
    length(regexp_replace(l, '[ 	-
]', '', 'g')) AS chars FROM l),
y AS (SELECT *, coalesce(list_sum([length(z) FOR z IN v]), 0) AS inked, len([z FOR z IN v IF z IN ({separators})]) AS menus,
    len([1 FOR i IN range(1, len(v)) IF v[i] = v[i + 1]]) AS same FROM q),
b AS (SELECT r, sum(chars) AS lost FROM y WHERE len(v) > 0 AND ((marks > 0.2 * inked AND inked >= 10) OR (menus >= 3 AND menus >= 0.15 * len(v))
    OR (len(v) >= 10 AND same > 0.4 * len(v)) OR (len(v) <= 30 AND ({phrases}))) GROUP BY r),
u AS (SELECT r, count(*) - count(DISTINCT l) AS twice FROM l WHERE regexp_matches(l, '{word}') GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(z) FOR z IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(twice, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
    FROM d JOIN w USING (r) LEFT JOIN p USING (r) LEFT JOIN b USING (r) LEFT JOIN u USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM m"""


def _runs_sql() -> str:
    """Stretches in which six words equal the six words p further on, per document and p; each with its smallest p."""
    crc = "xor(list_reduce(list_prepend(4294967295, [unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w, CASE WHEN doc_id IS NULL THEN 0 ELSE {crc} END AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(n)] ELSE w END AS w FROM e),
t AS MATERIALIZED (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS w FROM f),
x AS MATERIALIZED (SELECT r, i, s FROM (SELECT r, i, array_to_string(list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), ' ') AS s,
    count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS k FROM t) WHERE k = 6),
y AS (SELECT a.r, a.i, b.i - a.i AS p FROM x a JOIN x b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
z AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM y),
s AS (SELECT r, p, min(i) AS start, count(*) + 5 AS same FROM z GROUP BY r, p, island),
u AS MATERIALIZED (SELECT r, start, same + p AS length, min(p) AS period FROM s WHERE same >= greatest(12 - p, p) GROUP BY r, start, same + p),
v AS (SELECT r, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, (length, -start, -period)) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r),
g AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT t.r, string_agg(w, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN g ON g.r = t.r AND g.i = t.i WHERE g.i IS NULL GROUP BY t.r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, ((1000 * b.l) // b.p)::BIGINT AS exponent_milli,
    sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN v ON v.r = d.r LEFT JOIN c ON c.r = d.r"""


def _search_sql() -> str:
    """Scores of every pair of a document and an item that share a term."""
    found = f"regexp_extract_all({_LOWER}, '{search.TERM}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
t AS (SELECT r, unnest(w) AS t FROM d),
p AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM t GROUP BY r, t),
q AS (SELECT row_number() OVER () AS i, item_id, {found} AS w FROM benchmark),
u AS (SELECT DISTINCT i, t FROM (SELECT i, unnest(w) AS t FROM q)),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
x AS (SELECT t, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, c),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w)::BIGINT * N) // L) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM u JOIN x USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s JOIN m USING (r) JOIN q USING (i) WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


def _pages_sql() -> str:
    """Pages that mark their text with one ``article``: the text between its tags, decoded. (Links that neighbours share
    aren't in articles here.)"""
    text = "x"
    for code, sign in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#0*39;", "''"), ("&#x0*27;", "''"), ("&nbsp;?", " "), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{code}', '{sign}', 'g')"
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT r, string_split(regexp_replace(regexp_replace(a, '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) AS b FROM a),
c AS (SELECT r, [trim(regexp_replace({text}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g')) FOR x IN [regexp_replace(y, '<[^>]*>', '', 'g') FOR y IN b]] AS c FROM b),
d AS (SELECT r, coalesce(array_to_string([x FOR x IN c IF x <> ''], chr(10) || chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM a JOIN d USING (r)"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM w),
l AS (SELECT *, (sum(source_size) OVER ()
    - (sum(cap) OVER (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
    / ((sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING)) + w)::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN cap < w * level THEN cap
    ELSE w * max(CASE WHEN cap >= w * level THEN level END) OVER () END AS target FROM l),
k AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN (length(bin(size)) - 1) * 8 + ((size * 8) >> (length(bin(size)) - 1)) - 8 ELSE -1 END AS c,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
g AS (SELECT k.source, c, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS words, any_value(t.target) AS target, any_value(t.source_size) AS source_size,
    any_value(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) AS rate, row_number() OVER (PARTITION BY k.source ORDER BY c DESC) AS r,
    ('0x' || substr(md5('17:' || coalesce(k.source, '') || ':' || c), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source GROUP BY k.source, c),
x AS (SELECT source, c, r, n, words, target, source_size, floor(rate) AS whole, rate - floor(rate) AS f,
    least(n, greatest(0.0, floor(n * (rate - floor(rate)) - 0.0 + u))) AS extra, 0.0::DOUBLE AS before FROM g WHERE r = 1
    UNION ALL SELECT g.source, g.c, g.r, g.n, g.words, g.target, g.source_size, x.whole, x.f,
    least(g.n, greatest(0.0, floor(g.n * x.f - CASE WHEN g.words > 0 THEN (x.before + (x.extra / x.n - x.f) * x.words) * g.n / greatest(g.words, 1.0) ELSE 0.0 END + g.u))),
    x.before + (x.extra / x.n - x.f) * x.words FROM x JOIN g ON g.source IS NOT DISTINCT FROM x.source AND g.r = x.r + 1)
SELECT k.doc_id, k.size, x.source_size, x.target,
    (k.size * (x.whole + CASE WHEN row_number() OVER (PARTITION BY k.source, k.c ORDER BY k.u, coalesce(k.doc_id::VARCHAR, '')) <= x.extra THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM k JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.c = x.c""",
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op6_secret_scan": _secrets_sql(),
    "op7_quality_rules": _quality_sql(),
    "op9_warc_fixity": f"""
SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    page_id % {DRILL[0]} = {DRILL[1]} AS damaged FROM pages""",
    "op11_periodic_runs": _runs_sql(),
    "op12_lexical_search": _search_sql(),
    "op13_main_text": _pages_sql(),
    "op10_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
z AS MATERIALIZED (SELECT doc_id, list_sort(s) AS z FROM s),
c AS MATERIALIZED (SELECT min(doc_id) AS id, z AS s, len(z) AS n FROM z WHERE len(z) > 0 GROUP BY z),
t AS (SELECT id, n, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS k FROM t GROUP BY t),
o AS (SELECT id, n, t.t, row_number() OVER (PARTITION BY id ORDER BY k, t.t) AS r FROM t JOIN f ON f.t = t.t),
p AS MATERIALIZED (SELECT id, n, t FROM o WHERE r <= n - ceil(n * 0.75) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT a, b FROM q JOIN c x ON x.id = a JOIN c y ON y.id = b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 75 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
g AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
m(x, y) AS (SELECT id, id FROM c UNION SELECT m.x, g.y FROM m JOIN g ON m.y = g.x),
k AS (SELECT x, min(y) AS component FROM m GROUP BY x)
SELECT z.doc_id, len(z.z)::BIGINT AS n_shingles, coalesce(k.component, z.doc_id) AS component_id
FROM z LEFT JOIN c ON c.s = z.z LEFT JOIN k ON k.x = c.id""",
}
