"""Secret scans over a ledger of blobs: every content is scanned once per rule version, findings go to all its paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, fresh, join_hot


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java's syntax; matches whose ``group`` has fewer than ``least`` characters are dropped.

    Matches are leftmost and don't overlap. ``hint``: a text without this string has no match (saves the search).
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


#: fixed patterns, in the order in which kinds are listed
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of A-Z0-9 that is too short for the first AKIA in it is too short for any later one
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", hint=".eyJ"),
)
BASE = ("assign", "access", "hex")

#: addresses of unseen blobs (some 100 bytes each) that may be broadcast
MOST_UNSEEN = 50_000

LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


#: matches that are placed together
PART = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches in code points; end is exclusive.

    The text between matches and the matches themselves alternate, so a match starts after the parts before it. Work
    grows with the matches (and with their square over PART squared, for what moves the parts).
    """
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = F.arrays_zip(F.transform(between, F.length).alias("b"), F.transform(whole, F.length).alias("m"), F.transform(measured, F.length).alias("g"))
    kind = "array<struct<start:int,end:int,size:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, x):
        begin = (acc["at"] + x["b"]).cast("int")
        end = (begin + F.coalesce(x["m"], F.lit(0))).cast("int")
        hit = F.struct(begin.alias("start"), end.alias("end"), x["g"].alias("size"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(hit))).alias("found"))

    # an array that grows is copied with each step, so it grows in parts: first within each part, then over the parts
    def parts(x):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda i: F.aggregate(F.slice(x, i * PART + 1, F.lit(PART)), start, step))

    def joined(x):
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        before = F.aggregate(x, begun, lambda acc, y: F.struct((acc["at"] + y["at"]).cast("int").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
        moved = F.zip_with(x, before, lambda y, n: F.transform(y["found"], lambda z: F.struct((z["start"] + n).alias("start"), (z["end"] + n).alias("end"), z["size"].alias("size"))))
        return F.flatten(moved)

    found = _bound(_bound(lengths, parts), joined)
    long_enough = F.filter(found, lambda x: x["size"] >= rule.least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan(text: Column, rule: Rule, wanted: Column) -> Column:
    """``spans`` where the rule is wanted and matches at all; else null."""
    if rule.hint:
        wanted = wanted & F.contains(text, F.lit(rule.hint))
    return F.when(wanted & text.rlike(rule.pattern), spans(text, rule))


def content(text: Column) -> Column:
    """The address of a version's content: SHA-256 of its UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def named(rules: tuple[Rule, ...]) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, seen``: the contents of ``versions`` for which the ledger lacks a rule version, and those that it has.

    Hashes alone move here, never a text.
    """
    blobs = versions.select(content(F.col("text")).alias("blob")).distinct()
    if ledger is None:
        return blobs.withColumn("seen", F.array().cast("array<string>"))
    name = F.concat_ws("@", "kind", F.col("version").cast("string"))
    seen = ledger.where(name.isin(named(rules))).groupBy("blob").agg(F.collect_set(name).alias("seen"))
    out = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return out.where(F.size("seen") < len(rules))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (``LEDGER``) for the pairs of blob and rule version that ``ledger`` doesn't have yet.

    ``versions`` has every historical version of every path, its text in ``text``. First the contents' addresses are
    held against the ledger; then only texts that are unseen for some rule move (all of them where there is no ledger),
    and each blob is scanned once, however many versions have it: copies meet before the shuffle. A blob gets a row for each missing rule,
    with or without spans, so that it isn't scanned again. Null texts are empty ones; repeated rows are one blob; an
    empty table adds nothing; other columns play no part.
    """
    texts = versions.select(content(F.col("text")).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if ledger is None:
        blobs = texts.groupBy("blob").agg(F.max("text").alias("text")).withColumn("_seen", F.array().cast("array<string>"))
    else:
        wanted = cut(unseen_blobs(versions, ledger, rules), "unseen")
        few = wanted.count() <= MOST_UNSEEN  # an increment's hashes are looked up where the texts lie; else both are dealt
        wanted = wanted.withColumnRenamed("seen", "_seen")
        # texts that aren't wanted are left out, and copies meet, before anything moves
        blobs = texts.join(F.broadcast(wanted) if few else wanted, "blob").groupBy("blob").agg(F.max("text").alias("text"), F.first("_seen").alias("_seen"))
    unseen = {r.kind: ~F.array_contains("_seen", f"{r.kind}@{r.version}") for r in rules}
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = [
        F.when(unseen[r.kind], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.coalesce(scan(F.col("text"), r, unseen[r.kind]), none).alias("spans")))
        for r in rules
    ]
    found = blobs.select("blob", F.filter(F.array(*rows), lambda x: x.isNotNull()).alias("_rows"))
    return found.select("blob", F.explode("_rows").alias("_r")).select("blob", "_r.kind", "_r.version", "_r.spans")


class Ledger:
    """A ledger that is stored at a path, an increment at a time; each increment is a folder that is there once it is whole."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.increments = spark, path.rstrip("/"), rules, 0
        while self._whole(self.increments):
            self.increments += 1

    def _at(self, i: int) -> str:
        return f"{self.path}/increment-{i:06d}"

    def _whole(self, i: int) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(i) + "/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame | None:
        """What the ledger has so far; None if that is nothing."""
        if not self.increments:
            return None
        return self.spark.read.schema(LEDGER).parquet(*[self._at(i) for i in range(self.increments)])

    def add(self, versions: DataFrame) -> None:
        """Scans what ``versions`` have that is unseen, and stores it as one more increment."""
        update_ledger(versions, self.rows(), self.rules).write.mode("overwrite").parquet(self._at(self.increments))
        self.increments += 1


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of ``versions`` with ``found``: array of (start, end, kind) by start, then kind as listed.

    Only blobs with spans are joined; one found in a large share of all versions is broadcast. Null texts are empty
    and have no finding; the columns of ``versions`` stay, but one named ``found`` is replaced.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    named = F.concat_ws("@", "kind", F.col("version").cast("string"))
    hits = ledger.where((F.size("spans") > 0) & named.isin([f"{r.kind}@{r.version}" for r in rules]))
    each = hits.select("blob", "kind", F.explode("spans").alias("s"))
    spot = F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("rank"), F.col("s.end").alias("end"), F.col("kind").alias("kind"))
    per_blob = each.groupBy("blob").agg(F.sort_array(F.collect_list(spot)).alias("found"))
    versions = versions.drop("found")
    new = fresh(*versions.columns, "found")
    blob, many = new("blob"), new("many")
    keyed = versions.withColumn(blob, content(F.col("text")))
    counts = keyed.groupBy(blob).agg(F.count(F.lit(1)).alias(many))
    sized = cut(per_blob.withColumnRenamed("blob", blob).join(counts, blob))
    total = sized.agg(F.sum(many)).first()[0] or 0
    return join_hot(keyed, sized, [blob], many, total, "left").drop(blob, many)
