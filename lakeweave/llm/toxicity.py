"""Toxicity as an ordinal regression: cumulative links over sparse word features, expected severity as the score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import ascii_lower, cut, small_batches

#: fixed values: characters that separate the words of the features, besides ASCII white space
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes(32 if chr(b) in PUNCTUATION else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = 1 / (1 + exp(w.x - threshold[k])): one weight per word, shared by all ordered thresholds."""

    words: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(score, float)[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the log-likelihood; rows are arrays of feature numbers (presence)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    above = (grades[:, None] > np.arange(n_grades - 1)[None, :]).mean(0)
    first = -np.log(np.clip(above, 1e-4, 1 - 1e-4) / (1 - np.clip(above, 1e-4, 1 - 1e-4)))
    # thresholds as a first one and positive gaps, so that they stay ordered
    x = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    y = np.arange(len(rows)), grades
    for t in range(1, steps + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        theta = x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[feature], len(rows))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -40, 40)))
        cdf = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], 1)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], 1)
        p = np.maximum(cdf[y[0], grades + 1] - cdf[y[0], grades], 1e-9)
        up, down = slope[y[0], grades + 1] / p, slope[y[0], grades] / p
        by_theta = np.zeros((len(rows), n_grades + 1))
        by_theta[y[0], grades + 1] -= up
        by_theta[y[0], grades] += down
        by_theta = by_theta[:, 1:-1].mean(0)
        g = np.concatenate([
            np.bincount(feature, (up - down)[at], n_features) / len(rows) + penalty * w / max(1, n_features) ** 0.5,
            [by_theta.sum()],
            gaps * np.cumsum(by_theta[::-1])[::-1][1:],
        ])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])


def words_of(text: Column) -> Column:
    """The words of a text with repeats: A-Z lower-cased, ASCII punctuation and white space between them."""
    plain = F.translate(ascii_lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_remove(F.split(plain, r"[\x20\x09-\x0D]+"), "")


def telling_words(rows: DataFrame, least_odds: float = 1.5) -> DataFrame:
    """``word`` of the words that toxic texts have more often than chance explains. ``rows``: toxic, words.

    A word counts where twice the logarithm of its likelihood ratio (its own rate of toxic texts against the rate of
    all) exceeds 2 ln V, V being the number of distinct words that three or more texts have: so hardly
    one of them gets in by chance, in a small sample or a large one. The floor of evidence is the same for every word, so the words
    of a small language need no share of all texts. Its log-odds must be ``least_odds`` or more, too.
    """
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    seen = rows.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    seen = cut(seen.where("a + b >= 3"), "words")
    share = bad / max(1, bad + good)
    if not 0 < share < 1:
        return seen.select("word").limit(0)
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((b + 0.5) / (good - b + 0.5))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(F.lit(0.0))
    evidence = 2 * (part(a, share) + part(b, 1 - share))
    needed = 2 * float(np.log(max(1, seen.count())))
    return seen.where((evidence > needed) & (odds >= least_odds) & (a > n * share)).select("word")


def graded(rows: DataFrame) -> DataFrame:
    """``rows`` (key, toxic, words) with ``grade``: 0 not toxic, 1 toxic, 2 toxic and severe.

    Labels are binary, so severity has to be derived, and not from what the model will see of a row: the rows are
    halved by a hash, and the number of a text's words that the *other* half tells to be toxic is its severity; above
    the median of the toxic texts of its half it is severe.
    """
    rows = rows.withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2)))
    halves = []
    for half in (0, 1):
        told = cut(telling_words(rows.where(F.col("half") != half)), "told")
        toxic = rows.where((F.col("half") == half) & (F.col("toxic") == 1))
        each = toxic.select("key", F.explode_outer(F.array_distinct("words")).alias("word"))
        known = F.broadcast(told.withColumn("hit", F.lit(1)))  # words of a bounded sample
        many = cut(each.join(known, "word", "left").groupBy("key").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("many")), "many")
        middle = many.agg(F.percentile("many", 0.5)).first()[0]
        halves.append(many.select("key", (F.lit(1) + (F.col("many") > F.lit(middle if middle is not None else 0.0)).cast("int")).alias("severity")))
    severe = halves[0].unionByName(halves[1])
    return rows.join(severe, "key", "left").withColumn("grade", F.coalesce("severity", F.lit(0))).drop("half", "severity")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> OrdinalModel:
    """A model of three severity grades from texts and 0/1 labels ``toxic``.

    Fitted on at most ``max_rows`` labelled rows (the documented bound of the sample: the first in the order of a hash
    of doc_id), equal texts once. Where labels of a doc_id or of equal texts differ, toxic holds. The features are the
    words that tell (``telling_words``); grades come from ``graded``. Rows without label, doc_id or text don't count;
    with no toxic or no clean rows, or no word that tells, the model has no words and rates everything 0.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.sha2("text", 256).alias("key"), "toxic", words_of(F.col("text")).alias("words"))
    rows = cut(rows.groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")), "labelled")
    words = sorted(r["word"] for r in telling_words(rows).collect())
    if not words:
        return OrdinalModel((), (), (50.0, 60.0))
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    found = graded(rows).select("grade", F.array_sort(F.array_intersect("words", known)).alias("hits")).groupBy("grade", "hits").count().collect()
    place = {w: i for i, w in enumerate(words)}
    ordered = sorted(found, key=lambda r: (r["grade"], r["hits"]))
    sets = [np.array([place[w] for w in r["hits"]], np.int64) for r in ordered]
    spread = np.repeat(np.arange(len(sets)), [r["count"] for r in ordered])
    grades = np.array([r["grade"] for r in ordered])[spread]
    weights, thresholds = fit_ordinal([sets[i] for i in spread], grades, len(words), 3)
    return OrdinalModel(tuple(words), tuple(weights.tolist()), tuple(thresholds.tolist()))


def rate(docs: DataFrame, model: OrdinalModel, toxic_from: float = 0.5) -> DataFrame:
    """``doc_id, expected_severity, severity, toxic`` of each row: the mean and the likeliest grade, and whether the
    mean reaches ``toxic_from``. Whole texts of any length, one pass without a shuffle. Null text is empty; a null doc_id stays null;
    rows that repeat are rated alike; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    weight = {w.encode(): x for w, x in zip(model.words, model.weights, strict=True)}
    known = frozenset(weight)

    def run(batches):
        for batch in batches:
            scores = [sum(weight[w] for w in sorted(known.intersection((t or "").encode().translate(_TABLE).split()))) for t in batch.column(1).to_pylist()]
            above = model.above(np.array(scores, float))
            chance = np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], 1), axis=1)
            mean = above.sum(1).round(9)
            columns = [batch.column(0), pa.array(mean), pa.array((-chance).argmax(1).astype(np.int32)), pa.array(mean >= toxic_from)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_severity", "severity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, severity int, toxic boolean")
