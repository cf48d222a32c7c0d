"""Ranked search of whole documents by terms: postings in windows of doc_ids, scores in arrays, the best in heaps.

1. The terms of a block of items (of bounded size) are the vocabulary. Every document is split into terms once; what it
   has of the vocabulary goes to the window of its doc_id. A window is stored as an inverted list: its documents with
   their lengths, and for each term the slots and counts of the documents that have it.
2. Counts of documents and terms, and of the documents of each term, are summed from the narrow columns of the windows.
3. A task traverses its windows in order of doc_id. What a term adds to its documents is computed once a window; for
   every item these numbers are scatter-added into one array that fits the cache. The item's occupied slots are the
   union of its terms' bitsets, and what beats the item's heap is harvested from them.
4. The heaps of all tasks meet: at most ``k`` rows an item and task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import HOT_SHARE, ascii_lower, cut, forget, release, small_batches

#: a term is a run of ASCII letters and digits and of anything beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: slots of a window: its sums take 128 kB
SLOTS = 16_384
#: terms of items that are handled at once (this bounds what is broadcast)
MOST_TERMS = 1 << 20
#: what stands for a missing doc_id, so that it comes last
_NO_ID = (1 << 63) - 1
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """The terms of a text in order; null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _postings(docs: DataFrame, vocabulary, windows: Column) -> DataFrame:
    """``window, piece, doc_id, n_terms, terms, counts``: what each document has of the vocabulary, packed."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            found, sizes = [], []
            for t in batch.column(3).cast(pa.large_binary()).to_pylist():
                words = (t or b"").translate(_SPLIT).split()
                sizes.append(len(words))
                found.append([x for x in map(known.get, words) if x is not None])
            sizes = np.array(sizes, np.int64)
            key = np.repeat(np.arange(len(found), dtype=np.int64), [len(x) for x in found]) * len(known) + np.array([x for f in found for x in f], np.int64)
            key, n = np.unique(key, return_counts=True)
            term, ends = (key % max(len(known), 1)).astype("<i4").tobytes(), 4 * np.searchsorted(key, np.arange(len(found) + 1) * len(known))
            n = n.astype("<i4").tobytes()
            cuts = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array([term[c] for c in cuts], pa.binary()), pa.array([n[c] for c in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["window", "piece", "doc_id", "n_terms", "terms", "counts"]).filter(pa.array(sizes > 0))

    dealt = docs.select(windows.alias("w")).select("w.window", "w.piece", "w.doc_id", "w.text")
    return dealt.mapInArrow(run, "window long, piece long, doc_id long, n_terms long, terms binary, counts binary")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from documents in order: up to SLOTS documents of one window become one row."""
    ids, sizes, held, now = [], [], [], None

    def flush():
        term = np.concatenate([np.frombuffer(t, "<i4") for t, _ in held])
        count = np.concatenate([np.frombuffer(c, "<i4") for _, c in held])
        slot = np.repeat(np.arange(len(held), dtype=np.uint16), [len(t) // 4 for t, _ in held])
        by = np.argsort(term, kind="stable")
        own, n = np.unique(term, return_counts=True)
        packed = [np.array(ids, "<i8"), np.array(sizes, "<i8"), own.astype("<i4"), n.astype("<i4"), slot[by].astype("<u2"), count[by].astype("<i4")]
        row = [pa.array([len(ids)]), pa.array([sum(sizes)]), *[pa.array([p.tobytes()], pa.binary()) for p in packed]]
        for x in (ids, sizes, held):
            x.clear()
        return pa.RecordBatch.from_arrays(row, names=["n_docs", "n_terms", "docs", "sizes", "terms", "n_in", "slots", "counts"])

    for batch in batches:
        for window, doc_id, n, t, c in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)], strict=True):
            if ids and (window != now or len(ids) == SLOTS):
                yield flush()
            now = window
            ids.append(_NO_ID if doc_id is None else doc_id)
            sizes.append(n)
            held.append((t, c))
    if ids:
        yield flush()


INDEX = "n_docs long, n_terms long, docs binary, sizes binary, terms binary, n_in binary, slots binary, counts binary"


def build_index(docs: DataFrame, vocabulary) -> DataFrame:
    """The windows of all documents with a term (``INDEX``), stored. ``vocabulary``: a broadcast dictionary of terms
    (UTF-8) to numbers from 0. A window spans as many ids as hold SLOTS documents on average; one with more documents
    becomes several rows, and one with over a thousandth of all documents is dealt to several tasks."""
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) * SLOTS // max(n, 1)))
    window = F.coalesce(F.expr(f"doc_id div {min(width, _NO_ID)}L"), F.lit(_NO_ID))
    hot = docs.groupBy(window.alias("w")).count().where(F.col("count") > max(4 * SLOTS, int(n * HOT_SHARE))).collect()
    pieces = F.lit(1)
    for r in hot:  # fewer than 1 / HOT_SHARE
        pieces = F.when(window == r["w"], F.lit(-(-r["count"] // SLOTS))).otherwise(pieces)
    dealt = F.struct(window.alias("window"), F.pmod(F.monotonically_increasing_id(), pieces).alias("piece"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    small_batches(docs.sparkSession)
    rows = _postings(docs, vocabulary, dealt).repartition("window", "piece").sortWithinPartitions("window", "piece", "doc_id")
    return cut(rows.mapInArrow(_inverted, INDEX), "windows")


def document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that have each term of the vocabulary."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(t, "<i4")] += np.frombuffer(c, "<i4")
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms", "n_in").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


class Heap:
    """The k best of one item: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at) > self.k:
            best = at[np.lexsort((ids[at], -scores[at]))[: self.k]] if len(at) < 64 else self._few(at, ids, scores)
        else:
            best = at
        for doc_id, score in zip(ids[best].tolist(), scores[best].tolist(), strict=True):
            put = heapq.heappush if len(self.rows) < self.k else heapq.heappushpop
            put(self.rows, (score, -doc_id))
        if len(self.rows) == self.k:
            self.least = self.rows[0][0]

    def _few(self, at, ids, scores):
        edge = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
        at = at[scores[at] >= edge]
        return at[np.lexsort((ids[at], -scores[at]))[: self.k]]


def score_windows(index: DataFrame, plan, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best documents of every item in each task. ``plan``: broadcast (terms of each item,
    weights of the terms, counts of documents and of their terms)."""

    def run(batches):
        items, weights, n_docs, n_terms = plan.value
        heaps = [Heap(k) for _ in items]
        sums = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(6)], strict=True):
                docs, sizes, own, n_in, slots, counts = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<i8", "<i8", "<i4", "<i4", "<u2", "<i4"), strict=True))
                slots = slots.astype(np.int64)
                long = 8 * (100 - 90 + 90 * sizes * n_docs // n_terms)
                adds = counts.astype(np.int64)
                adds = 1_000_000_000 * adds // (1000 * adds + long[slots]) * np.repeat(weights[own], n_in)
                ends = np.cumsum(n_in)
                part = {t: slice(e - n, e) for t, n, e in zip(own.tolist(), n_in.tolist(), ends.tolist(), strict=True)}
                bits = {}
                mark = np.zeros(SLOTS, np.uint8)
                for item, heap in zip(items, heaps, strict=True):
                    occupied = np.zeros(SLOTS // 8, np.uint8)
                    for t in item:
                        if (s := part.get(t)) is None:
                            continue
                        where = slots[s]
                        if t not in bits:
                            mark[where] = 1
                            bits[t] = np.packbits(mark)
                            mark[where] = 0
                        occupied |= bits[t]
                        sums[where] += adds[s]
                    full = np.flatnonzero(np.unpackbits(occupied))
                    heap.add(docs[full], sums[full])
                    sums[full] = 0
        rows = [(i, None if d == -_NO_ID else -d, score) for i, h in enumerate(heaps) for score, d in h.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["item", "doc_id", "score"])

    return index.select("docs", "sizes", "terms", "n_in", "slots", "counts").mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, most_terms: int, again: int = 0) -> Iterator[DataFrame]:
    """The items in parts of ``most_terms`` terms at most (but for a single item with more)."""
    n = max(1, -(-2 * (items.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms))
    part = F.pmod(F.xxhash64("row", F.lit(again)), F.lit(n))
    for r in sorted(items.groupBy(part.alias("p")).agg(F.sum(F.size("terms")).alias("terms"), F.count(F.lit(1)).alias("rows")).collect()):
        block = items.where(part == r["p"])
        if r["terms"] <= most_terms or r["rows"] == 1:
            yield block
        else:  # the hash was unlucky
            yield from _blocks(block, most_terms, again + 1)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = MOST_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    ``docs``: doc_id and text, ``items``: item_id and text; other columns play no part. With N documents that have a term,
    L terms in all of them, n terms of a document, df documents with a term that occurs tf times in the document,
    a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))) and adds w ((10^9 tf) div (1000 tf + 8 m)), where
    m = 100 - 90 + (90 n N) div L. Equal scores rank by ascending doc_id, a null one last. Null and empty texts have no
    terms. Rows that repeat a doc_id are documents of their own, rows that repeat an item_id are ranked one by one.
    Empty tables give no rows. Items are handled in blocks of ``most_terms`` terms, each with an index of its own.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = cut(items.select("item_id", F.array_distinct(terms(F.col("text"))).alias("terms"), F.monotonically_increasing_id().alias("row")), "items")
    out = []
    for block in _blocks(own.where(F.size("terms") > 0), most_terms):
        wanted = block.select("row", "terms").collect()
        if not wanted:
            continue
        number: dict[bytes, int] = {}
        lists = [[number.setdefault(t.encode(), len(number)) for t in r["terms"]] for r in wanted]
        vocabulary = spark.sparkContext.broadcast(number)
        index = build_index(docs, vocabulary)
        n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in document_counts(index, len(number)).tolist()], np.int64)
        plan = spark.sparkContext.broadcast((lists, weights, n_docs, n_terms))
        rows = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(wanted)], "item long, row long")
        out.append(cut(score_windows(index, plan, k).join(F.broadcast(rows), "item").select("row", "doc_id", "score"), "ranked"))
        forget(index)
        vocabulary.unpersist()
        plan.unpersist()
        release(spark)
    if not out:
        return own.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(own.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
