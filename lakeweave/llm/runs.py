"""Periodic runs of words by power-of-two names: every stretch that repeats itself, and the text without the repeats.

1. Words of a batch of documents get names, equal words equal ones; then stretches of 2, 4, 8 ... words are named by the
   pair of names of their halves (Karp, Miller and Rosenberg), so that two such stretches are equal if their names are.
2. A run of 12 words or more repeats some four words. Documents in which no name of four words comes twice have none.
3. For every period p the words at 0, p, 2p ... are a grid: a run of period p with two periods or more holds two
   neighbours of it. Neighbours that are the same word are extended forwards and backwards by descending name levels,
   one bit of the common length a level, for all candidates at once.
Names are exact (sorted pairs, no hashes), and nothing but a document's own words decides on its runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import small_batches

#: a run has at least so many words, and twice its period
LEAST = 12
#: candidates that are extended at once
_AT_ONCE = 2_000_000


def _pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: equal where both parts are."""
    keys = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


def may_repeat(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which documents (``sizes`` words each, one after the other) have two equal stretches of four words."""
    n_docs = len(sizes)
    out = sizes >= least
    if least < 8 or not out.any() or len(words) < 4:
        return out
    pairs = _pair_names(words[:-1], words[1:])
    m, d = int(pairs.max()) + 1, max(n_docs, 1)
    if m * m * d >= 1 << 62:
        return out
    doc = np.repeat(np.arange(n_docs), sizes)[: len(pairs) - 2]
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(doc)]
    key = (pairs[:-2].astype(np.int64) * m + pairs[2:]) * d + doc
    key = np.sort(key[np.arange(len(doc)) + 4 <= ends])
    twice = np.zeros(n_docs, bool)
    twice[key[1:][key[1:] == key[:-1]] % d] = True
    return out & twice


class Names:
    """Names of 1, 2, 4 ... words for documents laid one after the other, longest first."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.levels = [words]
        span = 1
        while len(sizes) and 2 * span < sizes[0]:
            part = int(sizes[sizes >= 2 * span].sum())  # shorter documents, which come last, have no such stretch
            below = self.levels[-1]
            self.levels.append(_pair_names(below[: part - 2 * span + 1], below[span : part - span + 1]))
            span *= 2

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from i and from j on are equal, ``most`` at most; with step -1 those before i and before j."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, span = self.levels[level], 1 << level
            for _ in range(2 if level == len(self.levels) - 1 else 1):  # the top level may fit twice
                at = np.flatnonzero(found + span <= most)
                if not len(at):
                    continue
                off = found[at] if step > 0 else -found[at] - span
                found[at[names[i[at] + off] == names[j[at] + off]]] += span
        return found


def _grid(n: int):
    """(period, place) of all neighbours on all grids of a document of n words, in pieces of bounded size."""
    periods = np.arange(1, n // 2 + 1, dtype=np.int64)
    counts = (n - 1) // periods
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
        c = counts[at:to]
        p = np.repeat(periods[at:to], c)
        yield p, (np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)) * p
        at = to


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, by document, start and period.

    ``words``: names of the words of all documents, one after the other; ``sizes``: how many each document has.
    """
    none = np.empty(0, np.int64)
    hold = np.flatnonzero(may_repeat(words, sizes, least))
    if not len(hold):
        return none, none, none, none
    hold = hold[np.argsort(-sizes[hold], kind="stable")]
    starts = np.cumsum(sizes) - sizes
    own = np.concatenate([words[starts[d] : starts[d] + sizes[d]] for d in hold])
    names = Names(own, sizes[hold])
    out, wait, waiting = [], [], 0

    def extend():
        nonlocal waiting
        doc, p, i, begin, end = (np.concatenate(x) for x in zip(*wait, strict=True))
        wait.clear()
        waiting = 0
        # a place whose neighbour before it lies in the same stretch says nothing new
        back = names.common(i, i + p, np.minimum(i - begin, p), -1)
        first = back < p
        doc, p, i, begin, end, back = (x[first] for x in (doc, p, i, begin, end, back))
        same = back + names.common(i, i + p, end - i - p, 1)
        good = same >= np.maximum(least - p, p)
        out.append((doc[good], (i - back - begin)[good], (same + p)[good], p[good]))

    at = 0
    for d in hold:
        n = int(sizes[d])
        for p, j in _grid(n):
            i = at + j
            hit = own[i] == own[i + p]
            p, i = p[hit], i[hit]
            wait.append((np.full(len(p), d), p, i, np.full(len(p), at), np.full(len(p), at + n)))
            waiting += len(p)
            if waiting >= _AT_ONCE:
                extend()
        at += n
    extend()
    doc, start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.lexsort((period, length, start, doc))
    doc, start, length, period = (x[by] for x in (doc, start, length, period))
    new = np.ones(len(doc), bool)  # a stretch counts with its smallest period
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = (x[new] for x in (doc, start, length, period))
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], length[by], period[by]


RUN = "struct<start:long,length:long,period:long>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row of ``docs`` but its text, with ``n_words``, ``runs`` (array of start, length and period in words, by start,
    then period) and ``collapsed``: its words, one space between them, without those that a run only repeats.

    A run is a stretch of words with smallest period q, at least ``least`` and 2 q words long, that no word beside it
    extends. One pass without a shuffle; the whole text counts, however long. Null and empty texts have no words, no runs
    and an empty ``collapsed``; rows that repeat are treated alike; columns of ``docs`` named like the results are
    replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    at = [c.lower() for c in docs.columns].index("text")
    others = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            words = [(t or b"").split() for t in texts]  # bytes.split() knows ASCII white space only
            sizes = np.array([len(w) for w in words], np.int64)
            flat = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
            doc, start, length, period = find_runs(flat, sizes, least)
            offsets = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
            for d in np.unique(doc):
                part = slice(offsets[d], offsets[d + 1])
                gone = np.zeros(int(sizes[d]) + 1, np.int64)
                np.add.at(gone, start[part] + period[part], 1)
                np.add.at(gone, start[part] + length[part], -1)
                stays = np.cumsum(gone[:-1]) == 0
                words[d] = [w for w, s in zip(words[d], stays.tolist(), strict=True) if s]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            names = [batch.schema.names[i] for i in others] + ["n_words", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], pa.array(sizes), runs, collapsed], names=names)

    made = {"n_words": "long", "runs": f"array<{RUN}>", "collapsed": "string"}
    schema = docs.select(*[docs.columns[i] for i in others], *[F.lit(None).cast(t).alias(n) for n, t in made.items()]).schema
    return docs.mapInArrow(run, schema)
