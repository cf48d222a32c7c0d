"""Exact n-gram Jaccard self-join by a token-group matrix, as classes of linked documents.

1. Every document becomes a set of word shingles (its tokens), hashed once and stored. Equal sets are one class, with
   the smallest doc_id as its name.
2. Similar classes are partitioned into groups: classes that share several of ten minima are compared with the few
   hubs of their buckets, and verified links make the groups (connected components). A class alone is a group too.
3. The matrix has a row per token with an entry for every group in the union of whose members' first parts the token
   is. The first part of a set, under one global order with rarest tokens first, is enough: if J(Q, S) >= t, Q has
   at least ceil(t |Q|) tokens in common with S, so the first |Q| - ceil(t |Q|) + 1 tokens of Q and of S share one.
4. Two groups that meet in a row qualify if, were this the first token they share, what follows it in either could
   still make a link. One member of each (the witnesses) is compared; for groups of one, that is all. In a row where
   very many groups meet, the sets go to the row instead: a bound from the parities of their tokens (``Parities``)
   tells most pairs from links, the others are compared, and of the links found as many are kept as join the groups up.
   So versions of a text that are all just below the threshold don't become a row a pair.
5. Where witnesses of larger groups don't link, the members of the smaller group are queries. The larger group is
   stored as token unions, each of a block of its members. The overlap of a query with a union bounds the overlap
   with every member behind it, and only blocks whose bound reaches what a link needs are opened.
Inside a group nothing is compared again, so a group of any size costs an entry per token, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, forget, fresh, join_hot, release, scratch, small_batches
from lakeweave.llm.components import components
from lakeweave.llm.shingles import Parities, Shingler, common, expand, expand_sorted, min_hashes, mixed, squeeze, squeeze_sorted
from lakeweave.llm.workers import lean

MINIMA = 10
#: minima that two classes share before they are compared to make groups
SHARED_MINIMA = 3
#: tokens come late in the order if this many groups have them, and more than the given share of all tokens are one
#: (so there can be no more than 2 ** COMMON_SHARE of them, whatever the size of the input)
COMMON_FROM, COMMON_SHARE = 4, 24
#: bits of a token's hash that are stored in sets, and in the matrix (a coincidence there adds a candidate, never loses one)
SET_BITS, TOKEN_BITS = 48, 40
#: sets that a task holds at a time, rows that it streams past them, and members behind one union
HELD, CHUNK, BLOCK = 64, 256, 128
#: sets that a task holds at a time where pairs are given; a row is the pairs of a set with those that are held together
PAIR_BLOCK = 128
#: entries of the matrix in a range of tokens, and pairs of entries in a unit of work
RANGE, PAIRS = 250_000, 2_000_000
#: a token whose entries pair with more others than this, on average, is crowded: its groups of up to FEW members are
#: compared where they meet, in blocks whose smallest sets have some PLACE shingles together
CROWD, FEW, PLACE = 8, 8, 250_000


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of ``part / whole`` or more, over shingles of ``width`` words."""

    part: int = 75
    whole: int = 100
    width: int = 5

    def least(self, n):
        """Tokens that a set of ``n`` shares with any set it links with."""
        return -(-n * self.part // self.whole)

    def stored(self, n):
        """Tokens of a set that the matrix has: two linked sets share one of them."""
        return n - self.least(n) + 1

    def enough(self, both, total):
        """Whether sets with ``total`` tokens together link if they share ``both``."""
        return both * (self.part + self.whole) >= self.part * total

    def reaches(self, query: np.ndarray, union: np.ndarray, least: int) -> bool:
        """Whether ``query`` may link with a set of ``least`` tokens or more within ``union``; exact for a single set."""
        total = len(query) + least
        return self.enough(min(len(query), len(union)), total) and self.enough(common(query, union), total)


class SetStore:
    """The sets of all documents, each computed once, bucketed by doc_id: joins on the id never move them.

    ``doc_id, n, set_key, minima, tokens``; key, minima and tokens are null for the empty set. The table's files are
    in the shared folder. Rows without doc_id are dealt by their text.
    """

    def __init__(self, docs: DataFrame, t: Threshold):
        self.spark = docs.sparkSession
        self.path = scratch(self.spark, "sets")
        self.name = "lakeweave_" + self.path.rsplit("-", 1)[1]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = docs.repartition(buckets, F.coalesce("doc_id", F.xxhash64("text")))
        made = dealt.mapInArrow(_sets(t), "doc_id long, n long, set_key binary, minima array<int>, tokens binary")
        made.write.bucketBy(buckets, "doc_id").option("path", self.path).option("compression", "none").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def full(self, ids: DataFrame) -> DataFrame:
        """The non-empty sets of ``ids`` (its column ``id``), with the other columns of ``ids``."""
        sets = self.table().where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "tokens")
        return sets.join(ids, "id")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _sets(t: Threshold):
    @lean
    def run(batches):
        shingler = Shingler(t.width)
        for batch in batches:
            sets = shingler.sets(batch.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, minima, tokens = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                for i, m in zip(full, min_hashes([sets[i] for i in full], MINIMA), strict=True):
                    keys[i], minima[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), m
                    tokens[i] = squeeze_sorted(sets[i] >> np.uint64(64 - SET_BITS))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.list_(pa.int32())), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "set_key", "minima", "tokens"])

    return run


def compare(held: DataFrame, streamed: DataFrame, t: Threshold, once: bool = False) -> DataFrame:
    """``g, a, b``: what ``held`` (g, chunk, id, tokens) and ``streamed`` (g, chunk, id, size, tokens, others) have in
    the same (g, chunk) and what reaches the threshold (``Threshold.reaches``).

    A task holds the sets of one (g, chunk) and streams the others past them, each against the held ids in its
    ``others``, or against all if that is null. ``once``: the first hit of a held id is enough.
    """
    kept = held.select("g", "chunk", F.lit(0).alias("role"), "id", F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<long>").alias("others"), "tokens")
    both = kept.unionByName(streamed.select("g", "chunk", F.lit(1).alias("role"), "id", "size", "others", "tokens"))
    dealt = both.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "role", "id")

    @lean
    def run(batches):
        place, kept = None, {}
        for batch in batches:
            hits: list[tuple[int, int, int]] = []
            g, chunk, role, ids, sizes, others, tokens = (c.to_pylist() for c in batch.columns)
            for at, r, i, size, wanted, packed in zip(zip(g, chunk, strict=True), role, ids, sizes, others, tokens, strict=True):
                if at != place:
                    place, kept = at, {}
                s = expand_sorted(packed)
                if r == 0:
                    kept.setdefault(i, []).append(s)  # rows that repeat a doc_id are one document
                    continue
                for k in list(kept) if wanted is None else wanted:
                    if any(t.reaches(x, s, size) for x in kept[k]):
                        hits.append((at[0], k, i))
                        if once:
                            del kept[k]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], names=["g", "a", "b"])

    return dealt.mapInArrow(run, "g long, a long, b long")


def deal_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, streamed) for ``compare``, without sets: ``g, chunk, id`` and ``g, chunk, id, others``.

    A block is some PAIR_BLOCK b's, a row each a with all its b's of a block, a chunk some CHUNK such rows. So n documents
    that are all paired with each other are n / PAIR_BLOCK rows each, and a b is held once a chunk, not once a pair. A block
    with many a's is many chunks, so a hub of any number of pairs is held in many tasks.
    """
    blocks = max(1, pairs.select("b").distinct().count() // PAIR_BLOCK)
    met = pairs.groupBy(F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("g"), F.col("a").alias("id")).agg(F.collect_set("b").alias("others"))
    met = cut(met, "dealt")
    counts = met.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    streamed = cut(met.join(counts, "g").select("g", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "others"), "streamed")
    forget(met)
    wanted = F.array_distinct(F.flatten(F.collect_set("others")))  # of a chunk's rows: some CHUNK x PAIR_BLOCK ids at most
    return streamed.groupBy("g", "chunk").agg(wanted.alias("ids")).select("g", "chunk", F.explode("ids").alias("id")), streamed


def compare_pairs(store: SetStore, pairs: DataFrame, t: Threshold) -> DataFrame:
    """The pairs ``a, b`` that link. Blocks of b's are held and each a is streamed once past those it is paired with."""
    held, streamed = deal_pairs(pairs)
    return compare(store.full(held), store.full(streamed), t).select("a", "b").where("a <> b")


def bucket_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: each class with the hubs of its buckets, where the two share enough minima.

    A bucket is one minimum; its hubs are its smallest class and one picked by hash, so a bucket of any size gives
    two pairs a class.
    """
    entries = classes.select("id", F.posexplode("minima").alias("slot", "key"))
    buckets = entries.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("h1"), F.min_by("id", F.xxhash64("id")).alias("h2")).where("size > 1")
    buckets = cut(buckets, "buckets")
    total = buckets.agg(F.sum("size")).first()[0] or 0
    met = join_hot(entries, buckets, ["slot", "key"], "size", total)
    pairs = met.select("id", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("b")).where("id <> b")
    pairs = pairs.groupBy(F.col("id").alias("a"), "b").count().where(F.col("count") >= SHARED_MINIMA)
    return pairs.select("a", "b")


def common_tokens(store: SetStore, named: DataFrame, tokens: int, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (TOKEN_BITS each) that many groups have, in order, and the logarithms of their counts.

    One class speaks for each group. Counts are complete: each task sends its sorted tokens in compact form to the
    tasks of their ranges. The share that a token must exceed bounds the list (``COMMON_SHARE``).
    """
    bits, least = _ranges(tokens), max(COMMON_FROM, (tokens >> COMMON_SHARE) + 1)
    speakers = store.full(named.where("id = c").select("id")).select("tokens")

    @lean
    def gather(batches):
        held, n = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(expand_sorted(packed) >> np.uint64(SET_BITS - TOKEN_BITS))
                n += len(held[-1])
                if n > 500_000:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = [(r, squeeze_sorted(found[i:j]), squeeze(counts[i:j])) for r, i, j in _parts(found, bits)]
        return _batch(rows, (pa.int32(), pa.binary(), pa.binary()), ["r", "tokens", "counts"])

    @lean
    def add(batches):
        place, held, n = None, [], 0
        for r, a, b in _rows(batches):
            if r != place:
                if held:
                    yield from often(*summed(held))
                place, held, n = r, [], 0
            held.append((expand_sorted(a), expand(b).view(np.int64)))
            n += len(held[-1][0])
            if n > 1_000_000:
                held, n = [summed(held)], 0
        if held:
            yield from often(*summed(held))

    def summed(held):
        found, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return found, np.bincount(at, np.concatenate([h[1] for h in held]).astype(float)).astype(np.int64)

    def often(found, counts):
        many = counts >= least
        if many.any():
            logs = np.log2(counts[many]).astype(np.uint8)
            yield _batch([(found[many].tobytes(), logs.tobytes())], (pa.binary(), pa.binary()), ["tokens", "logs"])

    sent = speakers.mapInArrow(gather, "r int, tokens binary, counts binary").repartition("r").sortWithinPartitions("r")
    lists = sent.mapInArrow(add, "tokens binary, logs binary").collect()
    found = np.frombuffer(b"".join(x["tokens"] for x in lists), np.uint64)
    logs = np.frombuffer(b"".join(x["logs"] for x in lists), np.uint8)
    order = np.argsort(found)
    return found[order], logs[order]


def _ranges(entries: int) -> int:
    """Bits of the token ranges that the matrix is dealt by, for RANGE entries each."""
    return min(16, max(4, (entries // RANGE).bit_length()))


def _parts(tokens: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the non-empty ranges in sorted tokens."""
    edges = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS - bits))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    yield from zip(full.tolist(), edges[full].tolist(), edges[full + 1].tolist(), strict=True)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def token_union(token, group, id_, after, size) -> tuple[np.ndarray, ...]:
    """One entry for each token and group: the smallest id, the most that may follow, the smallest set."""
    order = np.lexsort((id_, group, token))
    token, group, id_, after, size = (x[order] for x in (token, group, id_, after, size))
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
    return token[first], group[first], id_[first], np.maximum.reduceat(after, first), np.minimum.reduceat(size, first)


#: columns of entries of the matrix, as they travel
_ENTRIES = "tokens binary, groups binary, ids binary, after binary, size binary"


def _pack(token, group, id_, after, size) -> tuple[bytes, ...]:
    return squeeze_sorted(token), *(squeeze(x.view(np.uint64)) for x in (group, id_ - group, after, size))


def _unpack(token, group, id_, after, size) -> tuple[np.ndarray, ...]:
    group = expand(group).view(np.int64)
    return expand_sorted(token), group, expand(id_).view(np.int64) + group, expand(after).view(np.int64), expand(size).view(np.int64)


def windows(token, group, id_, after, size, t: Threshold) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The entries by (token, size), and for each the end of those after it that it may link with.

    Were this the first token that two sets share, no more could be shared than what follows it in either. So an entry
    reaches sets of up to ``after * (part + whole) / part - size`` tokens, and the others of its token that it may
    link with and that are no smaller lie side by side after it.
    """
    order = np.lexsort((group, size, token))
    token, group, id_, after, size = (x[order] for x in (token, group, id_, after, size))
    row = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
    span = np.int64(size.max() + 1)
    reach = np.minimum(after * (t.part + t.whole) // t.part - size, span - 1)
    ends = np.searchsorted(row * span + size, row * span + reach, "right")
    own = np.arange(1, len(token) + 1)
    return (token, group, id_, after, size), np.where(reach >= size, np.maximum(ends, own), own)


def candidates(entries: tuple[np.ndarray, ...], ends: np.ndarray, start: int, stop: int, t: Threshold, past: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """``ca, cb, a, b`` of the entries from ``start`` to ``stop`` with those in their windows (from ``past`` on), in
    bounded pieces."""
    _, group, id_, after, size = entries
    own = np.arange(start, stop)
    first = np.maximum(own + 1, past)
    many = ends[start:stop] - first
    own, first, many = own[many > 0], first[many > 0], many[many > 0]
    upto = np.cumsum(many)
    at = 0
    while at < len(own):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + PAIRS // 8, "right")))
        p = np.repeat(own[at:to], many[at:to])
        q = np.repeat(first[at:to], many[at:to]) + np.arange(len(p)) - np.repeat(upto[at:to] - many[at:to] - before, many[at:to])
        may = t.enough(after[q], size[p] + size[q])  # the other entry must reach this one, too
        p, q = p[may], q[may]
        swap = group[p] > group[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        if len(p):
            yield _once(group[p], group[q], id_[p], id_[q])
        at = to


def _once(ca, cb, a, b) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a, cb, ca))
    ca, cb, a, b = ca[order], cb[order], a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]))
    return ca[first], cb[first], a[first], b[first]


def crowded(entries: tuple[np.ndarray, ...], ends: np.ndarray) -> np.ndarray:
    """Whether an entry's token is crowded."""
    token = entries[0]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(starts, len(token)))
    pairs = np.add.reduceat(ends - np.arange(1, len(token) + 1), starts)
    return np.repeat(pairs > CROWD * many, many)


def crowd_units(entries: tuple[np.ndarray, ...], ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(entries, own, past) of units of work on crowded tokens: the first ``own`` entries, with those from ``past`` on.

    Small tokens share a unit. A token of more than PLACE shingles is cut into blocks, and two blocks are a unit.
    """
    token, size = entries[0], entries[4]
    edges = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token)).tolist()
    upto = np.concatenate([[0], np.cumsum(size)])
    begun = 0
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if upto[j] - upto[begun] <= PLACE:
            continue
        if i > begun:
            yield np.arange(begun, i), i - begun, 0
        begun = i
        if upto[j] - upto[i] > PLACE:
            block = ((upto[i + 1 : j + 1] - upto[i] - 1) // PLACE).astype(np.int64)
            cuts = [i, *(i + 1 + np.flatnonzero(block[1:] != block[:-1])).tolist(), j]
            blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
            for k, (a, b) in enumerate(blocks):
                yield np.arange(a, b), b - a, 0
                last = int(ends[a:b].max())
                for x, y in blocks[k + 1 :]:
                    if x < last:
                        yield np.concatenate([np.arange(a, b), np.arange(x, y)]), b - a, b - a
            begun = j
    if begun < len(token):
        yield np.arange(begun, len(token)), len(token) - begun, 0


class Crowd:
    """The members of the small groups that meet in a unit of work, compared there."""

    def __init__(self, groups: list[int], ids: list[int], sets: list[np.ndarray], t: Threshold):
        order = np.argsort(np.array(groups, np.int64), kind="stable")
        self.t, self.ids, self.sets = t, np.array(ids, np.int64)[order], [sets[i] for i in order]
        self.group, self.start, self.many = np.unique(np.array(groups, np.int64)[order], return_index=True, return_counts=True)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.parities = Parities(self.sets)
        self.root = np.arange(len(self.group))

    def _place(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.group, group), max(0, len(self.group) - 1))
        return at, self.group[at] == group if len(self.group) else np.zeros(len(group), bool)

    def _top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return int(x)

    def left(self, ca, cb, a, b) -> tuple[np.ndarray, ...]:
        """What is left of the pairs: one with a larger group as it is; of the others those that link and that join
        groups not joined before, with two members that link."""
        (x, known), (y, both) = self._place(ca), self._place(cb)
        known &= both
        found = [tuple(v[~known] for v in (ca, cb, a, b))]
        x, y = x[known], y[known]
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        apart = self.root[x] != self.root[y]
        x, y = x[apart], y[apart]
        step = max(1, PAIRS // 8 // int(self.many.max(initial=1)) ** 2)
        for at in range(0, len(x), step):
            if linked := list(self._links(x[at : at + step], y[at : at + step])):
                found.append(tuple(np.array(v, np.int64) for v in zip(*linked, strict=True)))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def _links(self, x, y) -> Iterator[tuple[int, int, int, int]]:
        t, product = self.t, self.many[x] * self.many[y]
        pair = np.repeat(np.arange(len(x)), product)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(product) - product, product)
        i, j = self.start[x[pair]] + k // self.many[y[pair]], self.start[y[pair]] + k % self.many[y[pair]]
        total = self.size[i] + self.size[j]
        # the sets differ in d tokens or more, so share (total - d) / 2 or fewer
        may = (total - self.parities.apart(i, j)) * (t.part + t.whole) >= 2 * t.part * total
        for p, i, j in zip(pair[may].tolist(), i[may].tolist(), j[may].tolist(), strict=True):
            u, v = self._top(x[p]), self._top(y[p])
            if u != v and t.enough(common(self.sets[i], self.sets[j]), len(self.sets[i]) + len(self.sets[j])):
                self.root[max(u, v)] = min(u, v)
                yield self.group[x[p]], self.group[y[p]], self.ids[i], self.ids[j]


def qualifying_groups(store: SetStore, named: DataFrame, tokens: int, t: Threshold) -> DataFrame:
    """Pairs of groups that meet in a row of the matrix where they may have a link: ``ca, cb`` and a witness of each, ``a, b``.

    ``named``: the classes' ``id`` and group ``c``; the copies of a class play no part.

    The matrix is stored in units of work of a bounded number of pairs: a unit is some rows, or a part of the entries
    of a token that very many groups have, so no token is one task's burden. Units of crowded tokens get the sets of
    their small groups, and pairs of such groups are left out unless they link (``Crowd``).
    """
    bits = _ranges(tokens // 4)
    listed, logs = common_tokens(store, named, tokens, t)
    release(store.spark)
    known = store.spark.sparkContext.broadcast((listed, logs))  # 9 bytes a token, and 2 ** COMMON_SHARE tokens at most
    del listed, logs
    rows = store.full(named.select("id", "c")).select("id", "c", "size", "tokens")

    @lean
    def first_parts(batches):
        held, n = [], 0
        listed, logs = known.value
        for i, c, size, packed in _rows(batches):
            s = expand_sorted(packed)
            short = s >> np.uint64(SET_BITS - TOKEN_BITS)
            order = s.copy()
            if len(listed):
                at = np.minimum(np.searchsorted(listed, short), len(listed) - 1)
                order += np.where(listed[at] == short, (logs[at].astype(np.uint64) + np.uint64(1)) << np.uint64(56), np.uint64(0))
            part = short[np.argsort(order)[: int(t.stored(size))]]
            held.append((part, i, c, size))
            n += len(part)
            if n > 500_000:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    def send(held) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[0]) for h in held]
        id_, group, size = (np.repeat(np.array([h[k] for h in held], np.int64), sizes) for k in (1, 2, 3))
        after = size - np.concatenate([np.arange(k) for k in sizes])
        entries = token_union(np.concatenate([h[0] for h in held]), group, id_, after, size)
        held.clear()
        rows = []
        for r, i, j in _parts(entries[0], bits):
            rows.append((r, *_pack(*(x[i:j] for x in entries))))
            if len(rows) == 512:
                yield _batch(rows, (pa.int32(), *[pa.binary()] * 5), ["r", *_NAMES])
                rows = []
        if rows:
            yield _batch(rows, (pa.int32(), *[pa.binary()] * 5), ["r", *_NAMES])

    @lean
    def units(batches):
        place, held = None, []
        for r, *packed in _rows(batches):
            if r != place:
                yield from divide(place, held)
                place, held = r, []
            held.append(_unpack(*packed))
        yield from divide(place, held)

    def divide(r, held):
        if not held:
            return
        entries = token_union(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        entries, ends = windows(*entries, t)
        crowd = crowded(entries, ends)
        if crowd.any():
            many = tuple(x[crowd] for x in entries)
            for k, (at, own, past) in enumerate(crowd_units(*windows(*many, t))):
                yield _batch([((r << 32) + k, own, past, *_pack(*(x[at] for x in many)))], (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5), ["u", "n", "past", *_NAMES])
            entries = tuple(x[~crowd] for x in entries)
            if not len(entries[0]):
                return
            entries, ends = windows(*entries, t)
        own = np.arange(1, len(ends) + 1)
        upto = np.cumsum(ends - own)
        at = 0
        while at < len(own):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
            if upto[to - 1] > before:
                last = int(ends[at:to].max())
                part = tuple(x[at:last] for x in entries)
                yield _batch([(None, to - at, 0, *_pack(*part))], (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5), ["u", "n", "past", *_NAMES])
            at = to

    @lean
    def match(batches):
        for n, *packed in _rows(batches):
            entries, ends = windows(*_unpack(*packed), t)
            for found in candidates(entries, ends, 0, n, t):
                yield away(found)

    def away(found) -> pa.RecordBatch:
        part = mixed((found[0] * _LARGE + found[1]).view(np.uint64)) % np.uint64(places)
        order = np.argsort(part, kind="stable")
        part, found = part[order], [x[order].view(np.uint64) for x in found]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = [(int(part[i]), *(squeeze(x[i:j]) for x in found)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return _batch(rows, (pa.int32(), *[pa.binary()] * 4), ["r", "ca", "cb", "a", "b"])

    @lean
    def meeting(batches):
        for u, packed in _rows(batches):
            found = np.unique(expand(packed).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), u)), pa.array(found)], names=["u", "g"])

    @lean
    def match_crowd(batches):
        groups, ids, sets = [], [], []
        for _, c, i, packed_set, n, past, *packed in _rows(batches):
            if n is None:
                groups.append(c)
                ids.append(i)
                sets.append(expand_sorted(packed_set))
                continue
            # a unit's own row comes after its sets
            crowd = Crowd(groups, ids, sets, t)
            groups, ids, sets = [], [], []
            entries, ends = windows(*_unpack(*packed), t)
            for found in candidates(entries, ends, 0, n, t, past):
                found = crowd.left(*found)
                if len(found[0]):
                    yield away(found)

    @lean
    def combine(batches):
        place, held, n = None, [], 0
        for r, *packed in _rows(batches):
            if held and (r != place or n > 250_000):
                yield once(held)
                held, n = [], 0
            place = r
            held.append([expand(x).view(np.int64) for x in packed])
            n += len(held[-1][0])
        if held:
            yield once(held)

    def once(held):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _once(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["ca", "cb", "a", "b"])

    sent = rows.mapInArrow(first_parts, f"r int, {_ENTRIES}").repartition("r").sortWithinPartitions("r")
    matrix = cut(sent.mapInArrow(units, f"u long, n long, past long, {_ENTRIES}"), "matrix")
    known.destroy()
    partitions = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    places = max(8, partitions // 4)  # pairs travel together, and those that met in several rows become one before they are rows
    packed = "r int, ca binary, cb binary, a binary, b binary"
    pairs = matrix.where("u is null").select("n", *_NAMES).repartition(partitions).mapInArrow(match, packed)
    crowds = matrix.where("u is not null")
    if not crowds.isEmpty():
        small = named.groupBy("c").count().where(F.col("count") <= FEW).select("c")
        met = crowds.select("u", "groups").mapInArrow(meeting, "u long, g long").join(named.join(small, "c").select("id", "c"), F.col("g") == F.col("c"))
        sets = store.full(met.select("u", "c", "id")).select("u", "c", "id", F.col("tokens").alias("set"))
        dealt = sets.unionByName(crowds, allowMissingColumns=True).select("u", "c", "id", "set", "n", "past", *_NAMES)
        pairs = pairs.unionByName(dealt.repartition("u").sortWithinPartitions("u", F.col("n").asc_nulls_first()).mapInArrow(match_crowd, packed))
    met = pairs.repartition("r").sortWithinPartitions("r").mapInArrow(combine, "ca long, cb long, a long, b long")
    met = cut(met.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("w")).select("ca", "cb", "w.a", "w.b"), "qualifying")
    forget(matrix)
    release(store.spark)
    return met


_NAMES = ["tokens", "groups", "ids", "after", "size"]
_LARGE = np.int64(0x9E3779B1)


def _spread(n: str) -> Column:
    """A row for each number below the column ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def unions(members: DataFrame) -> DataFrame:
    """``g, id`` (a block), ``size`` (of the smallest set behind it) and ``tokens``: the token union of each block.

    ``members``: g, block, size, tokens. A block has some BLOCK members, however large its group is.
    """

    @lean
    def run(batches):
        place, held, n, low = None, [], 0, 0
        for g, block, size, packed in _rows(batches):
            if (g, block) != place:
                if held:
                    yield one(place, held, low)
                place, held, n, low = (g, block), [], 0, size
            held.append(expand_sorted(packed))
            n, low = n + len(held[-1]), min(low, size)
            if n > 500_000:
                held = [np.unique(np.concatenate(held))]
                n = len(held[0]) // 2
        if held:
            yield one(place, held, low)

    def one(place, held, low):
        return _batch([(*place, low, squeeze_sorted(np.unique(np.concatenate(held))))], (pa.int64(), pa.int64(), pa.int64(), pa.binary()), ["g", "id", "size", "tokens"])

    dealt = members.select("g", "block", "size", "tokens").repartition("g", "block").sortWithinPartitions("g", "block")
    return dealt.mapInArrow(run, "g long, id long, size long, tokens binary")


def open_groups(store: SetStore, named: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """Links ``a, b`` between the members of each pair of groups ``ca, cb`` (with ``many_a, many_b`` members).

    The classes of the smaller group are the queries. The larger one is opened a block at a time, where the overlap of
    a query with the block's union reaches what a link needs. A task holds HELD sets and streams CHUNK rows, whatever
    the number of queries and of blocks.
    """
    swap = F.col("many_a") > F.col("many_b")
    query, group = F.when(swap, F.col("cb")).otherwise(F.col("ca")), F.when(swap, F.col("ca")).otherwise(F.col("cb"))
    asked = pairs.select(query.alias("q"), group.alias("g"), F.ceil(F.greatest("many_a", "many_b") / BLOCK).cast("long").alias("blocks"))
    groups = cut(asked.select("g", "blocks").distinct(), "groups")
    members = named.join(groups, F.col("c") == F.col("g")).select("id", "g", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    members = cut(members, "members")
    stored = cut(unions(store.full(members)), "unions")
    # queries that share a group are dealt in fives and tens to the places that hold them; unions go past each such place
    queries = cut(asked.join(named, F.col("q") == F.col("c")).select("g", "blocks", "id").distinct(), "queries")
    places = cut(queries.groupBy("g", "blocks").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("long").alias("qs")).withColumn("gs", F.ceil(F.col("blocks") / CHUNK).cast("long")), "places")
    held = queries.join(places.drop("blocks"), "g").select("g", "id", "qs", "gs", _spread("gs").alias("x"))
    held = held.select("g", (F.pmod(F.xxhash64("id"), F.col("qs")) * F.col("gs") + F.col("x")).alias("chunk"), "id")
    passing = stored.join(places, "g").select("g", "id", "size", "tokens", "gs", _spread("qs").alias("x"))
    passing = passing.withColumn("chunk", F.col("x") * F.col("gs") + F.pmod("id", F.col("gs"))).withColumn("others", F.lit(None).cast("array<long>"))
    reached = cut(compare(store.full(held), passing, t).select("g", F.col("a").alias("id"), F.col("b").alias("block")), "reached")
    opened = cut(reached.groupBy("g", "block").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("long").alias("qs")), "opened")
    # a place now: a block of a group, and a part of the queries that reach it
    at = (F.pmod(F.xxhash64("id"), F.col("qs")) + F.col("block") * F.lit(1 << 32)).alias("chunk")
    held = reached.join(opened, ["g", "block"]).select("g", at, "id")
    streamed = members.join(opened, ["g", "block"]).select("g", "block", "id", _spread("qs").alias("x"))
    streamed = streamed.select("g", (F.col("x") + F.col("block") * F.lit(1 << 32)).alias("chunk"), "id", F.lit(None).cast("array<long>").alias("others"))
    links = cut(compare(store.full(held), store.full(streamed), t, once=True).select("a", "b").where("a <> b"), "links")
    forget(groups, members, stored, queries, places, reached, opened)
    return links


def _linked(store: SetStore, classes: DataFrame, twice: DataFrame, tokens: int, t: Threshold) -> DataFrame:
    """``id, component`` of every class that is linked with another. ``twice``: links that are given."""
    links = cut(compare_pairs(store, cut(bucket_pairs(classes), "pairs"), t).unionByName(twice), "links")
    groups = cut(components(links), "groups")
    release(store.spark)
    named = cut(classes.select("id", "n").join(groups, "id", "left").select("id", "n", F.coalesce("component", "id").alias("c")), "named")
    near = qualifying_groups(store, named, tokens, t)
    sizes = named.groupBy("c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("many"))
    one, two = (sizes.select(*[F.col(c).alias(f"{c}_{k}") for c in sizes.columns]) for k in ("a", "b"))
    met = near.join(one, F.col("ca") == F.col("c_a")).join(two, F.col("cb") == F.col("c_b"))
    fits = (F.col("low_a") * t.part <= F.col("high_b") * t.whole) & (F.col("low_b") * t.part <= F.col("high_a") * t.whole)
    met = cut(met.where(fits).select("ca", "cb", "a", "b", "many_a", "many_b"), "met")
    links = links.unionByName(cut(compare_pairs(store, met.select("a", "b"), t), "links"))
    groups = cut(components(links), "groups")
    # groups that their witnesses didn't join are opened, unless the witnesses were all there was
    a, b = (groups.select(F.col("id").alias(f"c{k}"), F.col("component").alias(f"g{k}")) for k in ("a", "b"))
    rest = met.where("many_a > 1 or many_b > 1").join(a, "ca", "left").join(b, "cb", "left")
    rest = cut(rest.where(F.coalesce("ga", "ca") != F.coalesce("gb", "cb")).select("ca", "cb", "many_a", "many_b"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(open_groups(store, named.select("id", "c"), rest, t))
        groups = cut(components(links), "groups")
    return groups


def near_duplicates(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the set's size and the smallest doc_id reachable by links.

    Two documents link when ``whole * |A n B| >= part * |A u B|``. Null or wordless texts have an empty set and link
    with nothing; rows that repeat a doc_id are one document, which links through any of its texts; a row without
    doc_id belongs to the component of its equals, and to none (null) if it has no equal. An empty table gives no rows;
    texts of any length are read whole; other columns play no part.
    """
    small_batches(docs.sparkSession, 1000)
    store = SetStore(docs.select(F.col("doc_id").cast("long"), "text"), t)
    try:
        release(store.spark)
        sets = cut(store.table().select("doc_id", "n", "set_key"), "sizes")
        named = store.table().where("n > 0 and doc_id is not null").groupBy("set_key")
        named = cut(named.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.count(F.lit(1)).alias("members")), "classes")
        total, tokens = named.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        keyed = named.select("set_key", "id", "members")
        full = sets.where("n > 0")
        member = join_hot(full.where("doc_id is not null").select("doc_id", "set_key"), keyed, ["set_key"], "members", total)
        # rows that repeat a doc_id with other texts are one document, so their classes are linked
        twice = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.collect_set("id").alias("bs")).where("a < z")
        twice = twice.select("a", F.explode("bs").alias("b")).where("a <> b")
        classes = named.groupBy("id").agg(F.min("n").alias("n"), F.first("minima").alias("minima"))
        groups = _linked(store, classes, twice, tokens, t)
    finally:
        store.drop()
    named = keyed.join(groups, "id", "left").select("set_key", "members", F.coalesce("component", "id").alias("component_id"))
    out = join_hot(full, named, ["set_key"], "members", total, "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is its component's smallest; rows in no component stay.

    Rows without doc_id stay, as no id names them; so do empty texts, and rows that repeat a doc_id that stays. An
    empty table gives no rows.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), t).where("doc_id <> component_id")
    name = fresh(*docs.columns)("gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").cast("long") == F.col(name), "left_anti")
