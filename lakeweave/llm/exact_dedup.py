"""Exact deduplication by compressed radix tries over partitions of length and content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import ascii_lower, cut, forget, fresh, small_batches


class RadixTrie:
    """A compressed radix (Patricia) trie over byte strings.

    A node is ``[label, children by first byte, terminal]``. A terminal belongs to a whole key that was inserted;
    ``held`` counts the label bytes in memory, and ``weights`` those of each subtree of the root.
    """

    def __init__(self):
        self.root, self.held, self.terminals = [b"", {}, None], 0, 0
        self.weights: dict[int, int] = {}

    def insert(self, key: bytes, first, merge: Callable):
        """Sets the key's terminal to ``first``, or to ``merge(terminal)`` if it has one; returns the terminal."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.held += len(key) - at
                self.weights[key[0]] = self.weights.get(key[0], 0) + len(key) - at
                node, at = child, len(key)
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same
        if node[2] is None:
            node[2] = first
            self.terminals += 1
        else:
            node[2] = merge(node[2])
        return node[2]

    def spill(self, most: int = 0) -> Iterator[tuple[bytes, object]]:
        """(key, terminal) of whole subtrees of the root, the heaviest first, until ``most`` label bytes are held.

        Each subtree is freed once it is given out. With 0, everything goes, the empty key too.
        """
        for first in sorted(self.weights, key=lambda b: (-self.weights[b], b)):
            if self.held <= most and most:
                return
            self.held -= self.weights.pop(first)
            stack = [(b"", self.root[1].pop(first))]
            while stack:
                above, (label, children, end) = stack.pop()
                key = above + label
                if end is not None:
                    self.terminals -= 1
                    yield key, end
                stack += [(key, c) for c in children.values()]
        if not most and self.root[2] is not None:
            end, self.root[2] = self.root[2], None
            self.terminals -= 1
            yield b"", end


def _common(label: bytes, key: bytes, at: int) -> int:
    """Bytes that ``label`` and ``key[at:]`` share at their start, found by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label[:half] == key[at : at + half]:
            low = half
        else:
            high = half - 1
    return low


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return (text or "").encode().lower()  # bytes.lower() touches A-Z only


def _largest(a, b):
    """The larger of two identifiers; any is larger than none."""
    return b if a is None else a if b is None else max(a, b)


#: a row for each document: what it is and the terminal that its text ended in. A row for each terminal that a task gave
#: out: its number, its whole key (``content``), the best identifier and how many documents ended in it
_GATHERED = "doc_id long, text_sha256 string, terminal long, bytes long, hash long, content binary, copies long"
_KINDS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("terminal", pa.int64()), ("bytes", pa.int64()), ("hash", pa.int64()), ("content", pa.binary()), ("copies", pa.int64())])
#: terminals that a trie holds before its heaviest subtrees go (nodes take memory besides their labels)
TERMINALS = 20_000


def _batches(rows: Iterator[tuple], size, kinds: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` in ``size(row)``, and one row at least."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n > most:
            yield _batch(held, kinds)
            held, n = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _gather(held_bytes: int):
    """Every task's own copies meet in its trie first: a text with any number of copies leaves a task as one key."""

    def run(batches):
        trie, number = RadixTrie(), TaskContext.get().partitionId() << 33

        def out(most: int):
            rows = ((end[1], None, end[0], len(key), end[3], key, end[2]) for key, end in trie.spill(most))
            return _batches(rows, lambda r: 100 + len(r[5]), _KINDS)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = normalised(text)
                digest = hashlib.sha256(content)
                first = [number, doc_id, 1, int.from_bytes(digest.digest()[:8], "big", signed=True)]
                end = trie.insert(content, first, lambda t, i=doc_id: [t[0], _largest(t[1], i), t[2] + 1, t[3]])
                number += end[0] == number
                rows.append((doc_id, digest.hexdigest(), end[0], None, None, None, None))
            yield _batch(rows, _KINDS)
            if trie.held > held_bytes or trie.terminals > TERMINALS:
                yield from out(held_bytes // 2 if trie.terminals <= TERMINALS else 0)
        yield from out(0)

    return run


_OWNERS = "terminal long, keep_id long, group_size long"
_OWNER_KINDS = pa.schema([("terminal", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _own(held_bytes: int):
    """Keys come by length and hash. Between two of them every key in the trie is complete, so that subtrees may go."""

    def run(batches):
        trie, current = RadixTrie(), None

        def out(most: int):
            rows = ((t, best, copies) for _, (terminals, best, copies) in trie.spill(most) for t in terminals)
            return _batches(rows, lambda r: 100, _OWNER_KINDS)

        for batch in batches:
            for n, digest, content, terminal, best, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, digest) != current and (trie.held > held_bytes or trie.terminals > TERMINALS):
                    yield from out(held_bytes // 2 if trie.terminals <= TERMINALS else 0)
                current = n, digest
                trie.insert(content, ([terminal], best, copies), lambda t, i=terminal, b=best, c=copies: (_add(t[0], i), _largest(t[1], b), t[2] + c))
        yield from out(0)

    return run


def _add(held: list, x) -> list:
    held.append(x)
    return held


def text_owners(docs: DataFrame, held_bytes: int = 32_000_000) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``doc_id, text_sha256, terminal``, and ``terminal, keep_id, group_size`` of each terminal.

    Each task gathers its copies in a trie of whole texts, and gives a terminal to each; then partitions by (length,
    content hash) insert those texts into tries of their own, in which equal ones end in one terminal, whose largest
    identifier owns them. Tries over ``held_bytes`` spill their heaviest subtrees. Rows find their owner by the
    terminal, so texts are equal by their bytes and never by a hash.
    """
    small_batches(docs.sparkSession)
    gathered = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_gather(held_bytes), _GATHERED), "gathered")
    keys = gathered.where("content is not null").select("bytes", "hash", "content", "terminal", F.col("doc_id").alias("best"), "copies")
    dealt = keys.repartition("bytes", "hash").sortWithinPartitions("bytes", "hash")
    owners = cut(dealt.mapInArrow(_own(held_bytes), _OWNERS), "owners")
    rows = cut(gathered.where("content is null").select("doc_id", "text_sha256", "terminal"), "rows")
    forget(gathered)
    return rows, owners


def dedup_plan(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row of ``docs``, which needs ``doc_id`` and ``text``.

    Texts are equal if identical after lower-casing A-Z; null is empty. The row with the largest doc_id stays; a null
    doc_id is below any other. Of rows that repeat text and doc_id every one is marked kept (``drop_duplicates``
    keeps a single one). Other columns play no part. Empty tables give no rows.
    """
    rows, owners = text_owners(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # a terminal has no more rows than the task that made it, so no key is hot
    return rows.join(owners, "terminal").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs`` unchanged; of rows that repeat text and doc_id one stays.

    Nulls, ties and empty tables: as in ``dedup_plan``.
    """
    new = fresh(*docs.columns)
    id_, digest, more = new("id"), new("sha256"), new("more")
    stay = dedup_plan(docs.select("doc_id", "text")).where("kept")
    stay = stay.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest)).agg((F.count(F.lit(1)) > 1).alias(more))
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.sha2(text, 256) == F.col(digest))
    rows = docs.join(stay, mine)
    once = rows.where(~F.col(more)).select(*docs.columns)
    # rows whose text and doc_id another repeats
    many = rows.where(more).dropDuplicates([id_, digest]).select(*docs.columns)
    return once.unionByName(many)
