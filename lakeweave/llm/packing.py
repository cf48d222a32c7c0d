"""Packing token sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, forget, in_order, small_batches
from lakeweave.llm.tokenizing import TextEncoder
from lakeweave.llm.workers import lean


@dataclass
class PackPlan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on lie at ``offset`` in the sequences from ``sequence`` on."""

    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    padding: float = 0.0


def shortest_pack_first(histogram: dict[int, int], capacity: int = 1024) -> PackPlan:
    """Patterns of lengths and how often each is used, for ``histogram[length]`` pieces of each length.

    Lengths are placed longest first, each into the pack with the most room; packs with the same content are one
    pattern with a count, and a count is divided where the pieces of a length run out. Work follows the number of
    patterns, not of pieces.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # ascending; the last is the room of the shortest packs

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            bisect.insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not by_room[rooms[-1]]:
                del by_room[rooms.pop()]
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, there = by_room[room].popitem()
                used = min(there, left)
                if used < there:
                    by_room[room][pattern] = there - used
                put(room - length, pattern + (length,), used)
            else:  # as many new packs as the pieces of this length fill
                used = -(-left // (capacity // length))
                put(capacity - length, (length,), used)
            left -= used
    packs = {pattern: count for held in by_room.values() for pattern, count in held.items()}
    plan = PackPlan(patterns=sorted(packs.items(), reverse=True))
    ranks: dict[int, int] = {}
    for pattern, count in plan.patterns:
        offset = 0
        for length in pattern:
            plan.runs.append((length, ranks.get(length, 0), plan.sequences, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        plan.sequences += count
        plan.padding += count * (0 if offset & (offset - 1) == 0 else capacity - offset)
    plan.padding /= max(1, plan.sequences * capacity)
    return plan


def _cutter(tokenizer_path: str, end_id: int, longest: int, with_ids: bool) -> Callable:
    def run(batches):
        encoder, end = TextEncoder.shared(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, encoded = batch.column(0).to_pylist(), encoder.encode(batch.column(1))
            out = [[], [], [], [], [], []]
            for doc_id, ids in zip(rows, encoded, strict=True):
                ids = ids + end
                n = len(ids) // 4
                for a in range(0, n, longest):
                    piece = ids[4 * a : 4 * (a + longest)]
                    for column, x in zip(out, (doc_id, a, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None), strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names=names[: 5 + with_ids])

    return lean(run, keep=True)


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 0, longest: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every document's ids and an end id, cut into pieces of ``longest`` and a last one of what is left."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(tokenizer_path, end_id, longest, with_ids), schema)


def _histogram(pieces: DataFrame, longest: int) -> dict[int, int]:
    """Pieces of each length, were the documents of ``pieces`` cut after every ``longest`` ids."""
    n = F.col("doc_tokens")
    cut_up = pieces.where("start = 0").groupBy((n % longest).alias("rest")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.floor(n / longest)).alias("full")).collect()
    rests = {r["rest"]: r["count"] for r in cut_up if r["rest"]}
    full = sum(r["full"] for r in cut_up)
    return rests | ({longest: full} if full else {})


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024, most_padding: float = 0.04, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Pieces are ``capacity`` long but for each document's last one. Where the lengths show that these would pack with
    more than ``most_padding`` of all places empty, documents are cut after half, a quarter and so on of ``capacity``
    ids (down to a 16th): the first of these that packs well, or else the best. Texts are tokenized once, and once
    more only for such a finer cut. Null text is empty: its one piece is the end id. Rows that repeat a doc_id, or have
    none, are documents of their own. Texts of any length are encoded whole. An empty table gives no rows. Other columns play no part.
    """
    pieces = cut(pieces_of(docs, tokenizer_path, end_id, capacity, with_ids), "pieces")
    tried, longest = {}, capacity
    while longest * 16 >= capacity and longest:
        tried[longest] = shortest_pack_first(_histogram(pieces, longest), capacity).padding
        if tried[longest] <= most_padding:
            break
        longest //= 2
    best = min(tried, key=lambda k: (tried[k] > most_padding, tried[k], -k))
    if best != capacity:
        forget(pieces)
        pieces = cut(pieces_of(docs, tokenizer_path, end_id, best, with_ids), "pieces")
    ranked = in_order(pieces, F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("ids_crc32"))
    counted = {r["length"]: (r["count"], r["first"]) for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("count"), F.min("position").alias("first")).collect()}
    plan = shortest_pack_first({k: n for k, (n, _) in counted.items()}, capacity)
    # a piece's position in the order (length desc, ...) tells its length and rank at once
    runs = sorted((counted[length][1] + rank, sequence, offset) for length, rank, sequence, offset in plan.runs)
    starts, sequences, offsets = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(1, np.int64),) * 3

    @F.pandas_udf("sequence_id long, offset long")
    def place(position: pd.Series) -> pd.DataFrame:
        at = position.to_numpy(np.int64)
        run = np.searchsorted(starts, at, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + at - starts[run], "offset": offsets[run]})

    return ranked.withColumn("_p", place("position")).select(*[c for c in ranked.columns if c != "position"], "_p.sequence_id", "_p.offset")
