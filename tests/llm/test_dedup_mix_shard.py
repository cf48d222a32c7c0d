import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeweave.llm import exact_dedup, mixing, sharding
from lakeweave.llm.exact_dedup import RadixTrie
from tests.llm.helpers import SCHEMA, corpus, empty, frame


def lower(text):
    return (text or "").encode().lower()


def test_trie_is_a_dictionary():
    rng = random.Random(1)
    for bound in (3, 40):
        trie, want, out = RadixTrie(), {}, {}
        for i in range(500):
            key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, bound)))
            trie.insert(key, (i, 1), lambda t, i=i: (max(t[0], i), t[1] + 1))
            best, n = want.get(key, (-1, 0))
            want[key] = (max(best, i), n + 1)
        shared = sum(map(len, want))
        assert trie.held <= shared and (bound == 40 or trie.held < shared) and trie.terminals == len(want)
        heaviest = max(trie.weights, key=trie.weights.get)
        for key, end in trie.spill(trie.held - 1):  # one subtree is enough
            assert key[0] == heaviest
            out[key] = end
        assert 0 < len(out) < len(want) and trie.held == sum(trie.weights.values())
        out |= dict(trie.spill())
        assert out == want and list(trie.spill()) == [] and trie.held == trie.terminals == 0


def test_dedup_against_a_dictionary(spark):
    rows = corpus() + [(500, "Same Text", "en", "s", 1), (500, "same text", "en", "s", 1), (None, "SAME text", "en", "s", 1), (None, None, "en", "s", 1)]
    rows += [(600, "Ähnlich ß", "en", "s", 1), (601, "ähnlich ß", "en", "s", 1), (602, "x" * 300_000, "en", "s", 1), (603, "X" * 300_000, "en", "s", 1)]
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = []
    for r in rows:
        ids = groups[lower(r[1])]
        best = max((i for i in ids if i is not None), default=None)
        want.append((r[0], best, len(ids), r[0] == best, hashlib.sha256(lower(r[1])).hexdigest()))
    docs = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("kept", "keep_id", "terminal", "bytes", "_bytes", "id", "sha256", "_hot")})
    assert sorted(map(str, map(tuple, exact_dedup.dedup_plan(docs).collect()))) == sorted(map(str, want))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert sorted(lower(r.text) for r in kept) == sorted(groups) and {r.kept for r in kept} == {r._hot for r in kept} == {"mine"}
    assert all(r.doc_id == max((i for i in groups[lower(r.text)] if i is not None), default=None) for r in kept)


def test_dedup_with_tiny_memory_and_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TERMINALS", 7)
    rows = [(i, "hot text" if i % 3 else f"{i % 7} text {i}", "en", "s", 1) for i in range(3000)]
    found, owners = exact_dedup.text_owners(frame(spark, rows, parts=5), held_bytes=200)
    got = found.join(owners, "terminal").collect()
    assert len(got) == 3000 and len({r.keep_id for r in got}) == 1001
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(2999, 2000)}
    assert exact_dedup.dedup_plan(empty(spark)).count() == 0
    assert exact_dedup.drop_duplicates(empty(spark)).count() == 0


def targets_by_hand(sizes, most=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > most * sizes[s] + 1e-9]
        if not over:
            return held | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        held |= {s: most * sizes[s] for s in over}


def test_mix_against_repeated_resharing(spark):
    rows = corpus() + [(900 + i, "a b c", "en", "tiny", 5) for i in range(2)] + [(950, None, "en", "void", 0)]
    got = mixing.plan_mix(frame(spark, rows).withColumn("target", F.lit("clash"))).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (int(rate) * r.size, (int(rate) + 1) * r.size) and r.taken <= 3 * r.size
    again = {(r.doc_id, r.text): r.taken for r in mixing.plan_mix(frame(spark, rows, parts=7)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in got}
    extra = ("size", "source_size", "copies", "taken", "copy", "class", "_u")
    mixed = mixing.mix(frame(spark, rows).withColumns({c: F.lit(777) for c in extra}))
    assert mixed.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), *extra]
    mixed = mixed.collect()
    assert len(mixed) == sum(r.copies for r in got) and all(r[c] == 777 for r in mixed for c in extra)
    assert mixing.plan_mix(empty(spark)).count() == 0


@pytest.mark.parametrize("most_lookups", [100_000, 0])
def test_mix_comes_near_its_targets(spark, monkeypatch, most_lookups):
    """Sources of 50 documents, some as long as all others of their source together; by both ways of looking rates up."""
    monkeypatch.setattr(mixing, "MOST_LOOKUPS", most_lookups)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(5 * 2 ** (rng.random() * 8))), "en", f"s{i % 8}", 0) for i in range(400)]
    rows[3] = (3, " ".join(["w"] * 15_000), "en", "s3", 0)
    got = mixing.plan_mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert len(got) == 8 and all(abs(r.t / r.x - 1) < 0.05 for r in got)


def test_extra_copies_are_as_likely_as_the_fraction(spark):
    rows = [(i, " ".join(["w"] * (10 + i % 50)), "en", f"s{i % 2}", 0) for i in range(200)]
    docs = frame(spark, rows, parts=1).cache()
    taken = defaultdict(int)
    for seed in range(12):
        for r in mixing.plan_mix(docs, seed).collect():
            taken[r.source] += r.taken / r.size
    rate = {r.source: r.target / r.source_size for r in mixing.plan_mix(docs).collect()}
    assert all(abs(taken[s] / 1200 / rate[s] - 1) < 0.04 for s in rate)


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 40))]
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = [(b, i) for i, b in enumerate(bins) if b >= s]
            if fit:
                b, i = min(fit)
                bins[i] = b - s
            else:
                bins.append(12 - s)
        histogram = [(k, len(list(g))) for k, g in itertools.groupby(sorted(sizes))]
        got = sharding.best_fit_decreasing(histogram, 12)
        assert got.bins == len(bins)
        load, ordered = defaultdict(int), sorted(sizes, reverse=True)
        for start, end, b in zip(got.start, [*got.start[1:], len(sizes)], got.bin, strict=True):
            load[b] += sum(ordered[start:end])
        assert max(load.values()) <= 12 and sum(load.values()) == sum(sizes)


def test_shards(spark):
    rows = corpus(300) + [(1000 + i, "a group that is large " * 30, "en", "s", 0) for i in range(80)] + [(None, "x", "en", "s", 0), (7, "x", "en", "s", 0)]
    got = sharding.shard(frame(spark, rows).withColumn("shard", F.lit("clash")), 16).collect()
    assert len(got) == len(rows)
    slots, load = defaultdict(list), defaultdict(int)
    texts = defaultdict(set)
    for r in rows:
        texts[(len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))].add(r[1] or "")
    where = {}
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        assert (r.size, r.text_crc32) in texts
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    others = sorted(load.values())[:-1]  # the large group has a shard of its own; the long document's is the next
    assert sum(load.values()) == sum(len((r[1] or "").encode()) + 1 for r in rows) and max(others[:-1]) - min(others) < 0.1 * max(others)
    assert sharding.shard(empty(spark)).count() == 0
