import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import ngram_join, warc
from lakeweave.llm.components import components
from lakeweave.llm.queries import TOKENIZER
from lakeweave.llm.shingles import Parities, Shingler, expand_sorted, squeeze_sorted
from tests.llm.helpers import SCHEMA, corpus, empty, frame, words


def pages(spark, n=300):
    rows = [(i, f"http://e.net/{i}", None if i % 50 == 9 else f"<p>page {i} ü</p>" * (i % 40)) for i in range(n)] + [(None, None, "x"), (3, "http://e.net/3", "again\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_archive_holds_the_pages(spark, tmp_path):
    df, rows = pages(spark)
    index = warc.write_archive(df, f"file://{tmp_path}/a").collect()
    found = []
    for r in index:
        data = (tmp_path / "a" / r.name).read_bytes()[r.start : r.start + r.length]
        fields, payload = warc.parse(data)
        assert fields["WARC-Type"] == "resource" and len(payload) == r.payload_bytes
        found.append((r.page_id, payload))
    assert Counter(found) == Counter((i, (h or "").encode()) for i, _, h in rows)
    with pytest.raises(ValueError):
        warc.parse(data[:-9])


@pytest.mark.parametrize("damaged", [[], [17], [0, 1, 250], list(range(100, 180))])
def test_audit_finds_what_was_damaged(spark, tmp_path, damaged):
    df, _ = pages(spark)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write_archive(df, a)
    warc.copy_archive(index, a, b, lambda p: F.coalesce(p.isin(*damaged), F.lit(False)))
    found = warc.audit(*(warc.merkle_tree(warc.hash_ranges(index, p)) for p in (a, b)))
    got = index.join(found, ["file", "record"]).select("page_id").collect()
    assert sorted(r.page_id for r in got) == sorted(damaged + [3] * (3 in damaged))


def test_audit_of_a_replica_without_its_files(spark, tmp_path):
    df, rows = pages(spark, 40)
    index = warc.write_archive(df, f"file://{tmp_path}/a")
    (tmp_path / "none").mkdir()
    found = warc.audit(*(warc.merkle_tree(warc.hash_ranges(index, f"file://{tmp_path}/{p}")) for p in ("a", "none")))
    assert found.count() == len(rows)
    nothing = warc.write_archive(df.limit(0), f"file://{tmp_path}/e")
    tree = warc.merkle_tree(warc.hash_ranges(nothing, f"file://{tmp_path}/e"))
    assert warc.audit(tree, tree).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes_by_hand(rows):
    """Smallest doc_id reachable, by comparing all pairs."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    boss = {i: i for i in ids}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 4 * n >= 3 * (len(a) + len(b) - n):
                x, y = top(i), top(j)
                boss[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = corpus(220, seed)
    got = ngram_join.near_duplicates(frame(spark, rows).withColumn("component_id", F.lit("clash"))).collect()
    want = classes_by_hand(rows)
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(shingle_set(texts[r.doc_id])), want[r.doc_id])


def test_hot_near_copies_and_shared_passages(spark, monkeypatch):
    """Blocks, chunks and the fallback for groups that no witness joins, at sizes that make them all happen."""
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "HELD", 3)
    monkeypatch.setattr(ngram_join, "SHARED_MINIMA", 8)
    monkeypatch.setattr(ngram_join, "COMMON_FROM", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "PAIRS", 40)
    rng = random.Random(11)
    base, passage = words(rng, 80), words(rng, 50)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    for i in range(90, 150):
        rows.append((i, " ".join(passage + words(rng, rng.randrange(8, 14), 10**6)), "en", "s", 0))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_by_hand(rows)


def test_blocks_are_opened_where_their_unions_reach(spark, monkeypatch):
    """Two groups whose witnesses don't link, though two other members do."""
    rng = random.Random(3)
    base = words(rng, 100, 10**6)
    rows, n = [], 0
    for shift in (0, 1):
        for step in range(40):  # chains in which neighbours link
            w = base[:]
            w[: step * 2 + shift * 6] = [f"{shift}_{k}" for k in range(step * 2 + shift * 6)]
            rows.append((n, " ".join(w), "en", "s", 0))
            n += 1
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "HELD", 2)
    t = ngram_join.Threshold()
    store = ngram_join.SetStore(frame(spark, rows).select("doc_id", "text"), t)
    try:
        named = spark.createDataFrame([(r[0], 0 if r[0] < 40 else 40) for r in rows], "id long, c long")
        pair = spark.createDataFrame([(0, 40, 40, 40)], "ca long, cb long, many_a long, many_b long")
        links = {(r.a, r.b) for r in ngram_join.open_groups(store, named, pair, t).collect()}
    finally:
        store.drop()
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    linked = {(a, b) for a in range(40) for b in range(40, 80) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    linked |= {(b, a) for a, b in linked}
    assert links and links <= linked and {a for a, _ in links} == {a for a, b in linked if (a < 40) == (min(x for x, _ in links) < 40)}


def test_windows_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(7)
    t = ngram_join.Threshold()
    for _ in range(20):
        n = int(rng.integers(1, 300))
        token, size = np.sort(rng.integers(0, 6, n)).astype(np.uint64), rng.integers(5, 60, n)
        after, group = np.maximum(1, size - rng.integers(0, 15, n)), np.arange(n)
        entries, ends = ngram_join.windows(token, group, group + 1000, after, size, t)
        cuts = sorted({0, n, *rng.integers(0, n + 1, 2).tolist()})
        got = [p for i, j in zip(cuts, cuts[1:], strict=False) for c in ngram_join.candidates(entries, ends, i, j, t) for p in zip(*(x.tolist() for x in c), strict=True)]
        want = [(a, b, a + 1000, b + 1000) for a in range(n) for b in range(a + 1, n) if token[a] == token[b] and 175 * min(after[a], after[b]) >= 75 * (size[a] + size[b])]
        assert sorted(got) == want


def test_a_token_of_ten_thousand_groups_takes_little_memory():
    """Entries that may link with few others are not paired with all; those that may are paired a bounded piece at a time."""
    import tracemalloc

    import numpy as np

    n, t = 10_000, ngram_join.Threshold()
    group, token = np.arange(n), np.zeros(n, np.uint64)
    size = np.full(n, 100)
    tracemalloc.start()
    for after, pairs in ((np.full(n, 80), 0), (np.full(n, 90), n * (n - 1) // 2)):
        entries, ends = ngram_join.windows(token, group, group, after, size, t)
        found, most = 0, 0
        for k, (ca, *_) in enumerate(ngram_join.candidates(entries, ends, 0, n, t)):
            found, most = found + len(ca), max(most, len(ca))
            if k == 20:
                break
        assert (found == 0) == (pairs == 0) and most <= ngram_join.PAIRS // 8 + n
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("place", [250_000, 2_000])
@pytest.mark.parametrize("many", [1, 3])
def test_versions_below_the_threshold_are_not_a_row_a_pair(spark, monkeypatch, place, many):
    """Versions of a text that meet in the same rows, few of which link: alone, or in small groups beside a larger one."""
    monkeypatch.setattr(ngram_join, "PLACE", place, raising=False)
    rng = random.Random(5)
    base, rows = words(rng, 120, 10**6), []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(120), rng.choice((2, *[3] * 9))):
            w[k] = f"v{i}_{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    group = {i: (0 if many > 1 and i < 12 else i - i % many) for i in range(300)}
    t = ngram_join.Threshold()
    store = ngram_join.SetStore(frame(spark, rows).select("doc_id", "text"), t)
    try:
        named = spark.createDataFrame([(i, 116, c) for i, c in group.items()], "id long, n long, c long")
        got = ngram_join.qualifying_groups(store, named, 300 * 116, t).collect()
    finally:
        store.drop()
    sets = [shingle_set(r[1]) for r in rows]
    members = defaultdict(list)
    for i, c in group.items():
        members[c].append(i)

    def links(a, b):
        return 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b]))

    def joined(pairs):
        boss = dict(group)
        for a, b in pairs:
            x, y = sorted((boss[a], boss[b]))
            boss = {i: x if c == y else c for i, c in boss.items()}
        return boss

    found = [(a, b) for r in got for a in members[r.ca] for b in members[r.cb] if links(a, b)]  # groups that witnesses don't join are opened
    every = [(a, b) for a in range(300) for b in range(a) if links(a, b)]
    assert all(group[r.a] == r.ca and group[r.b] == r.cb for r in got)
    assert joined(found) == joined(every) and len(set(joined(every).values())) > 5
    assert len(got) < 10 * len(members)  # pairs that meet: about half of len(members) ** 2


def test_parities_tell_sets_apart():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 48, 5000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 48, new).astype(np.uint64)])) for n, new in ((1, 0), (0, 1), (9, 0), (140, 20), (146, 0), (130, 9), (1000, 100), (1100, 20), (5000, 700))]
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    apart = Parities(sets).apart(i, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    near = true * 3 < np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j, strict=True)])
    assert (apart <= true).all() and (apart[near] >= 0.9 * true[near]).all() and Parities([]).apart(i[:0], j[:0]).size == 0


def test_near_duplicate_edges(spark):
    rows = [(5, "a b c d e f", "en", "s", 0), (2, "A B C d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (None, "no equal of mine", "en", "s", 0), (9, "", "en", "s", 0), (9, "x y", "en", "s", 0), (4, "X\ty", "en", "s", 0), (4, "p q r", "en", "s", 0), (None, None, "en", "s", 0)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([("5", 2, 2), ("2", 2, 2), ("None", 2, 2), ("None", 1, None), ("9", 0, 9), ("9", 1, 4), ("4", 1, 4), ("4", 1, 4), ("None", 0, None)])
    clash = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("gone", "_gone", "component_id", "id", "n")})
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns
    # 9 is the document "x y" of component 4, so its rows go; rows without doc_id stay
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "4", "None", "None", "None"]
    assert ngram_join.near_duplicates(empty(spark)).count() == 0 and ngram_join.one_of_each(empty(spark)).count() == 0


def test_pairs_are_dealt_by_blocks(spark):
    family = spark.range(600).select(F.col("id").alias("a")).join(spark.range(600).select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    hub = spark.range(1000, 2000).select(F.col("id").alias("a"), F.lit(5).cast("long").alias("b"))
    pairs = family.unionByName(hub)
    held, streamed = ngram_join.deal_pairs(pairs)
    met = streamed.select("g", "chunk", F.col("id").alias("a"), F.explode("others").alias("id")).join(held, ["g", "chunk", "id"])
    assert sorted((r["a"], r["id"]) for r in met.collect()) == sorted(tuple(r) for r in pairs.collect())  # each meets once
    assert held.count() < pairs.count() / 20 and streamed.count() < pairs.count() / 20  # neither is a row a pair
    assert streamed.groupBy("g", "chunk").count().agg(F.max("count")).first()[0] < 2 * ngram_join.CHUNK


@pytest.mark.parametrize("few", [1_000_000, 7])
def test_components(spark, monkeypatch, few):
    """Joined up at once, and in rounds until few links are left."""
    monkeypatch.setattr("lakeweave.llm.components.FEW", few)
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], []):
        near = defaultdict(set)
        for a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        want = {}
        for start in sorted(near):
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = start
                    stack += near[x]
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_shingle_arrays():
    import numpy as np

    rng = random.Random(2)
    texts = [" ".join(words(rng, n, 30)) for n in (0, 1, 4, 5, 6, 300)] + [None]
    for text, s in zip(texts, Shingler().sets(texts), strict=True):
        assert len(s) == len(shingle_set(text)) and (np.diff(s.astype(object)) > 0).all()
        assert (expand_sorted(squeeze_sorted(s)) == s).all()


_LEFT = """
import random, re
import pyarrow as pa
from lakeweave.llm import ngram_join, packing, quality, tokenizing
from lakeweave.llm.queries import TOKENIZER

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(1)
def batches(n):
    for a in range(n):
        yield pa.record_batch({"doc_id": range(200), "text": [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(200)]})

run = ngram_join._sets(ngram_join.Threshold())
for x in run(batches(1)):
    pass
before = held()
for x in packing._cutter(TOKENIZER, 0, 1024, False)(batches(1)):
    pass
kept = len(tokenizing.worker_state().encoders)
for x in run(batches(6)):
    pass
del x
print(kept, len(getattr(tokenizing.worker_state(), "encoders", ())), held() - before)
"""


def test_tasks_leave_workers_small():
    """A worker has neither the encoder of an earlier stage nor what its own tasks have freed."""
    said = subprocess.run([sys.executable, "-c", _LEFT], cwd=os.path.dirname(corpus_pipeline.__file__), capture_output=True, text=True)
    assert not said.returncode, said.stderr
    kept, encoders, more = said.stdout.split()
    assert (kept, encoders) == ("1", "0") and float(more) < 40


def test_pipeline(spark, tmp_path):
    """Each stage does what it says to what the one before kept."""
    rng = random.Random(5)
    prose = lambda: " ".join(words(rng, rng.randrange(40, 120))) + "."
    rows = [(i, prose(), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1].upper(), "en", "s1", 0) for i in range(5)] + [(200 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(5)]
    rows += [(300, "too short", "en", "s0", 0), (301, "buy " * 50, "en", "s0", 0), (302, None, "en", "s0", 0)]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_duplicates", "source_mix", "packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        rows_out = out.collect()
        kept.append(Counter(r.doc_id for r in rows_out))
        docs = spark.createDataFrame(rows_out, SCHEMA)
    assert set(kept[0]) == {r[0] for r in rows} - {300, 301, 302}
    assert set(kept[1]) == set(kept[0]) - set(range(5))  # the larger id of equal texts stays
    assert set(kept[2]) == set(kept[1]) - {200 + i for i in range(5)}
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].values()) <= 3
    final = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in final} == set(kept[3]) and TOKENIZER
    done = defaultdict(int)
    for r in final:
        done[r.doc_id] += r.length
    first = {r.doc_id: r.doc_tokens for r in final}
    assert all(done[i] == first[i] * kept[3][i] for i in first)
    assert all(stage(spark, empty(spark), "").count() == 0 for _, stage in corpus_pipeline.STAGES)
