import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers

from lakeweave.llm import packing, token_files
from lakeweave.llm.queries import TOKENIZER
from lakeweave.llm.tokenizing import TextEncoder
from tests.llm.helpers import corpus, empty, frame

PLAIN = Tokenizer.from_file(TOKENIZER)  # as the library makes it
ENCODER = TextEncoder(TOKENIZER, cuts=50, batch_bytes=200)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB7é'sß.,!? \n\t\x00\x1c\x85 　日<|>-")), max_size=25), max_size=6))
def test_encoder_is_the_library(texts):
    got = ENCODER.encode(pa.array([*texts, None], pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in [*texts, None]]


def test_special_tokens_and_other_tokenizers(tmp_path):
    assert ids("x <|endoftext|> y") == [87, 220, 50256, 331]
    assert np.frombuffer(ENCODER.encode(pa.array(["x <|endoftext|> y"]))[0], "<u4").tolist() == ids("x <|endoftext|> y")
    other = Tokenizer.from_file(TOKENIZER)
    other.normalizer = normalizers.Lowercase()
    other.add_tokens(["d.o"])
    other.save(str(tmp_path / "other.json"))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["A b. C, d.o E\nF", "", "x d.o y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in TextEncoder(str(tmp_path / "other.json")).encode(pa.array(texts))] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_text():
    text = "".join(random.Random(3).choice(["word ", "w", ".\n", " x", "<|endoftext|>"]) for _ in range(100_000))
    for t in (text, "ab " * 1_700_000):
        assert np.frombuffer(TextEncoder(TOKENIZER).encode(pa.array([t, "a"]))[0], "<u4").tolist() == ids(t)


def rows_for(spark):
    return corpus(60) + [(None, "no id", "en", "s", 0), (7, "seven again", "en", "s", 0), (61, "<|endoftext|> don't", "en", "s", 0)]


def test_files_round_trip(spark, tmp_path):
    rows = rows_for(spark)
    manifest = token_files.write_tokens(frame(spark, rows), f"file://{tmp_path}/t", TOKENIZER)
    assert manifest["width"] == 2 and manifest["documents"] == len(rows)
    got = token_files.read_token_index(spark, f"file://{tmp_path}/t").collect()
    want = sorted((-1 if r[0] is None else r[0], len(ids(r[1])) + 1, zlib.crc32(np.array([*ids(r[1]), 2], "<u4").tobytes())) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))  # rows without doc_id come first
    whole = b"".join((tmp_path / "t" / f"{p['name']}.ids").read_bytes() for p in manifest["parts"])
    assert len(whole) == 2 * at == 2 * manifest["tokens"]
    wide = token_files.write_tokens(frame(spark, rows), f"file://{tmp_path}/w", TOKENIZER, width=4)
    assert wide["tokens"] == at and {(r.doc_id, r.ids_crc32) for r in token_files.read_token_index(spark, f"file://{tmp_path}/w").collect()} == {(r.doc_id, r.ids_crc32) for r in got}


def test_no_documents(spark, tmp_path):
    token_files.write_tokens(empty(spark), f"file://{tmp_path}/e", TOKENIZER)
    assert token_files.read_token_index(spark, f"file://{tmp_path}/e").count() == 0
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_histogram_packing():
    rng = random.Random(4)
    for capacity in (8, 64, 1024):
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 500) for _ in range(min(capacity, 100))}
        plan = packing.shortest_pack_first(histogram, capacity)
        used = defaultdict(int)
        for pattern, count in plan.patterns:
            assert sum(pattern) <= capacity
            for length in pattern:
                used[length] += count
        assert dict(used) == histogram and sum(n for _, n in plan.patterns) == plan.sequences
        assert plan.sequences <= 1.25 * -(-sum(k * n for k, n in histogram.items()) // capacity) + 1


def packed(spark, rows, **more):
    got = packing.pack(frame(spark, rows), TOKENIZER, **more).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    return got, pieces, len(sequences)


def test_pieces_cover_documents(spark):
    rows = corpus(60)
    got, pieces, _ = packed(spark, rows, with_ids=True)
    for r in rows:
        full, at = [*ids(r[1]), 0], 0
        for start, length, crc in sorted(pieces[r[0], len(full)]):
            assert start == at and crc == zlib.crc32(np.array(full[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(full)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)


def test_documents_are_cut_where_they_would_not_fit(spark):
    text = " ".join(["the"] * 599)  # 600 ids each: two don't fit in one sequence
    _, pieces, n = packed(spark, [(i, text, "en", "s", 0) for i in range(64)])
    assert n * 1024 <= 1.1 * 64 * 600
