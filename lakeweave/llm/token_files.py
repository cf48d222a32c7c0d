"""Token ids as flat files of unsigned integers with 64-bit document offsets, read back by memory map.

A data set is a folder: ``<part>.ids`` holds the ids of the part's documents one after the other, as little-endian
unsigned integers of 2 or 4 bytes; ``<part>.offsets`` holds one signed 64-bit start per document and the end;
``<part>.docs`` is an Arrow file of their doc_ids. ``manifest.json``, written last, lists the parts in order with
the documents and ids before each (prefix sums). A part is named after its task attempt and counts only once the
manifest has it, so a lost or repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.common import small_batches
from lakeweave.llm.storage import files_of, mapped
from lakeweave.llm.tokenizing import TextEncoder, vocabulary_size


_PART = "part int, name string, documents long, tokens long"


def _writer(path: str, tokenizer_path: str, end_id: int, width: int) -> Callable:
    def run(batches):
        from pyspark import TaskContext

        files, folder = files_of(path)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        encoder, end = TextEncoder.shared(tokenizer_path), np.array([end_id], "<u4").tobytes()
        docs, total, ids = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                ids, offsets = (files.open_output_stream(f"{folder}/{name}.{k}", compression=None) for k in ("ids", "offsets"))
                sink = files.open_output_stream(f"{folder}/{name}.docs", compression=None)
                kind = pa.schema([("doc_id", batch.schema.field(0).type)])
                rows = pa.ipc.new_file(sink, kind)
            encoded = encoder.encode(batch.column(1))
            starts = total + np.concatenate([[0], np.cumsum([len(e) // 4 + 1 for e in encoded])])
            offsets.write(starts[:-1].astype("<i8").tobytes())
            for i in range(0, len(encoded), 256):
                flat = np.frombuffer(end.join([*encoded[i : i + 256], b""]), "<u4")
                ids.write(flat.astype(f"<u{width}").tobytes())
            rows.write_batch(pa.record_batch([batch.column(0)], schema=kind))
            docs, total = docs + batch.num_rows, int(starts[-1])
        if ids is not None:
            offsets.write(np.array([total], "<i8").tobytes())
            rows.close()
            for f in (ids, offsets, sink):
                f.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "documents": pa.array([docs], pa.int64()), "tokens": pa.array([total], pa.int64())})

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, width: int | None = None) -> dict:
    """Encodes every whole text, appends ``end_id``, writes the ids in ascending doc_id order; returns the manifest.

    Null text is empty (its ids are the end id alone). Null doc_ids come first; rows that repeat a doc_id stand next
    to each other in any order. An empty table makes a manifest without parts. ``width`` is 2 or 4 bytes an id: by
    default 2 where every id of the vocabulary and the end id fit.
    """
    small_batches(docs.sparkSession)
    if width is None:
        width = 2 if max(end_id + 1, vocabulary_size(tokenizer_path)) <= 1 << 16 else 4
    files, folder = files_of(path)
    files.create_dir(folder, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    parts = ordered.mapInArrow(_writer(path, tokenizer_path, end_id, width), _PART).where("documents > 0").collect()
    listed, before, tokens = [], 0, 0
    for p in sorted(parts, key=lambda r: r["part"]):
        listed.append({"name": p["name"], "documents": p["documents"], "tokens": p["tokens"], "first_document": before, "first_token": tokens})
        before, tokens = before + p["documents"], tokens + p["tokens"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    manifest = {"width": width, "end_id": end_id, "documents": before, "tokens": tokens, "doc_id": kind, "parts": listed}
    with files.open_output_stream(f"{folder}/manifest.json.new") as f:
        f.write(json.dumps(manifest).encode())
    files.move(f"{folder}/manifest.json.new", f"{folder}/manifest.json")
    return manifest


def _reader(path: str, width: int, end_id: int) -> Callable:
    def run(batches):
        files, folder = files_of(path)
        for batch in batches:
            for part in batch.to_pylist():
                ids = mapped(files, f"{folder}/{part['name']}.ids").view(f"<u{width}")
                offsets = mapped(files, f"{folder}/{part['name']}.offsets").view("<i8")
                with files.open_input_file(f"{folder}/{part['name']}.docs") as f:
                    rows = pa.ipc.open_file(f).read_all()["doc_id"].combine_chunks()
                if len(ids) != part["tokens"] or len(offsets) != part["documents"] + 1 or len(rows) != part["documents"]:
                    raise ValueError(f"{part['name']}: the files don't have the size that the manifest states")
                for a in range(0, len(rows), 4096):
                    b = min(a + 4096, len(rows))
                    begin, end = offsets[a:b], offsets[a + 1 : b + 1]
                    if (ids[end - 1] != end_id).any():
                        raise ValueError(f"{part['name']}: a document doesn't end in the end id")
                    crcs = [zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(begin, end, strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), pa.array(begin + part["first_token"], pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; a task for each part."""
    files, folder = files_of(path)
    with files.open_input_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "name string, documents long, tokens long, first_token long"
    listed = [(p["name"], p["documents"], p["tokens"], p["first_token"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(listed, schema).repartition(max(1, len(listed)), F.col("name"))
    out = f"doc_id {manifest['doc_id']}, start long, n_tokens long, ids_crc32 long"
    return parts.mapInArrow(_reader(path, manifest["width"], manifest["end_id"]), out)
