"""WARC archives and their fixity: Merkle trees over record hashes and offset ranges, compared from the root down."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, small_batches
from lakeweave.llm.storage import files_of, mapped

FANOUT_BITS = 4  # a node has up to 16 children
INDEX = "file int, name string, record long, start long, length long, page_id long, payload_sha256 string, payload_bytes long"


def record(url: str | None, payload: bytes, record_id: str) -> bytes:
    """A WARC/1.1 resource record as one gzip member."""
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{record_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + payload + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields and the payload of a record; ValueError if the bytes are no whole record."""
    try:
        plain = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"not a gzip member: {e}") from e
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    if not plain.startswith(b"WARC/") or f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError("the payload isn't the one that the record states")
    return fields, payload


def write_archive(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``page_id, url, html`` as WARC files in order of page_id and returns their index (``INDEX``).

    A file for each range of page_ids; null html is an empty payload, null page_ids come first, rows that repeat are
    records of their own. Names carry the task attempt and only indexed files count. An empty table has no file.
    """
    small_batches(pages.sparkSession)
    files, folder = files_of(path)
    files.create_dir(folder, recursive=True)
    ordered = pages.select(F.col("page_id").cast("long"), "url", "html").repartitionByRange("page_id").sortWithinPartitions("page_id")

    def run(batches):
        from pyspark import TaskContext

        files, folder = files_of(path)
        number = TaskContext.get().partitionId()
        name, out, at, count = f"{number:06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                member = record(url, payload, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")))
                out = out or files.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(member)
                rows.append((number, name, count, at, len(member), page_id, digest, len(payload)))
                at, count = at + len(member), count + 1
            if rows:
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return cut(ordered.mapInArrow(run, INDEX), "warc-index")


def copy_archive(index: DataFrame, path: str, to: str, damaged=None) -> None:
    """Copies the indexed files; for tests and drills, records for which ``damaged(page_id)`` have a byte flipped."""
    files, folder = files_of(to)
    files.create_dir(folder, recursive=True)

    def run(batches):
        source, folder = files_of(path)
        target, other = files_of(to)
        for batch in batches:
            for name, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = bytearray(mapped(source, f"{folder}/{name}").tobytes())
                for r in ranges:
                    data[r["start"] + r["length"] // 2] ^= 0xFF
                with target.open_output_stream(f"{other}/{name}", compression=None) as f:
                    f.write(bytes(data))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    bad = damaged(F.col("page_id")) if damaged else F.lit(False)
    chosen = F.collect_list(F.when(bad, F.struct("start", "length")))
    index.groupBy("name").agg(chosen.alias("ranges")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def hash_ranges(index: DataFrame, path: str) -> DataFrame:
    """Leaves of a replica: ``file, idx, hash`` of each indexed offset range, in which the range itself is hashed too.

    A range beyond the file's end, or of a file that isn't there, has the hash of what is left of it. An empty index has
    no leaves.
    """

    def run(batches):
        from pyarrow import fs

        files, folder = files_of(path)
        name, data = None, None
        for batch in batches:
            hashes = []
            for file, start, length in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                if file != name:
                    there = files.get_file_info(f"{folder}/{file}").type == fs.FileType.File
                    name, data = file, mapped(files, f"{folder}/{file}") if there else b""
                h = hashlib.sha256(f"{start}+{length}:".encode())
                h.update(data[start : start + length])
                hashes.append(h.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hashes, pa.binary())], names=["file", "idx", "hash"])

    dealt = index.select("file", "name", "record", "start", "length").repartition("file").sortWithinPartitions("file", "record")
    return dealt.mapInArrow(run, "file int, idx long, hash binary")


@dataclass(frozen=True)
class MerkleTree:
    """``file, idx, hash`` of each level, leaves first and the replica's root last; from ``files_at`` on, file is -1
    and the nodes of that level stand for the roots of the files' own trees, one level below."""

    levels: list[DataFrame]
    files_at: int


def merkle_tree(leaves: DataFrame) -> MerkleTree:
    """A tree for each file over its records, and one over the files.

    A node hashes its up to 16 children in order, so a level has a sixteenth of the rows of the one below.
    """
    levels = [cut(leaves, "merkle")]

    def grow(most: int | None) -> None:
        while most:
            most >>= FANOUT_BITS
            children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.hex(x["hash"]))
            digest = F.unhex(F.sha2(F.concat_ws(",", children), 256))
            nodes = levels[-1].groupBy("file", F.shiftright("idx", FANOUT_BITS).alias("idx")).agg(digest.alias("hash"))
            levels.append(cut(nodes, "merkle"))

    records, files = levels[0].agg(F.max("idx"), F.max("file")).first()
    grow(records)
    levels.append(levels[-1].select(F.lit(-1).alias("file"), F.col("file").cast("long").alias("idx"), "hash"))
    files_at = len(levels) - 1
    grow(files)
    return MerkleTree(levels, files_at)


def audit(first: MerkleTree, second: MerkleTree) -> DataFrame:
    """``file, record`` of every record that differs between two replicas of one index, found from the roots down.

    Only children of nodes that differ are compared; equal roots end the audit after one comparison.
    Replicas of an empty index don't differ. A pair of trees of different shapes is an error.
    """
    if (len(first.levels), first.files_at) != (len(second.levels), second.files_at):
        raise ValueError("the trees are not of the same index")
    differing = None
    for depth in range(len(first.levels) - 1, -1, -1):
        a, b = first.levels[depth], second.levels[depth]
        if differing is not None:
            parent = differing.select(F.col("file").alias("_f"), F.col("idx").alias("_i"))
            inside = (F.col("file") == F.col("_f")) & (F.shiftright("idx", FANOUT_BITS) == F.col("_i"))
            on = F.col("file").cast("long") == F.col("_i") if depth == first.files_at - 1 else inside
            a, b = (x.join(parent, on, "left_semi") for x in (a, b))
        met = a.withColumnRenamed("hash", "_a").join(b.withColumnRenamed("hash", "_b"), ["file", "idx"], "full")
        differing = cut(met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "idx"), "differing")
        if differing.isEmpty():
            break
    return differing.where("file >= 0").select("file", F.col("idx").alias("record"))
