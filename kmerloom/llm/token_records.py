"""Token ids as length-delimited binary records with an offset index beside each file.

A data file is 8 bytes of magic and then records: u64 length, u32 masked checksum of the length, payload, u32 masked
checksum of the payload. The checksum is CRC-32, masked by a rotation of 15 bits and a constant so that checksums of
checksummed data stay sound. A payload is the i64 document id, u8 bytes of an id (2 or 4), u8 codec (0 plain,
1 zstd) and the ids. The index is one row of four i64 a record: document id, offset in the file, ids, ids before it in
the file. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.llm import _tokens

MAGIC, MASK = b"TOKREC01", 0xA282EAD8
END_ID = 2
_HEAD, _INNER = struct.Struct("<QI"), struct.Struct("<qBB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(handle, offset: int) -> bytes:
    """The payload of the record at an offset; ValueError if a length or checksum is wrong."""
    handle.seek(offset)
    head = handle.read(_HEAD.size)
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError(f"broken record length at {offset}")
    size = _HEAD.unpack(head)[0]
    body = handle.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError(f"broken record at {offset}")
    return body[:size]


def pack_ids(doc_id: int, ids: np.ndarray, width: int, compressor) -> bytes:
    raw = ids.astype(f"<u{width}").tobytes()
    return _INNER.pack(doc_id, width, int(compressor is not None)) + (compressor.compress(raw) if compressor else raw)


def unpack_ids(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, width, codec = _INNER.unpack_from(payload)
    raw = payload[_INNER.size :]
    return doc_id, np.frombuffer(zstandard.decompress(raw) if codec else raw, f"<u{width}").astype("<u4")


def _open(root: str):
    return pa.fs.FileSystem.from_uri(root) if "://" in root else (pa.fs.LocalFileSystem(), root)


def write_records(docs: DataFrame, root: str, end_id: int = END_ID, tokenizer: str | None = None, compress: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text, each followed by end_id, in ascending order of id; the manifest (part, docs, ids, before).

    Files are root/part-N.rec and root/part-N.idx, ids ascending over the parts and within each. Null or empty texts are
    one end_id. Null ids come first; rows that share an id follow each other in the order of their texts. Other columns
    are not stored. A task writes under a name of its own attempt and renames, so a task that runs again, or twice,
    leaves one whole file. An empty table writes no file. root is a folder or URI that every executor reaches.
    """
    path = tokenizer or _tokens.default_path()

    def write(batches):
        own, context = _tokens.encoder(path), TaskContext.get()
        fs, folder = _open(root)
        part, tag = context.partitionId(), f".{context.taskAttemptId()}"
        width = 2 if own.small and end_id < 1 << 16 else 4
        compressor = zstandard.ZstdCompressor(level=1) if compress else None
        end = np.array([end_id], "<u4").tobytes()
        name = f"{folder}/part-{part:06d}"
        out, index, at, before = None, [], len(MAGIC), 0
        for batch in batches:
            for doc_id, text in zip(C.ids_of(batch.column(0)).tolist(), batch.column(1), strict=True):
                if out is None:
                    fs.create_dir(folder)
                    out = fs.open_output_stream(name + ".rec" + tag, buffer_size=1 << 20)
                    out.write(MAGIC)
                ids = np.frombuffer(own.encode(text.as_py()) + end, "<u4")
                record = frame(pack_ids(doc_id, ids, width, compressor))
                out.write(record)
                index.append((doc_id, at, len(ids), before))
                at, before = at + len(record), before + len(ids)
        if out is not None:
            out.close()
            with fs.open_output_stream(name + ".idx" + tag) as handle:
                handle.write(np.array(index, "<i8").tobytes())
            for end_of in (".rec", ".idx"):
                fs.move(name + end_of + tag, name + end_of)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([len(index)], pa.int64()), "ids": pa.array([before], pa.int64())})

    spark = docs.sparkSession
    ordered = docs.select(id_col, text_col).repartitionByRange(C.shuffle_partitions(spark), id_col).sortWithinPartitions(id_col, text_col)
    parts = sorted(tuple(r) for r in ordered.mapInArrow(write, "part long, docs long, ids long").collect())
    before, rows = 0, []
    for part, n, ids in parts:  # one row a file
        rows.append((part, n, ids, before))
        before += ids
    return spark.createDataFrame(rows, "part long, docs long, ids long, before long")


def read_records(spark: SparkSession, root: str, manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every record, read through the index; tokens as little-endian uint32.

    start counts the ids of all records before. With a seed, each file's records come in a shuffled order, and the files
    too. A broken length or checksum raises. The id that stands for null comes back as null.
    """

    def read(batches):
        fs, folder = _open(root)
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{folder}/part-{part:06d}.idx") as handle:
                    index = np.frombuffer(handle.read(), "<i8").reshape(-1, 4)
                order = np.arange(len(index)) if seed is None else np.random.default_rng([seed, part]).permutation(len(index))
                with fs.open_input_file(f"{folder}/part-{part:06d}.rec") as handle:
                    if handle.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"part {part} is not a record file")
                    for a in range(0, len(order), 512):
                        ids, tokens = [], []
                        rows = index[order[a : a + 512]]
                        for doc_id, offset, n, _ in rows.tolist():
                            got, own = unpack_ids(unframe(handle, offset))
                            if got != doc_id or len(own) != n:
                                raise ValueError(f"part {part}: index and record at {offset} differ")
                            ids.append(None if doc_id == C.NULL_ID else doc_id)
                            tokens.append(own.tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows[:, 3] + before), pa.array(rows[:, 2].copy()), pa.array(tokens, pa.binary())], ["doc_id", "start", "n_tokens", "tokens"])

    files = manifest.select("part", "before")
    files = files.repartition(C.shuffle_partitions(spark), "part") if seed is None else files.orderBy(F.xxhash64(F.lit(seed), "part"))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, tokens binary")
