"""Line files read by byte ranges: an offset index, written once, and a data source that opens only the ranges of the keys asked for.

Every line has a key: the chromosome's number of a FASTA or VCF line, the code of a GFA record's letter. An index row is
a stretch of whole lines of one file, at most about RANGE bytes, with its byte range, its first line number, and the
least and greatest key in it; FASTA stretches are cut where the key changes, so they have one key. Index rows grow with
the bytes and the changes of key, not with the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from kmerloom.plans.numbering import running

#: Bytes of a range that one task scans or reads, and bytes read at a time.
RANGE, CHUNK = 1 << 25, 1 << 22
KINDS = ("fasta", "vcf", "gfa")
LINES = "key int, value string, line_no long"
_STRETCH = "path string, start long, stop long, lines long, low int, high int, known boolean"
_PACKED = r"\.(gz|gzip|bgz|bz2|zst|xz|lz4|snappy|deflate)$"
_NUMBER = r"^(?:[cC][hH][rR])?(?P<n>[0-9]+)"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _numbers(names: pa.Array) -> pa.Array:
    """vcf.chromosome_number() of an array."""
    own = pc.struct_field(pc.extract_regex(names, _NUMBER), "n")
    return pc.if_else(pc.is_valid(names), pc.fill_null(own, "0").cast(pa.int32()), pa.scalar(None, pa.int32()))


def line_keys(kind: str, lines: pa.Array) -> pa.Array:
    """The key of each line; null for lines without: FASTA lines that are no header, empty ones, comments of a VCF."""
    if kind == "fasta":
        return _numbers(pc.if_else(pc.starts_with(lines, ">"), pc.utf8_slice_codeunits(lines, 1), pa.scalar(None, pa.string())))
    none = pc.equal(lines, "")
    if kind == "vcf":
        return _numbers(pc.if_else(pc.or_(none, pc.starts_with(lines, "#")), pa.scalar(None, pa.string()), lines))
    return pa.array([ord(x[0]) if x else None for x in pc.utf8_slice_codeunits(lines, 0, 1).to_pylist()], pa.int32())


def _split(data: bytes) -> pa.Array:
    """The lines of bytes that end with a line; a carriage return before the line's end is not part of it."""
    own = data.decode("utf-8", "replace").split("\n")
    if data.endswith(b"\n"):
        own.pop()
    return pa.array([x.removesuffix("\r") for x in own], pa.string())


def whole_lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The bytes of the lines that begin in [start, stop), in runs of whole lines of about CHUNK bytes.

    A line begins at 0 or after a line feed. The last one is read to its end, wherever that is.
    """
    system, name = opened(path)
    with system.open_input_file(name) as source:
        at = max(start - 1, 0)
        source.seek(at)
        inside, rest = start == 0, []  # rest: a line begun, in parts
        while data := source.read(CHUNK if at < stop else 1 << 16):
            begin = 0
            if not inside:
                begin = data.find(b"\n") + 1
                if not begin or at + begin >= stop:
                    if begin or at + len(data) >= stop:
                        return
                    at += len(data)
                    continue
                inside = True
            # the line feed before the first line that begins at or past stop
            last = data.find(b"\n", max(stop - 1 - at, begin, 0)) if at + len(data) >= stop else -1
            cut = last if last >= 0 else data.rfind(b"\n", begin)
            if cut >= begin:
                yield b"".join([*rest, data[begin : cut + 1]])
                rest, begin = [], cut + 1
            if last >= 0:
                return
            rest.append(data[begin:])
            at += len(data)
        if b"".join(rest):
            yield b"".join(rest)


def stretches(kind: str, path: str, start: int, stop: int) -> list[tuple]:
    """The index rows (path, start, stop, lines, low, high, known) of the lines that begin in a byte range.

    known: the keys are those of the lines themselves; otherwise the lines go on with the key of the row before.
    """
    rows, at = [], None
    for data in whole_lines(path, start, stop):
        if at is None:
            at = _first(path, start)
        keys = line_keys(kind, _split(data))
        if kind == "fasta":
            heads = np.flatnonzero(np.asarray(pc.is_valid(keys)))
            ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1, len(data))[: len(keys)]
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            marks = [(0, None)] if not len(heads) or heads[0] else []
            marks += list(zip(heads.tolist(), keys.take(pa.array(heads)).to_pylist(), strict=True))
            for (i, key), j in zip(marks, [m[0] for m in marks[1:]] + [len(keys)], strict=True):
                end = at + int(starts[j]) if j < len(keys) else at + len(data)
                if rows and (key is None or (rows[-1][6] and rows[-1][4] == key)):
                    _, begun, _, n, low, _, known = rows[-1]
                    rows[-1] = (path, begun, end, n + j - i, low, low, known)
                else:
                    rows.append((path, at + int(starts[i]), end, j - i, key, key, key is not None))
        else:
            low, high = pc.min_max(keys).as_py().values()
            if rows:
                _, begun, _, n, a, b, _ = rows[0]
                low, high = (min((x for x in (a, low) if x is not None), default=None), max((x for x in (b, high) if x is not None), default=None))
                rows[0] = (path, begun, at + len(data), n + len(keys), low, high, True)
            else:
                rows.append((path, at, at + len(data), len(keys), low, high, True))
        at += len(data)
    return rows


def _first(path: str, start: int) -> int:
    """Where the first line that begins at or past start begins."""
    if start == 0:
        return 0
    system, name = opened(path)
    with system.open_input_file(name) as source:
        at = start - 1
        source.seek(at)
        while data := source.read(1 << 16):
            if (found := data.find(b"\n")) >= 0:
                return at + found + 1
            at += len(data)
    return at


def line_index(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    """(kind, path, start, stop, first_line, low, high): the stretches of a text file, or of several in the order of their names.

    Tasks scan byte ranges; what is put in order is a row for each stretch. Lines end at line feeds. Numbers count from
    0 over all files, as in read_lines(). FASTA lines before the first header have no key. ValueError for an unknown
    kind and for compressed files, which have no ranges. Files without bytes give no row.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and lengths only
    if not files.where(F.col("path").rlike(_PACKED)).isEmpty():
        raise ValueError("compressed files are not read by ranges")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = stretches(kind, row["path"], row["start"], row["stop"])
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x, strict=True)) for x in found], _SCHEMA)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = ranges.repartition(n, "path", "start").mapInArrow(run, _STRETCH)
    placed = running(own, None, ["path", "start"], until=("sum", "lines"), carried=("max", "CASE WHEN known THEN struct(path, start, high) END"))
    key = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col("carried.high")).alias(c)
    return placed.select(F.lit(kind).alias("kind"), "path", "start", "stop", (F.col("until") - F.col("lines")).alias("first_line"), key("low"), key("high"))


_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("lines", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("known", pa.bool_())])
_NAMES = _SCHEMA.names


def write_line_index(spark: SparkSession, path: str, kind: str, out: str, size: int = RANGE) -> str:
    """line_index() stored as parquet in the folder out, which is returned; an index of the same name is an error."""
    line_index(spark, path, kind, size).write.parquet(out)
    return out


class Stretches(InputPartition):
    """What one task reads: (kind, path, start, stop, first_line, low, high) rows."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows


class LineReader(DataSourceReader):
    """Lines of an indexed file, of some keys or all. The keys choose the stretches that are opened.

    They are fixed from the start, and only the filter that says the same is taken over: Spark keeps what one query has
    pushed for later queries on the same DataFrame, so a reader must not depend on it.
    """

    def __init__(self, index: str, size: int, keys: set[int] | None = None):
        self.index, self.size, self.wanted = index, size, keys

    def pushFilters(self, filters):
        for own in filters:
            asked = {own.value} if isinstance(own, EqualTo) else set(own.value) if isinstance(own, In) else None
            if asked is None or own.attribute != ("key",) or asked != self.wanted:
                yield own

    def partitions(self) -> list[InputPartition]:
        """Stretches that may hold what is asked for, neighbours together up to the size of a range."""
        system, name = opened(self.index)
        keep = None
        if self.wanted is not None:
            keep = ds.scalar(False)
            for key in self.wanted:
                keep = keep | ((ds.field("low") <= key) & (ds.field("high") >= key))
        table = ds.dataset(name, schema=_STORED, filesystem=system, format="parquet").to_table(filter=keep).sort_by([("path", "ascending"), ("start", "ascending")])
        out, held = [], 0
        for row in zip(*(table[c].to_pylist() for c in _STORED.names), strict=True):
            held += row[3] - row[2]
            if not out or held > self.size or len(out[-1]) == 1 << 12:
                out.append([])
                held = row[3] - row[2]
            out[-1].append(row)
        return [Stretches(rows) for rows in out or [[]]]

    def read(self, partition: Stretches):
        for kind, path, start, stop, line_no, low, _ in partition.rows:
            for data in whole_lines(path, start, stop):
                lines = _split(data)
                keys = pa.array([low] * len(lines), pa.int32()) if kind == "fasta" else line_keys(kind, lines)
                batch = pa.RecordBatch.from_arrays([keys, lines, pa.array(np.arange(line_no, line_no + len(lines)))], ["key", "value", "line_no"])
                line_no += len(lines)
                if self.wanted is not None:
                    batch = batch.filter(pc.fill_null(pc.is_in(keys, pa.array(sorted(self.wanted), pa.int32())), False))
                yield batch


_STORED = pa.schema([("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first_line", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


class IndexedLines(DataSource):
    """format("indexed_lines"), options path: the folder of a line index, keys: integers with commas, or none for all."""

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        keys = self.options.get("keys")
        return LineReader(self.options["path"], int(self.options.get("size", RANGE)), {int(x) for x in keys.split(",")} if keys else None)


def indexed_lines(spark: SparkSession, index: str, *keys: int, size: int = RANGE) -> DataFrame:
    """(key, value, line_no) of the file whose index write_line_index() stored, all lines or those of some keys.

    Only stretches that may hold the keys are opened; the source takes the filter on them over, for which this turns
    filter pushdown of Python sources on in the session. Other filters follow the scan. The files must be as they were
    when indexed, at a path that pyarrow opens on every executor (file, hdfs, s3, gs, abfs).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedLines)
    target = spark._jvm.org.apache.hadoop.fs.Path(index)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    own = spark.read.format("indexed_lines").option("size", size)
    if not keys:
        return own.load(full)
    return own.option("keys", ",".join(map(str, keys))).load(full).where(F.col("key").isin(*keys))
