"""Benchmark decontamination over a positional inverted index.

The index is split by document: a segment holds some whole documents and, for each term, the positions of its postings.
Benchmark windows up to a number of words go to every segment, more of them only to segments that have their first term:
there the offset-adjusted position lists of a window are intersected from its rarest term on. Segments are bounded by bytes, so a passage or a word that a third of all documents
share is spread over them like the documents are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C

#: Words in a window; the share of hit words, as 1 / SHARE, from which a document is contaminated.
WINDOW, SHARE = 13, 20
#: Bytes of text in a segment, empty positions between documents, words of windows that are broadcast.
SEGMENT_BYTES, GAP, BLOCK_WORDS = 1 << 23, 1 << 10, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that separate words: all ASCII but digits and a-z.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[48:58] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def term_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, first word of each text) of a text column."""
    data, offsets = C.text_bytes(column)
    terms, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for a, b in C.chunks(offsets):
        own = _LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = C.spans(own, offsets[a : b + 1] - offsets[a], _OUTSIDE)
        terms.append(C.byte_hash(own, starts, ends, 0).view(np.int64))
        counts.append(np.diff(first))
    return np.concatenate(terms), np.cumsum(np.concatenate(counts))


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary rows values[edges[i]:edges[i + 1]]."""
    at = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


SEGMENT = "segment string, term long, postings binary, ids binary, words binary"


def _segment(name: str, ids: np.ndarray, column) -> pa.RecordBatch:
    terms, first = term_hashes(column)
    counts = np.diff(first)
    positions = np.arange(len(terms)) + np.repeat(np.arange(len(counts)) * GAP, counts)
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    lists = _lists(positions[order].astype("<u4"), np.append(heads, len(terms)))
    blank = pa.nulls(len(heads), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * (len(heads) + 1)),
            pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(terms[heads])]),
            pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
            pa.concat_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), blank]),
            pa.concat_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary()), blank]),
        ],
        ["segment", "term", "postings", "ids", "words"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the positional index of all texts to the shared folder: one row for each term of a segment, and one without
    a term that lists the segment's documents and their word counts.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII; a null or empty text has none. Positions
    count words of the segment with GAP free ones between documents, so no phrase reaches from one into the next.
    """

    def run(batches):
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            own, column = C.ids_of(batch.column(0)), batch.column(1)
            _, offsets = C.text_bytes(column)
            for a, b in C.chunks(offsets, SEGMENT_BYTES // 4):
                ids.append(own[a:b])
                texts.append(column.slice(a, b - a))
                size += int(offsets[b] - offsets[a]) + 64 * (b - a)  # also bounds the positions of empty documents
                if size >= SEGMENT_BYTES:
                    yield _segment(f"{part}-{k}", np.concatenate(ids), pa.chunked_array(texts))
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield _segment(f"{part}-{k}", np.concatenate(ids), pa.chunked_array(texts))

    return C.materialize(docs.select(id_col, text_col).mapInArrow(run, SEGMENT), "index")


def windows_of(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): every run of so many consecutive words of an item, or all words of a shorter one that has any."""

    def run(batches):
        for batch in batches:
            terms, first = term_hashes(batch.column(1))
            items, rows = [], []
            for item, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                own = [terms[a:b]] if a < b < a + window else [terms[i : i + window] for i in range(a, b - window + 1)]
                items += [item] * len(own)
                rows += [x.tolist() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "terms"])

    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_col)
    return named.mapInArrow(run, "item string, terms array<long>").distinct()


def find_windows(table: pa.Table, windows: list[np.ndarray], slop: int):
    """(window number, start) of every match in one segment; start is a position of the segment."""
    named = table.filter(table["term"].is_valid())
    terms = np.asarray(named["term"], dtype=np.int64)
    lists = C.unpacked(named["postings"], "<u4")
    order = np.argsort(terms)
    terms, sizes = terms[order], np.array([len(lists[i]) for i in order], np.int64)
    if not len(terms) or not len(windows):
        return
    asked, heads = np.concatenate(windows), np.cumsum([0, *(len(x) for x in windows)])
    place = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    whole = np.logical_and.reduceat(terms[place] == asked, heads[:-1])  # windows whose every term the segment has
    for w in np.flatnonzero(whole).tolist():
        at = place[heads[w] : heads[w + 1]]
        rarest, starts = np.argsort(sizes[at], kind="stable"), None
        for offset in rarest.tolist():
            have = lists[order[at[offset]]].astype(np.int64) - offset
            if starts is None:
                starts = have
            else:  # is any adjusted position within slop of the start?
                near = np.searchsorted(have, starts - slop)
                starts = starts[(near < len(have)) & (have[np.minimum(near, len(have) - 1)] <= starts + slop)]
            if not len(starts):
                break
        if len(starts):
            yield w, starts


def _lookup(given, slop: int):
    """Searches one segment for the windows of a broadcast block."""

    def look(table: pa.Table) -> pa.Table:
        windows, items = given.value
        head = table.filter(table["term"].is_null())
        ids, words = C.unpacked(head["ids"], "<i8")[0], C.unpacked(head["words"], "<i8")[0]
        first = np.concatenate([[0], np.cumsum(words + GAP)])
        hits: list[list] = [[] for _ in ids]
        named: list[set] = [set() for _ in ids]
        for w, starts in find_windows(table, windows, slop):
            owner = np.searchsorted(first, np.maximum(starts, 0), "right") - 1
            for d in np.unique(owner).tolist():
                local = starts[owner == d] - first[d] if len(owner) > 1 else starts - first[d]
                hits[d].append(np.stack([np.maximum(local - slop, 0), np.minimum(local + len(windows[w]) + slop, words[d])], 1))
                named[d].update(items[w])
        spans = [merged(np.concatenate(h)) if h else [] for h in hits]
        return pa.table(
            {
                "segment": pa.array([head["segment"][0].as_py()] * len(ids), pa.string()),
                "row": pa.array(np.arange(len(ids)), pa.int64()),
                "doc_id": pa.array(ids, pa.int64(), mask=ids == C.NULL_ID),
                "n_words": pa.array(words, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "items": pa.array([sorted(x) for x in named], pa.list_(pa.string())),
            }
        )

    return look


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every indexed document.

    spans: merged [start, end) word ranges in which a benchmark window occurs, items: the sorted ids of such items (as
    strings; a null id is "null"). slop 0 finds exact phrases. With a slop, a window matches in proximity: each of its
    words stands within slop of its place, counted from the rarest one, and the span is wider by slop on either side.
    Null or empty items have no windows. An empty benchmark leaves all documents without spans.
    """
    if not 0 <= slop < GAP // 4 or not 0 < window < GAP // 2:
        raise ValueError("window or slop is too large for the gap between documents")
    spark = index.sparkSession
    asked = C.materialize(windows_of(benchmark, window, item_col, text_col).groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = int(total) // BLOCK_WORDS + 1
    kind = "segment string, row long, doc_id long, n_words long, spans array<array<long>>, items array<string>"
    if blocks == 1:  # of a checked size: the windows go to every task
        rows = asked.collect()
        windows, items = [np.array(r["terms"], np.int64) for r in rows], [r["items"] for r in rows]
        given = spark.sparkContext.broadcast((windows, items))
        terms = spark.createDataFrame([(t,) for t in sorted({t for x in windows for t in x.tolist()})], "term long")
        own = index.where("term IS NULL").unionByName(index.join(F.broadcast(terms), "term", "left_semi").select(index.columns))
        return own.groupBy("segment").applyInArrow(_lookup(given, slop), kind).drop("segment", "row")
    # else each segment gets the windows that start with a term it has, over one join for all of them
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    near = index.join(terms, "term", "left_semi").select(index.columns)
    first = asked.select(F.get("terms", F.lit(0)).alias("term"), "terms", "items")
    sent = near.select(F.col("segment").alias("lot"), "term").join(first, "term").select("lot", "terms", "items")
    own = index.where("term IS NULL").unionByName(near)
    return own.groupBy("segment").cogroup(sent.groupBy("lot")).applyInArrow(_lookup_sent(slop), kind).drop("segment", "row")


def _lookup_sent(slop: int):
    """Searches one segment for the windows that are sent along."""

    class Given:
        def __init__(self, value):
            self.value = value

    def look(table: pa.Table, sent: pa.Table) -> pa.Table:
        given = Given(([np.array(x, np.int64) for x in sent["terms"].to_pylist()], sent["items"].to_pylist()))
        return _lookup(given, slop)(table)

    return look


def merged(spans: np.ndarray) -> list[list[int]]:
    """Overlapping or touching ranges as one."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[heads, 0], ends[np.append(heads[1:], len(spans)) - 1]], 1).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """search() over docs with n_hit, n_items and contaminated: some word is hit, and at least one in share of all.

    One row for each row of docs; ids are integers or null. Repeated rows are judged each for itself; other columns of
    either table are ignored; an empty table of documents gives none. Texts of any length are read whole, in a segment of
    their own if they are longer than one.
    """
    out = search(build_index(docs, id_col, text_col), benchmark, window, slop)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    out = out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).withColumnRenamed("doc_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that contamination() marks.

    Rows are known by the hash of their text, so ids may be null or repeat. All columns stay as they are, whatever their
    names; texts are judged whole, and an empty table stays empty.
    """
    hashed, gone = C.free_name(docs, "text_hash"), C.free_name(docs, "gone")
    own = docs.withColumn(hashed, F.xxhash64(text_col))
    marked = contamination(own, benchmark, id_col=hashed, text_col=text_col).where("contaminated").select(F.col(hashed).alias(gone)).distinct()
    return own.join(marked, F.col(hashed) == F.col(gone), "left_anti").select(docs.columns)
