"""Aligning the tokens of two tokenizers: a byte-level BPE (A) and a sentence-piece model (B) over the same bytes.

Both ids of many documents are Arrow lists. Flattened with their parent indices, token sizes become byte ends by a
segmented cumulative sum; a hash join on (document, end) finds where tokens of both end, which cuts them into groups; a
second join, on the group, links every A token with every B token of it. Table.group_by makes the links of a document
distinct and counts, for a block of documents, how many hold each pair of ids. Spark adds these counts up.

What a document's links count in the whole corpus travels by block, not by link: a block asks for each distinct pair of
its documents once, packed, in buckets of pairs, and gets the counts back in the same order. Blocks with their links are
a written table, so that nothing depends on running a task twice alike.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.llm import bpe

#: Bytes of text that are aligned at once, and bytes of text in a block.
CHUNK, BLOCK = 1 << 18, 1 << 23
#: Pairs with their counts in a bucket, and pairs that are asked of one copy of it.
BUCKET_PAIRS, ASKED_PAIRS = 1 << 18, 1 << 20
#: Links of a group from which on equal ids of it are counted before they are linked.
WIDE = 64
#: Stretches of text whose ids one Python worker keeps.
CACHE = 200_000

_MARK = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Ids (int32 bytes) of a sentence-piece model by stretch: spaces, then what follows up to the next space.

    No piece of such a model goes on with a space after another character, so the ids of a text are those of its
    stretches. Where a model has such pieces, or adds no space before a text, whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        ids = own.encode
        self.space = np.array([own.piece_to_id(_MARK)], np.int32).tobytes()
        self.by_stretch = not any(_MARK in p.lstrip(_MARK) for p in pieces) and ids("a  b ") == ids("a") + ids(" b") + ids("") + [own.piece_to_id(_MARK)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, given with a space before it."""
        if not self.by_stretch:
            return [np.array(x, np.int32).tobytes() for x in self.model.encode([t[1:].decode() for t in texts], num_threads=1)]
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        own = np.frombuffer(data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        space = own == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(start)
        edges = [*starts.tolist(), len(data)]
        words = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(self) > CACHE:
            self.clear()
        new = list(set(words).difference(self))
        self.update(zip(new, (array("i", x).tobytes() for x in self.model.encode([w[1:].decode() for w in new], num_threads=1)), strict=True))
        self[b" "] = self.space  # a last space by itself; the model adds none before an empty text
        found = list(map(self.__getitem__, words))
        cut = np.searchsorted(starts, offsets).tolist()
        return [b"".join(found[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Pair:
    """Both tokenizers with what the alignment needs of their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = bpe.tokenizer(a_path, True), _pieces(b_path)
        self.tables, self.sizes, strings = [], [], []
        for own, last in ((self.a, "|"), (self.b, ";")):
            data, offsets = np.frombuffer(b"".join(own.token_bytes), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own.token_bytes])])
            self.tables.append((data, offsets))
            self.sizes.append(pa.array(np.diff(offsets)))
            strings += [f"{i}{end}" for i in range(len(own.token_bytes)) for end in (",", last)]
        self.strings = pa.array(strings, pa.large_string())  # a token's id, followed by what comes after it
        self.n_a, self.n_b = len(self.a.token_bytes), len(self.b.token_bytes)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _lists(coded: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


class Aligned:
    """The groups of some documents. Arrays over tokens of a side x (0: A, 1: B): ids[x], doc[x], closes[x], group[x]."""

    def __init__(self, own: Pair, texts: list[str | None]):
        spaced = [b" " + t.encode() if t else b"" for t in texts]
        lists = [_lists(own.a._encode(spaced)), _lists(own.b.encode(spaced))]
        # documents that either side does not give back byte by byte have no tokens
        whole = np.ones(len(texts), bool)
        for x in (0, 1):
            data, ends = bpe.gathered(own.tables[x], np.asarray(lists[x].flatten(), np.int64))
            if data != b"".join(spaced):
                cut = np.concatenate([[0], ends])[np.asarray(lists[x].offsets)].tolist()
                whole &= [data[a:b] == t for a, b, t in zip(cut[:-1], cut[1:], spaced, strict=True)]
        if not whole.all():
            lists = [pc.if_else(pa.array(whole), v, pa.scalar([], v.type)) for v in lists]
        self.n = len(texts)
        self.ids, self.doc, tables = [], [], []
        longest = pa.scalar(max(map(len, spaced), default=0) + 1, pa.int64())
        for x in (0, 1):
            flat, doc = pc.list_flatten(lists[x]), pc.list_parent_indices(lists[x])
            total = pc.cumulative_sum(pc.take(own.sizes[x], flat))
            heads = np.concatenate([[0], np.asarray(total)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists[x])))])[:-1]]
            end = pc.subtract(total, pc.take(pa.array(heads, pa.int64()), doc))  # segmented: from the document's own start
            doc = doc.cast(pa.int64())
            key = pc.add(pc.multiply(doc, longest), end)  # (document, end) as one number
            tables.append(pa.table({"key": key, f"t{x}": pa.array(np.arange(len(flat)))}))
            self.ids.append(np.asarray(flat, np.int64))
            self.doc.append(np.asarray(doc, np.int64))
        both = tables[0].join(tables[1], "key", join_type="inner", use_threads=False)
        self.closes, self.group = [], []
        for x in (0, 1):
            closes = np.zeros(len(self.ids[x]), bool)
            closes[np.asarray(both[f"t{x}"])] = True
            self.closes.append(closes)
            self.group.append(np.cumsum(closes) - closes)
        self.group_doc = self.doc[0][self.closes[0]]
        self.group_sizes = [np.bincount(g, minlength=len(self.group_doc)) for g in self.group]

    def per_doc(self, doc: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Exact sums (or counts) by document; doc is sorted."""
        edges = np.searchsorted(doc, np.arange(self.n + 1))
        sums = np.concatenate([[0], np.cumsum(np.ones(len(doc), np.int64) if values is None else values)])
        return sums[edges[1:]] - sums[edges[:-1]]

    def texts(self, own: Pair) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each document: the groups in order, with the ids of both sides."""
        before = [np.concatenate([[0], np.cumsum(s)]) for s in self.group_sizes]
        at = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        at[np.arange(len(self.ids[0])) + before[1][self.group[0]]] = 2 * self.ids[0] + self.closes[0]
        at[np.arange(len(self.ids[1])) + before[0][self.group[1] + 1]] = 2 * (own.n_a + self.ids[1]) + self.closes[1]
        joined = pc.take(own.strings, pa.array(at))
        _, places, data = joined.buffers()
        places = np.frombuffer(places, np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        edges = places[np.concatenate([[0], np.cumsum(self.per_doc(self.doc[0]) + self.per_doc(self.doc[1]))])].tolist()
        return [data[a : b - 1].to_pybytes() if b > a else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def links(self, own: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, n): how often each pair of ids is linked in each document. pair: the A id times B's size, and the B id."""
        wide = self.group_sizes[0] * self.group_sizes[1] > WIDE
        sides = []
        for x in (0, 1):
            side = pa.table({"g": pa.array(self.group[x]), f"i{x}": pa.array(self.ids[x]), f"n{x}": pa.array(np.ones(len(self.ids[x]), np.int64))})
            if wide.any():
                own_wide = pa.array(wide[self.group[x]])
                counted = side.filter(own_wide).group_by(["g", f"i{x}"], use_threads=False).aggregate([(f"n{x}", "sum")]).rename_columns({f"n{x}_sum": f"n{x}"})
                side = pa.concat_tables([side.filter(pc.invert(own_wide)), counted.select(side.column_names)])
            sides.append(side)
        linked = sides[0].join(sides[1], "g", join_type="inner", use_threads=False)
        g, a, b, m, n = (np.asarray(linked[c]) for c in ("g", "i0", "i1", "n0", "n1"))
        # one key for both columns: a chunk has fewer documents than would let it overflow
        pair = a * own.n_b + b
        keyed = pa.table({"key": pa.array(self.group_doc[g] * (own.n_a * own.n_b) + pair), "n": pa.array(m * n)})
        found = keyed.group_by("key", use_threads=False).aggregate([("n", "sum")])
        key = np.asarray(found["key"])
        return *np.divmod(key, own.n_a * own.n_b), np.asarray(found["n_sum"])


def _chunks(batches, chunk: int):
    """(ids, texts) of so many documents that their texts are about chunk bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 64
            if size >= chunk:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_sizes, b_sizes) of every row: the ids of both sides and how many of each every group has.

    A encodes a space and the text, B the text, to which it adds the space; strings of special tokens are plain text.
    Null and empty texts, and texts that either side does not give back byte by byte, have no tokens: empty arrays. Rows
    are independent of each other, so repeated rows, ties and null ids give a row each; texts of any length are taken
    whole; an empty table gives none. Other columns are not looked at, whatever their names.
    """
    paths = default_paths()
    a_path, b_path = a_path or paths[0], b_path or paths[1]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = _pair(a_path, b_path)
        for ids, texts in _chunks(batches, chunk):
            found = Aligned(own, texts)
            listed = [(v.astype(np.int32), found.per_doc(d)) for v, d in ((found.ids[0], found.doc[0]), (found.ids[1], found.doc[1]), *((s, found.group_doc) for s in found.group_sizes))]
            columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v)) for v, n in listed]
            yield pa.RecordBatch.from_arrays([pa.array(ids, docs_type), *columns], ["id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    docs_type, chunk = _arrow_type(kind), CHUNK
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>").withColumnRenamed("id", id_col)


def _arrow_type(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in known:
        raise ValueError(f"ids are bigint, int or string, not {kind}")
    return known[kind]


# ---- Links of all documents ---------------------------------------------------------------------------------------

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, text: bool) -> DataFrame:
    """A row for each block of documents: their measures and groups, the distinct pairs with the number of documents that
    hold each, and for each document its links, as places among the pairs."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind, chunk, block = _arrow_type(kind), CHUNK, BLOCK
    schema = f"blk long, ids array<{kind}>, {', '.join(f'{m} array<bigint>' for m in MEASURES)}, groups array<string>, n_pairs long, pairs binary, counts binary, places binary, times binary, linked binary"

    def row(blk: int, parts: list) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        measures = [np.concatenate([p[1][m] for p in parts]) for m in range(len(MEASURES))]
        doc = np.concatenate([p[3] + sum(len(q[0]) for q in parts[:k]) for k, p in enumerate(parts)])
        pair, n = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
        counted = pa.table({"pair": pa.array(pair)}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by("pair")
        pairs, counts = np.asarray(counted["pair"]), np.asarray(counted["pair_count"])
        place = np.searchsorted(pairs, pair)
        order = np.lexsort((place, doc))
        columns = [pa.array([blk], pa.int64()), pa.array([ids], pa.list_(arrow_kind)), *(pa.array([m], pa.list_(pa.int64())) for m in measures)]
        columns += [pa.array([[g for p in parts for g in p[2]]], pa.list_(pa.string())), pa.array([len(pairs)], pa.int64())]
        linked = np.bincount(doc, minlength=len(ids))
        columns += [pa.array([x], pa.binary()) for x in (C.deltas(pairs), C.squeezed(counts), C.deltas(place[order]), C.squeezed(n[order]), C.squeezed(linked))]
        return pa.RecordBatch.from_arrays(columns, ["blk", "ids", *MEASURES, "groups", "n_pairs", "pairs", "counts", "places", "times", "linked"])

    def run(batches):
        own, parts, size = _pair(a_path, b_path), [], 0
        blk = TaskContext.get().partitionId() << 32
        for ids, texts in _chunks(batches, chunk):
            found = Aligned(own, texts)
            groups = [t.decode() if text else hashlib.sha256(t).hexdigest() if t else "" for t in found.texts(own)]
            measures = (found.per_doc(found.doc[0]), found.per_doc(found.doc[1]), found.per_doc(found.group_doc), found.per_doc(found.group_doc, found.group_sizes[0] * found.group_sizes[1]))
            parts.append((ids, measures, groups, *found.links(own)))
            size += sum(len(t or "") for t in texts)
            if size >= block:
                yield row(blk, parts)
                blk, parts, size = blk + 1, [], 0
        if parts:
            yield row(blk, parts)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def _totals(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of its A id has more."""

    def run(batches):
        for batch in batches:
            for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(C.from_deltas(pairs)), pa.array(C.unsqueezed(counts))], ["pair", "n"])

    counted = blocks.select("pairs", "counts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = C.materialize(counted.withColumn("a", F.expr(f"pair div {n_b}")), "pair_counts")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # an id has at most as many pairs as the other vocabulary
    return counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs, best) of all pairs that any document links: in how many documents, and whether that is the most
    of all pairs of the A id (ties are all best). Rows that repeat count each; see align() for texts without tokens."""
    paths = default_paths()
    a_path, b_path = a_path or paths[0], b_path or paths[1]
    n_b = len(_pieces(b_path).token_bytes)
    blocks = C.materialize(_blocks(docs, a_path, b_path, id_col, text_col, False), "blocks")
    return _totals(blocks, n_b).select(F.expr(f"pair div {n_b}").alias("a_id"), F.expr(f"pair % {n_b}").alias("b_id"), F.col("n").alias("n_docs"), "best")


def link_measures(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", groups: str = "sha256") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    n_links: occurrence pairs of A and B tokens in one group. n_best: those whose pair of ids is linked in as many
    documents as any pair of its A id. count_sum: these numbers of documents, added up over the links. groups: for
    "text" a1,a2|b1;a3|b2,b3, the ids of every group in order; for "sha256" the digest of that text, which is what a
    table of all documents can afford. Null and empty texts, and texts that either side does not give back byte by byte,
    have zeros and an empty string. Repeated rows count as documents each; ties are all best; null ids are kept; texts
    of any length are taken whole; an empty table gives none. Other columns are not looked at, whatever their names.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups is text or sha256")
    spark, paths = docs.sparkSession, default_paths()
    a_path, b_path = a_path or paths[0], b_path or paths[1]
    n_b = len(_pieces(b_path).token_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = _arrow_type(kind)
    blocks = C.materialize(_blocks(docs, a_path, b_path, id_col, text_col, groups == "text"), "blocks")
    totals = C.materialize(_totals(blocks, n_b), "totals")
    asked = blocks.agg(F.sum("n_pairs")).first()[0] or 0
    partitions = C.shuffle_partitions(spark)
    buckets = max(partitions, -(-totals.count() // BUCKET_PAIRS))
    copies = max(1, -(-asked // (buckets * ASKED_PAIRS)))  # so that the copies hold no more rows than are asked

    def ask(batches):
        for batch in batches:
            for blk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = C.from_deltas(raw)
                own = pairs % buckets
                order = np.argsort(own, kind="stable")
                edges = np.searchsorted(own[order], np.arange(buckets + 1))
                there = np.flatnonzero(np.diff(edges))
                packed = [C.deltas(pairs[order[edges[b] : edges[b + 1]]]) for b in there]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), blk % copies)), pa.array(np.full(len(there), blk)), pa.array(packed, pa.binary())], ["bucket", "copy", "blk", "pairs"])

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        pairs, n, best = (np.asarray(known[c]) for c in ("pair", "n", "best"))
        out = []
        for raw in asks["pairs"].to_pylist():
            at = np.searchsorted(pairs, C.from_deltas(raw))
            out.append(C.squeezed(2 * n[at] + best[at]))
        return pa.table({"blk": asks["blk"], "bucket": asks["bucket"], "counts": pa.array(out, pa.binary())})

    def close(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = block.to_pylist()[0]
        pairs = C.from_deltas(own["pairs"])
        count, bucket = np.zeros(len(pairs), np.int64), pairs % buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, raw in zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True):
            count[order[edges[b] : edges[b + 1]]] = C.unsqueezed(raw)
        place, times, linked = C.from_deltas(own["places"]), C.unsqueezed(own["times"]), C.unsqueezed(own["linked"])
        stop = np.cumsum(linked)
        sums = []
        for value in ((count & 1)[place] * times, (count >> 1)[place] * times):
            total = np.concatenate([[0], np.cumsum(value)])
            sums.append(total[stop] - total[stop - linked])
        columns = {"id": pa.array(own["ids"], arrow_kind)} | {m: pa.array(own[m], pa.int64()) for m in MEASURES}
        return pa.table(columns | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups": pa.array(own["groups"], pa.string())})

    asks = blocks.select("blk", "pairs").mapInArrow(ask, "bucket long, copy long, blk long, pairs binary")
    known = totals.select((F.col("pair") % buckets).alias("_bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("_copy"), "pair", "n", "best")
    answers = asks.groupBy("bucket", "copy").cogroup(known.groupBy("_bucket", "_copy")).applyInArrow(lambda x, y: answer(x, y), "blk long, bucket long, counts binary")
    schema = f"id {kind}, {', '.join(f'{m} bigint' for m in MEASURES)}, n_best bigint, count_sum bigint, groups string"
    done = blocks.drop("counts", "n_pairs").groupBy("blk").cogroup(answers.withColumnRenamed("blk", "_blk").groupBy("_blk")).applyInArrow(close, schema)
    return done.withColumnRenamed("id", id_col)
