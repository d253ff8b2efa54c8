"""Phrases whose words come together more often than apart, by suffix subtrees that are built group by group.

Texts become sequences of words, cut at stops. The suffix at each word, truncated to four words, belongs to a tree whose
nodes are phrases and whose leaf totals are their frequencies. The tree is never built whole. Words are counted first;
a word below the least count ends a suffix, for no phrase with it can count enough. Then the tree is partitioned by
prefixes whose number of suffixes fits a memory budget: a word that fits is a prefix by itself, and neighbouring ones
share a group until its budget is full; a prefix of words that are all above the budget is extended by the next word
until one is not, and such prefixes are dealt into groups by hash. Each group gathers its suffixes, sorts them, and
reads the frequency of every node from the totals of the leaves below; nodes above an extended prefix are added up over
groups by Spark. What follows, cuts, scores and absorbed phrases, are joins over the frequent phrases.

Blocks of a few megabytes spell their text once, as places in a list of their words. Suffixes of a block that are equal
travel once, with their number, packed by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm import _common as C
from kmerloom.plans.numbering import number_rows, running

#: Least frequency of a phrase, phrases reported for each language, most words of a phrase.
LEAST, TOP, WORDS = 30, 2000, 4
#: A phrase is absorbed by a longer one that holds it if the longer one has this share of its frequency.
ABSORB = (80, 100)
#: Suffixes in a group, and bytes of text in a block.
BUDGET, BLOCK = 1 << 20, 1 << 23

_STOP = b"\xff"  # never a byte of UTF-8
_STOPS, _UPPER = b".,;:!?\n\x0b\x0c\r", bytes(range(65, 91))
_TABLE = bytes.maketrans(_STOPS + b"\t" + _UPPER, _STOP * len(_STOPS) + b" " + _UPPER.lower())
_LOW = (1 << 32) - 1


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A to Z in lower case, with _STOP between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_STOP, b" " + _STOP + b" ").split()


class _Spelled:
    """The words of some texts of one language as places in the list of the words that they have; 0 is a stop."""

    def __init__(self):
        self.place, self.parts = {_STOP: 0}, []

    def add(self, words: list[bytes]) -> None:
        for w in set(words).difference(self.place):
            self.place[w] = len(self.place)
        self.parts.append(np.fromiter(map(self.place.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))


def _blocks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(blk, lang, n, words, counts, seq): a row for each block and language. words are parted by newlines."""
    block = BLOCK

    def rows(blk: int, own: dict[str, _Spelled]):
        for lang, spelled in own.items():
            seq = np.concatenate(spelled.parts)
            counts = np.bincount(seq, minlength=len(spelled.place))[1:]
            listed = b"\n".join(list(spelled.place)[1:])
            columns = [pa.array([x]) for x in (blk, lang, int(counts.sum()))]
            columns += [pa.array([x], pa.binary()) for x in (len(listed).to_bytes(8, "little") + pa.compress(listed, "zstd", asbytes=True), C.squeezed(counts), C.squeezed(seq))]
            yield pa.RecordBatch.from_arrays(columns, ["blk", "lang", "n", "words", "counts", "seq"])

    def run(batches):
        blk, own, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    own.setdefault("und" if lang is None else lang, _Spelled()).add(words)
                    size += len(text)
                if size >= block:
                    yield from rows(blk, own)
                    blk, own, size = blk + 1, {}, 0
        yield from rows(blk, own)

    return docs.select(docs[lang_col].cast("string"), docs[text_col]).mapInArrow(run, "blk long, lang string, n long, words binary, counts binary, seq binary")


def _listed(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True).split(b"\n") if n else []


def _word_rows(blocks: DataFrame) -> DataFrame:
    """(blk, lang, place, word, n): a row for each distinct word of a block."""

    def run(batches):
        for batch in batches:
            for blk, lang, words, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n = C.unsqueezed(counts)
                own = pa.array(_listed(words), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), blk)), pa.array([lang] * len(n)), pa.array(np.arange(1, len(n) + 1)), own, pa.array(n)], ["blk", "lang", "place", "word", "n"])

    return blocks.select("blk", "lang", "words", "counts").mapInArrow(run, "blk long, lang string, place long, word string, n long")


def _frequent_words(blocks: DataFrame, least: int, budget: int) -> DataFrame:
    """(lang, word, n, id, grp): frequent words, numbered from 1, with the group of the suffixes that begin with each; no
    group for words with more of them than the budget."""
    counted = _word_rows(blocks).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    numbered = number_rows(counted, "id", "lang", "word").withColumn("id", F.col("id") + 1)
    fits = F.when(F.col("n") <= budget, F.col("n")).otherwise(0)
    placed = running(numbered.withColumn("fits", fits), None, ["id"], upto=("sum", "fits"))
    group = F.when(F.col("n") <= budget, F.expr(f"(upto - fits) div {budget}"))
    return C.materialize(placed.select("lang", "word", "n", "id", group.alias("grp")), "words")


def _suffixes(blocks: DataFrame, words: DataFrame, groups: int, extended: int, most: int) -> DataFrame:
    """(grp, x, y, depth, n): the distinct suffixes of each block, packed by group. x and y hold two word ids each; depth is
    that of the prefix which chose the group. Groups from `groups` on are those of extended prefixes."""

    def leaves(block: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({"grp": pa.array([], pa.int64())} | {c: pa.array([], pa.binary()) for c in ("x", "y", "depth", "n")})
        if not len(known) or not len(block):
            return empty
        seq = C.unsqueezed(block["seq"].to_pylist()[0])
        place, ids, grp = (np.asarray(known[c]) for c in ("place", "id", "grp"))
        size = max(int(seq.max()), int(place.max())) + 1
        name, home = np.zeros(size, np.int64), np.full(size, -1)
        name[place], home[place] = ids, grp
        w, own = name[seq], home[seq]
        tail = np.zeros(WORDS - 1, np.int64)
        w, own = np.concatenate([w, tail]), np.concatenate([own, tail])
        at = np.flatnonzero((w[: len(seq)] > 0) & (w[1 : len(seq) + 1] > 0))
        cols, homes, live = [], [], np.ones(len(at), bool)
        for d in range(WORDS):
            live = live & (w[at + d] > 0) if d < most else np.zeros(len(at), bool)
            cols.append(np.where(live, w[at + d], 0))
            homes.append(np.where(live, own[at + d], -1))
        # the depth of the first word that fits the budget; without one the whole suffix, or one more if it could go on
        length = (np.array(cols) > 0).sum(axis=0)
        depth = np.where(length == most, most, length + 1)
        for d in reversed(range(WORDS)):
            depth = np.where(homes[d] >= 0, d + 1, depth)
        x, y = cols[0] << 32 | cols[1], cols[2] << 32 | cols[3]
        prefix = np.zeros(len(at), np.uint64)
        for d in range(WORDS):
            prefix = np.where(d < depth, C.mix(prefix + cols[d].astype(np.uint64) + np.uint64(1)), prefix)
        grp = np.where(depth == 1, homes[0], groups + (prefix % np.uint64(max(1, extended))).astype(np.int64))
        order = np.lexsort((y, x, grp))
        x, y, grp, depth = (v[order] for v in (x, y, grp, depth))
        head = np.ones(len(x), bool)
        head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        n = np.diff(np.append(np.flatnonzero(head), len(x)))
        x, y, grp, depth = (v[head] for v in (x, y, grp, depth))
        edges = [*np.flatnonzero(np.diff(grp, prepend=-1)).tolist(), len(grp)]
        cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        packed = {"x": [C.deltas(x[c]) for c in cut]} | {k: [C.squeezed(v[c]) for c in cut] for k, v in (("y", y), ("depth", depth), ("n", n))}
        return pa.table({"grp": pa.array(grp[edges[:-1]])} | {k: pa.array(v, pa.binary()) for k, v in packed.items()})

    asked = _word_rows(blocks).drop("n").join(words.select("lang", "word", "id", "grp"), ["lang", "word"])
    known = asked.select(F.col("blk").alias("_blk"), F.col("lang").alias("_lang"), "place", "id", F.coalesce("grp", F.lit(-1).cast("long")).alias("grp"))
    return blocks.select("blk", "lang", "seq").groupBy("blk", "lang").cogroup(known.groupBy("_blk", "_lang")).applyInArrow(lambda a, b: leaves(a, b), "grp long, x binary, y binary, depth binary, n binary")


def _subtree(table: pa.Table, least: int) -> pa.Table:
    """(x, y, n): the nodes of one group from two words on, by sorting its suffixes. Those that are whole in the group are
    left out below the least count; those above an extended prefix are parts of a total."""
    x = np.concatenate([C.from_deltas(r) for r in table["x"].to_pylist()])
    y, depth, n = (np.concatenate([C.unsqueezed(r) for r in table[c].to_pylist()]) for c in ("y", "depth", "n"))
    order = np.lexsort((y, x))
    x, y, depth, n = (v[order] for v in (x, y, depth, n))
    sums = np.concatenate([[0], np.cumsum(n)])
    out = []
    for d in range(2, WORDS + 1):
        # of suffixes with at least d words, the first d of them
        px, py = x, (y * 0 if d == 2 else y & ~_LOW if d == 3 else y)
        deep = np.ones(len(x), bool) if d == 2 else (y >> 32 > 0) if d == 3 else (y & _LOW > 0)
        head = np.ones(len(x), bool)
        head[1:] = (px[1:] != px[:-1]) | (py[1:] != py[:-1])
        first = np.flatnonzero(head)
        total = sums[np.append(first[1:], len(x))] - sums[first]
        keep = deep[first] & ((total >= least) | (depth[first] > d))
        out.append((px[first[keep]], py[first[keep]], total[keep]))
    return pa.table({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("x", "y", "n"))})


def phrase_counts(blocks: DataFrame, words: DataFrame, least: int = LEAST, most: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(x, y, a): the phrases of two and more frequent words that come at least so often. words: see _frequent_words()."""
    sizes = words.agg(F.coalesce(F.max("grp"), F.lit(-1)).alias("top"), F.coalesce(F.sum(F.when(F.col("grp").isNull(), F.col("n"))), F.lit(0)).alias("hot")).first()
    groups, extended = sizes["top"] + 1, -(-int(sizes["hot"]) // budget)
    leaves = _suffixes(blocks, words, groups, extended, most)
    nodes = leaves.groupBy("grp").applyInArrow(lambda t: _subtree(t, least), "x long, y long, n long")
    return nodes.groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = WORDS, absorb: tuple[int, int] = ABSORB, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to `most` words of each language.

    Texts are split at . , ; : ! ? and line breaks, and at spaces and tabs into words; A to Z become a to z. n counts all
    words of the language, a the phrase, l and r its two parts, at the cut where floor(2000000 a / (l + r)) is least (of
    ties the first). Phrases below `least` and phrases within a longer one that has at least the share `absorb` of their
    count are left out. Ranks go by score, then a, both descending, then phrase in byte order. Counts and scores are
    exact. A null language is `und`; null and empty texts have no words; repeated rows count each; texts of any length
    are taken whole; an empty table gives none. Other columns are not looked at, whatever their names. budget: suffixes
    that one task sorts at a time; it has no influence on the result.
    """
    if not 2 <= most <= WORDS:
        raise ValueError(f"phrases have 2 to {WORDS} words at most")
    blocks = C.materialize(_blocks(docs, lang_col, text_col), "spelled")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    share = (blocks.agg(F.sum("n")).first()[0] or 0) // C.shuffle_partitions(docs.sparkSession) + 1
    budget = min(budget, share)  # at least a group for each task
    words = _frequent_words(blocks, least, budget)
    found = C.materialize(phrase_counts(blocks, words, least, most, budget), "phrases")

    ids = [F.shiftright("x", 32), F.col("x").bitwiseAND(_LOW), F.shiftright("y", 32), F.col("y").bitwiseAND(_LOW)]
    spelled = found.withColumn("w", F.filter(F.array(*ids), lambda i: i > 0))
    key = lambda w: (F.shiftleft(F.get(w, F.lit(0)), 32).bitwiseOR(F.coalesce(F.get(w, F.lit(1)), F.lit(0).cast("long"))), F.shiftleft(F.coalesce(F.get(w, F.lit(2)), F.lit(0).cast("long")), 32).bitwiseOR(F.coalesce(F.get(w, F.lit(3)), F.lit(0).cast("long"))))
    part = lambda w, name: [c.alias(f"{name}{k}") for c, k in zip(key(w), "xy", strict=True)]
    single = words.select(F.shiftleft("id", 32).alias("x"), F.lit(0).cast("long").alias("y"), F.col("n").alias("a"))
    every = found.select("x", "y", "a").unionByName(single)
    # the two parts of every cut
    cuts = spelled.select("x", "y", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("x", "y", "a", "k", *part(F.expr("slice(w, 1, k)"), "l"), *part(F.expr("slice(w, k + 1, size(w) - k)"), "r"))
    cuts = cuts.join(every.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("a").alias("l")), ["lx", "ly"])
    cuts = cuts.join(every.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("a").alias("r")), ["rx", "ry"])
    score = F.expr("(2000000BD * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)").cast("long")
    scored = cuts.select("x", "y", "a", score.alias("score"), "k", "l", "r").groupBy("x", "y").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # the most frequent longer phrase around each
    inner = spelled.where("size(w) > 2").select("w", "a", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("m"))
    inner = inner.select("w", "a", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("i"))
    around = inner.select("a", *part(F.expr("slice(w, i, m)"), "")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["x", "y"], "left").where(f"longer IS NULL OR longer * {absorb[1]}BD < a * {absorb[0]}BD")

    named = words.select(F.col("id").alias("w1"), "lang")
    ranked = kept.select("x", "y", "a", "s.score", "s.l", "s.r", ids[0].alias("w1")).join(named, "w1")
    near = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = C.materialize(ranked.withColumn("near", near).where(F.col("near") <= top).select("lang", "x", "y", "a", "l", "r", "score"), "best")
    each = best.select("x", "y", F.posexplode(F.array(*ids)).alias("i", "id")).where("id > 0").join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ")
    out = best.join(each.groupBy("x", "y").agg(phrase.alias("phrase")), ["x", "y"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
