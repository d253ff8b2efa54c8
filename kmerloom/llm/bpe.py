"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut into words as the tokenizer file's own splitter cuts it. For each new word the longest vocabulary entry at
every byte is looked up, and following them from the first byte proposes tokens. A proposal is what merging in order of
rank gives exactly if every token is made from its own bytes and no two neighbours would have merged across the place
where they meet at any time; that is tested for all neighbours at once. Only words that fail are merged step by step.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kmerloom.llm import _common as C
from kmerloom.llm._tokens import byte_alphabet

#: Words that one Python worker keeps with their ids; when there are more, it starts afresh.
CACHE_WORDS = 300_000
#: Bytes of a word from which on it is merged by itself, with a heap.
LONG_WORD = 200
#: Bytes of text that are cut into words at once.
CHUNK = 1 << 19
#: Classes of characters, as the splitter treats them.
LETTER, NUMBER, OTHER, WHITE, UNKNOWN = range(5)
_NEVER = 1 << 40  # a rank later than all


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """Words of texts as the file's byte-level splitter cuts them, for whole arrays of characters.

    A word is a run of letters, of numbers or of other characters with a space before it if there is one, a contraction
    after an apostrophe, or white space without what the next word takes of it. Which class a character has is asked of
    the library once, so that it follows the library's Unicode tables.
    """

    def __init__(self, pre_tokenizer):
        self.pre = pre_tokenizer
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _classify(self, codes: np.ndarray) -> None:
        for c in codes:
            char = chr(c)
            own = [k for k, first in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.pre.pre_tokenize_str(first + char)) == 1]
            self.classes[c] = own[0] if own else WHITE

    def starts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start. codes: characters of texts on end; offsets: where each text starts, and the end."""
        n = len(codes)
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            self._classify(np.unique(codes[kind == UNKNOWN]))
            kind = self.classes[codes]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        white = kind == WHITE
        before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[head[:n]] = after[head[1:]] = UNKNOWN  # beyond the text
        spaced = np.zeros(n, bool)
        spaced[1:] = codes[:-1] == 32
        spaced[head[:n]] = False
        # a space belongs to the word behind it; of longer white space only the last character may
        start = np.where(white, (before != WHITE) | (after < WHITE), (before != kind) & ~spaced)
        start |= head[:n]
        at = np.flatnonzero((codes == 39) & start)
        if len(at):
            low = np.concatenate([codes, np.zeros(2, codes.dtype)])
            one, two = low[at + 1], low[at + 2]
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re, ve, ll
            long &= ~head[np.minimum(at + 1, n)] & ~head[np.minimum(at + 2, n)]
            short = np.isin(one, (115, 116, 109, 100)) & ~head[np.minimum(at + 1, n)]  # s, t, m, d
            for taken, size in ((short, 1), (long & ~short, 2)):
                own = at[taken]
                start[own + 1] = False
                nxt = own + 1 + size
                start[nxt[nxt < n]] = True
        return np.flatnonzero(start)


class ByteBPE(dict):
    """Ids (int32 bytes) by word. plain: special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__()
        with open(path, encoding="utf-8") as handle:
            own = json.load(handle)
        model, pre = own["model"], own.get("pre_tokenizer") or {}
        wanted = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not wanted or own.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in own["added_tokens"]):
            raise ValueError(f"{path}: not a byte-level BPE with its own splitter, without normalizer and dropout")
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer)
        to_byte = {chr(code): bytes([b]) for b, code in byte_alphabet().items()}
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in own["added_tokens"]}
        self.special = {} if plain else self.added
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = b"".join(map(to_byte.__getitem__, text))
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.byte_id = np.array([vocab[chr(byte_alphabet()[b])] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(p)] for p in pairs], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError(f"{path}: two merges make one token")
        self.made = made
        self.left, self.right, self.rank = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made], self.rank[made] = left, right, np.arange(len(made))
        self.merges = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.keys = left << 32 | right
        order = np.argsort(self.keys)
        self.keys, self.key_rank = self.keys[order], order
        if (np.maximum(self.rank[left], self.rank[right]) >= self.rank[made]).any():
            raise ValueError(f"{path}: a merge stands before those of its parts")
        # tokens that merging makes from their own bytes; others are never proposed
        good = np.zeros(size, bool)
        good[self.byte_id] = True
        whole = self.compatible(left, right, inner=True)
        for a, b, c, ok in zip(left.tolist(), right.tolist(), made.tolist(), whole.tolist(), strict=True):
            good[c] = ok and good[a] and good[b]
        self._grow_trie(np.flatnonzero(good))
        self.split_at = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    # ---- proposals ------------------------------------------------------------------------------------------------

    def _grow_trie(self, tokens: np.ndarray) -> None:
        children: dict[int, int] = {}
        ends = [-1]
        for t in tokens.tolist():
            node = 0
            for byte in self.token_bytes[t]:
                key = node << 8 | byte
                node = children.get(key)
                if node is None:
                    node = children[key] = len(ends)
                    ends.append(-1)
            ends[node] = t
        self.ends = np.array(ends, np.int64)
        keys, nodes = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], nodes[order]
        self.root = np.zeros(256, np.int64)
        self.root[keys[keys < 256]] = nodes[keys < 256]

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest entry that starts at each byte and ends by ends."""
        node = self.root[data]
        token, size = self.ends[node], np.ones(len(data), np.int64)
        live, depth = np.flatnonzero(ends > np.arange(len(data)) + 1), 1
        node = node[live]
        while len(live):
            key = node << 8 | data[live + depth]
            at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            go = self.trie_keys[at] == key
            live, node, depth = live[go], self.trie_nodes[at[go]], depth + 1
            hit = self.ends[node] >= 0
            token[live[hit]], size[live[hit]] = self.ends[node[hit]], depth
            more = live + depth < ends[live]
            live, node = live[more], node[more]
        return token, size

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or _NEVER."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NEVER)

    # ---- verification ---------------------------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether no merge ever joins the end of token a with the start of token b, when a stands before b.

        While both are made, what stands at the end of a runs through a's right spine and what stands at the start of b
        through b's left spine. A merge of two of these happens if it comes before the merge that next takes in the left
        one, and not after the merge that takes in the right one (of equal merges the left goes first). The spines are
        walked from their tops, the later-made side first. inner: the merge of a and b themselves does not count.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            rank = self._ranks(x, y)
            clash = (rank < until_x) & (rank <= until_y) & (rank < _NEVER)
            if inner:
                clash[:], inner = False, False
            ok[live[clash]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            live, x, y, until_x, until_y, made_x, made_y = (v[go] for v in (live, x, y, until_x, until_y, made_x, made_y))
            first = made_x > made_y
            until_x, until_y = np.where(first, made_x, until_x), np.where(first, until_y, made_y)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    # ---- words ----------------------------------------------------------------------------------------------------

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of words by exact merging: each round applies the pair of least rank of every word, wherever it
        stands there, the leftmost first, to all words at once. New pairs always have later ranks."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner, name = np.repeat(np.arange(len(words)), sizes), np.arange(len(words))
        rank = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            done = least == _NEVER
            if done.any():
                stops = [*first[1:].tolist(), len(ids)]
                raw = ids.astype(np.int32).tobytes()
                for w in np.flatnonzero(done).tolist():
                    out[name[owner[first[w]]]] = raw[4 * int(first[w]) : 4 * stops[w]]
                stay = np.repeat(~done, np.diff([*first, len(ids)]))
                ids, owner, rank, least = ids[stay], owner[stay], rank[stay], least[~done]
                if not len(ids):
                    break
                first = np.flatnonzero(np.diff(owner, prepend=-1))
            hit = rank == np.repeat(least, np.diff([*first, len(ids)]))
            place = np.arange(len(ids))
            begins = np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0)
            take = np.flatnonzero(hit & ((place - np.maximum.accumulate(begins)) % 2 == 0))  # of pairs that overlap every second
            ids[take] = self.made[rank[take]]
            keep = np.ones(len(ids), bool)
            keep[take + 1] = False
            new = np.cumsum(keep)[take] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            around = np.unique(np.concatenate([new, new[new > 0] - 1]))
            rank[around] = _NEVER
            around = around[around + 1 < len(ids)]
            around = around[owner[around] == owner[around + 1]]
            rank[around] = self._ranks(ids[around], ids[around + 1])
        return out

    def merged(self, word: bytes) -> list[int]:
        """The ids of one long word by merging the pair of least rank, the leftmost first, until there is none."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, merges = len(ids), self.merges
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (own := merges.get((ids[i], ids[k]))) is not None:
                    heappush(heap, (own[0], i))
            if (h := prv[i]) >= 0 and (own := merges.get((ids[h], ids[i]))) is not None:
                heappush(heap, (own[0], h))
        return [t for t in ids if t >= 0]

    def add(self, words: list[bytes]) -> None:
        """Encode new words: propose, verify, merge where that fails."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(sizes)
        token, size = self.longest(data, np.repeat(stops, sizes))
        after = (np.arange(len(data)) + size).tolist()
        places, counts, p = [], [], 0
        for stop in stops.tolist():
            before = len(places)
            while p < stop:
                places.append(p)
                p = after[p]
            counts.append(len(places) - before)
        ids, counts = token[places], np.array(counts)
        last = np.cumsum(counts)
        pair = np.ones(len(ids), bool)
        pair[last - 1] = False
        at = np.flatnonzero(pair)
        keys, back = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[np.searchsorted(last, at[~self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]], "right")] = True
        raw, edges = ids.astype(np.int32).tobytes(), [0, *(last * 4).tolist()]
        self.update(zip(words, map(raw.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True))
        failed = [words[i] for i in np.flatnonzero(bad).tolist()]
        for word in [w for w in failed if len(w) > LONG_WORD]:
            self[word] = np.array(self.merged(word), np.int32).tobytes()
        short = [w for w in failed if len(w) <= LONG_WORD]
        self.update(zip(short, self.merged_all(short), strict=True))

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without special tokens in them."""
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if data.isascii():
            starts = self.splitter.starts(np.frombuffer(data, np.uint8), offsets)
        else:
            codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))])
            starts = at[self.splitter.starts(codes, np.searchsorted(at, offsets))]
        edges = [*starts.tolist(), len(data)]
        words = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list(set(words).difference(self))
        if new:
            self.add(new)
        found = list(map(self.__getitem__, words))
        cut = np.searchsorted(starts, offsets).tolist()
        return [b"".join(found[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; null is an empty text."""
        out, group, size = [], [], 0

        def flush():
            pieces, owners = [], []
            for k, text in enumerate(group):
                own = self.split_at.split(text) if self.split_at and self.split_at.search(text) else [text]
                pieces += own
                owners += [(k, i % 2 == 1) for i in range(len(own))]
            coded = self._encode([b"" if named else p.encode() for p, (_, named) in zip(pieces, owners, strict=True)])
            parts: list[list[bytes]] = [[] for _ in group]
            for piece, own, (k, named) in zip(pieces, coded, owners, strict=True):
                parts[k].append(np.array([self.special[piece]], np.int32).tobytes() if named else own)
            out.extend(b"".join(p) for p in parts)

        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= CHUNK:
                flush()
                group, size = [], 0
        flush()
        return out

    # ---- decoding -------------------------------------------------------------------------------------------------

    def token_table(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens on end, where each starts, and the end)."""
        return np.frombuffer(b"".join(self.token_bytes), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in self.token_bytes])])


@lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool = False) -> ByteBPE:
    return ByteBPE(path, plain)


def gathered(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of the tokens on end, where each ends)."""
    data, offsets = table
    sizes = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return data[at].tobytes(), ends


def encode_bpe(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """(id, ids): the token ids (array<int>) of every whole text, as the tokenizers library gives them without adding
    special tokens. plain: strings of special tokens in a text are ordinary text instead of those tokens.

    Null and empty texts give no ids. Rows are independent of each other, so repeated rows, ties and null ids give a row
    each; very long texts and words are taken whole; an empty table gives none. Other columns are not looked at,
    whatever their names.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = tokenizer(path, plain)
        for batch in C.small_batches(batches, 500):
            coded = own.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_bpe(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, special tokens included, as the library decodes them.

    Ids that the vocabulary does not have, and null ones, count as nothing; bytes that are no UTF-8 become U+FFFD. A null
    list gives an empty text. A column that has the new name already is replaced; all others pass through.
    """
    path = path or default_path()
    others = [c for c in encoded.columns if c.lower() != decoded_col.lower()]
    schema = encoded.select(*(encoded[c] for c in others)).schema.add(decoded_col, "string")

    def run(batches):
        own = tokenizer(path)
        table = own.token_table()
        for batch in C.small_batches(batches, 500):
            lists = batch.column(others.index(ids_col))
            ids, doc = np.asarray(lists.flatten().fill_null(-1), np.int64), np.asarray(pa.compute.list_parent_indices(lists))
            known = (ids >= 0) & (ids < len(own.token_bytes))
            data, ends = gathered(table, ids[known])
            cut = np.concatenate([[0], ends])[np.searchsorted(doc[known], np.arange(batch.num_rows + 1))].tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.select(*(encoded[c] for c in others)).mapInArrow(run, schema)
