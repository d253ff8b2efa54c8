"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

from kmerloom.llm import _common as C

#: Words the cache of one Python worker may hold (later ones are encoded each time), and the longest word it keeps. A word
#: enters when it comes a second time, judged by one of so many marks.
CACHE_WORDS, CACHE_CHARS, CACHE_MARKS = 300_000, 64, 1 << 22

#: Byte-level alphabet: a byte that does not print stands for the next free character from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary."""
    return {b: _BYTES.get(b, b) for b in range(256)}


#: Latin-1 lower case, and for each byte: a letter or digit, a blank, a stop or comma, or something else.
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_KIND = bytes(ord("a" if c.isalpha() or c in "0123456789" else " " if c == " " else "." if c in ".," else "!") for c in map(chr, range(256)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_stretch(path: str) -> bool:
    """Whether the tokenizer file lower-cases, drops white space and is a word-end BPE, and adds no tokens with white space."""
    with open(path, encoding="utf-8") as handle:
        own = json.load(handle)
    steps = lambda x: [y for y in (x.get(k) for k in ("normalizers", "pretokenizers")) if y][0] if "Sequence" == x.get("type") else [x]
    kinds = [x.get("type") for x in steps(own.get("normalizer") or {})]
    splits = [x for x in steps(own.get("pre_tokenizer") or {}) if x.get("type") == "Split"]
    removed = any(x.get("behavior") == "Removed" or (x.get("behavior") == "Isolated" and x.get("invert")) for x in splits)
    added = all(not any(c.isspace() for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in own.get("added_tokens", []))
    return "Lowercase" in kinds and removed and added and bool(own["model"].get("end_of_word_suffix"))


class Encoder(dict):
    """Token ids (uint32 bytes) by stretch between blanks, for tokenizers that lower-case and drop white space; any other
    is asked for whole texts.

    Such a tokenizer never joins characters across white space, so ids of a text are the ids of its stretches, one after
    the other. Stretches repeat, and each is then encoded once. In texts of Latin-1 letters, where lower case is the same
    for everyone, case and a single closing stop or comma are split off first, so that fewer stretches differ.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_stretch = _by_stretch(path)
        self.model = self.tokenizer.model
        self.seen = bytearray(CACHE_MARKS)
        self.small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16

    def __missing__(self, word: str | bytes) -> bytes:
        text = word.decode("latin-1") if isinstance(word, bytes) else word
        if text.isalpha() and text.islower() and max(text) <= "ÿ":  # one run of letters: the model's own input
            inner = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            found = [t.id for t in self.model.tokenize(inner)]
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = array("I", found).tobytes()
        mark = hash(word) % CACHE_MARKS
        if not self.seen[mark]:
            self.seen[mark] = 1
        elif len(word) <= CACHE_CHARS and len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_stretch:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text:  # else it may hold a special token, whose case counts
            try:
                low = text.encode("latin-1").translate(_LOWER)
            except UnicodeEncodeError:
                pass
            else:
                low = low.replace(b"\n", b" ") + b" "
                kind = low.translate(_KIND)
                if b"!. " not in kind and b".. " not in kind:  # else the stop may belong to a longer run
                    low = low.replace(b". ", b" . ").replace(b", ", b" , ")
                return b"".join(map(self.__getitem__, low.split(b" ")))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


C.CACHES.append(encoder)
