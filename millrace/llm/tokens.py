"""Token ids of whole texts, through a bounded cache of white-space-free chunks.

The tokenizer's splitting pattern matches no white space and its normaliser only
folds runs of white space, so the ids of a text are the ids of its chunks between
ASCII white space, one after the other. Chunks repeat far more often than texts.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks kept per worker; the cache starts afresh beyond that.
CACHE_CHUNKS = 300_000
#: Longer chunks are encoded each time instead of being kept.
CACHE_BYTES = 64

#: Chunks of these characters are in normal form, and lower-casing and splitting them
#: here gives what the tokenizer's own normaliser gives; all other chunks go to it.
_PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\xc0-\u012f\u0131-\u017f]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """The fast way holds for byte-level BPE that lower-cases and splits by a pattern, as read
    from the tokenizer's own file; chunks that are out of the ordinary go through the tokenizer."""

    def __init__(self, path: str, dtype: str, special_as_text: bool):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.dtype = np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.cache: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        split = json.loads(self.tok.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split + r"|\n").findall
        self.letters = _byte_letters()

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        out = array(self.code, [t.id for t in self.tok.model.tokenize(plain)]).tobytes()
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        self.words[word] = out
        return out

    def _fill(self, chunks: list[bytes], into: dict[bytes, bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = [k for k, t in enumerate(texts) if _PLAIN(t)]
        if len(plain) < len(texts):
            odd = sorted(set(range(len(texts))).difference(plain))
            for k in range(0, len(odd), 4096):
                some = odd[k : k + 4096]
                found = self.tok.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)
                for i, e in zip(some, found):
                    into[chunks[i]] = np.array(e.ids, self.dtype).tobytes()
        words, word = self.words, self._word
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            at, parts = 0, []
            for w in self.find("\n".join([texts[i] for i in some]).lower()):
                if w == "\n":
                    into[chunks[some[at]]] = parts[0] if len(parts) == 1 else b"".join(parts)
                    at, parts = at + 1, []
                else:
                    parts.append(words.get(w) or word(w))
            into[chunks[some[at]]] = b"".join(parts)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as packed little-endian integers."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        out: list[bytes] = []
        group: list[list[bytes]] = []
        size = 0
        for t in texts:
            group.append(t.split())
            size += len(t)
            if size > 2_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, split: list[list[bytes]]) -> list[bytes]:
        cache = self.cache
        missing = set().union(*split).difference(cache)
        long = {c for c in missing if len(c) > CACHE_BYTES}
        self._fill(list(missing - long), cache)
        get = cache.__getitem__
        if long:
            extra: dict[bytes, bytes] = {}
            self._fill(list(long), extra)
            get = lambda c: extra[c] if c in extra else cache[c]
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str = "<u4", special_as_text: bool = False) -> ChunkEncoder:
    return ChunkEncoder(path, dtype, special_as_text)
