"""Token ids of whole texts by the tokenizers library, with a cache of words in each worker.

A text is split at single spaces, where neither vocabulary's pre-tokenizer joins what stands on both
sides, so that the ids of the pieces are the ids of the text. Most pieces are words met before.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from plumbline.llm import caches

_CACHES: dict[str, Encoder] = {}
#: Words in each of a cache's two generations.
GENERATION = 300_000


class _Cache(dict):
    """Ids of words as bytes. When it is full, its words become the old generation, from which those met again return."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 40 and "\n" not in word or word == "\n":
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """encode(text) gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives."""

    _LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
    _TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)\Z")  # without the apostrophe, which may take letters along
    _TWO_SPACES = re.compile(r"\s\s")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Byte-level without a normalizer keeps white space; the other kind drops it and lower-cases.
        self.keeps_space = spec.get("normalizer") is None
        kinds = json.dumps(spec["pre_tokenizer"])
        self.known = '"ByteLevel"' in kinds and (self.keeps_space or '"Removed"' in kinds) and '"add_prefix_space": false' in kinds
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.byte_text = {b: b if b in set(visible) else next(hidden) for b in range(256)}
        self.space = chr(self.byte_text[32]) if self.keeps_space else ""
        self.first = _Cache(lambda w: self._word(w, ""))
        self.later = _Cache(lambda w: self._word(w, " ")) if self.keeps_space else self.first

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        if word.isascii() and word.isalpha():
            text = word if self.keeps_space else word.lower()
            return self._pack([t.id for t in self.model.tokenize(self.space + text if before else text)])
        if "\n" in word and not word.isspace():
            # A line's end alone between words: neither joins with what is beside it.
            head, *rest = word.split("\n")
            cache, line = (self.later if before else self.first), (self.first["\n"] if self.keeps_space else b"")
            return (cache[head] if head else self.first[before]) + b"".join(line + (self.first[r] if r else b"") for r in rest)
        if self._LETTERS.match(word):
            text = (word if self.keeps_space else word.lower()).encode().decode("latin-1").translate(self.byte_text)
            return self._pack([t.id for t in self.model.tokenize(self.space + text if before else text)])
        if len(word) > 1 and word[-1] in ".,!" and self._LETTERS.match(word[:-1]):
            cache = self.later if before else self.first
            return cache[word[:-1]] + self.first[word[-1]]
        if not self.keeps_space and (m := self._TAIL.match(word)):
            return self.first[m[1]] + self.first[m[2]]
        return self._pack(self.tokenizer.encode((before if self.keeps_space else "") + word, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        if not self.known or (self.keeps_space and self._TWO_SPACES.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        if not self.keeps_space:
            text = text.replace("\n", " ")  # which its normalizer does, so that words at a line's end are words met before
        head, *rest = text.split(" ")
        parts = [self.first[head] if head else b"", *map(self.later.__getitem__, rest)]
        return np.frombuffer(b"".join(parts), self.dtype)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it stays with the worker process."""
    caches.only("tokens")
    if path not in _CACHES:
        _CACHES[path] = Encoder(path)
    return _CACHES[path]
