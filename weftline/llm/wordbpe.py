"""Token ids of whole texts from a word-level BPE file, word by word with a bounded cache.

The tokenizers of this kind replace white space by one space, lower-case, and cut every text at white space before they merge, so the
ids of a text are the ids of its words put together. A word seen before costs one dictionary lookup.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: A comma or full stop after anything but an ASCII letter or digit.
_AFTER_SIGN = re.compile(rb"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\xff][.,][ \n]")
#: Words of Latin letters only: one piece for the merges, without composing marks.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\Z")
#: Letters followed by signs other than an apostrophe, which may begin a contraction: two pieces.
_TAILED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)\Z")
_CUTS = ((b", ", b" , "), (b". ", b" . "), (b",\n", b" ,\n"), (b".\n", b" .\n"))


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a printable character: its own where it is one, else the next free above 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _signs_joined(text: bytes) -> bool:
    """Whether a comma or full stop before white space may continue a run of signs; then words can't be cut in front of it."""
    return any(text[i := m.start()] < 0x80 or not i or text[i - 1] != 0xC3 or text[i] in (0x97, 0xB7) for m in _AFTER_SIGN.finditer(text))


class WordBpe(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; misses are encoded by the tokenizer, and beyond `limit` words the cache starts anew."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer, self._limit = Tokenizer.from_file(path), limit
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        if not all(x in steps for x in ('"Lowercase"', r'"\\s+"', '"Removed"')):
            raise ValueError(f"{path} does not cut texts at white space; its words can't be encoded alone")
        self._special = [t["content"].encode().lower() for t in spec["added_tokens"]]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self._limit:
            self.clear()
        piece = word.decode()
        if tailed := _TAILED.match(word):
            self[word] = found = self[tailed[1]] + self[tailed[2]]
            return found
        if _LATIN.match(piece):
            ids = [t.id for t in self._model.tokenize("".join(map(self._letters.__getitem__, piece.lower().encode())))]
        else:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text, in UTF-8, as bytes."""
        lower = text.lower()
        if any(s in lower for s in self._special):  # special tokens are told apart by case
            words = text.split()
        else:
            text = lower
            if not _signs_joined(text):
                for a, b in _CUTS:
                    text = text.replace(a, b)
            words = text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
