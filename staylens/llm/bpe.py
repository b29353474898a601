"""Byte-level BPE of single words with the ``tokenizers`` library, one cache per worker.

A text is cut by the pre-tokenizer's pattern; each distinct word goes through the
library's model once per worker and comes from a bounded cache afterwards.  Texts
with code points on which pattern engines may disagree (newer Unicode versions),
and texts that hold an added token's string, are cut by the library itself.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

# Letters and numbers below this code point are the same in all Unicode versions in use.
_STABLE = 0x530
# Fixed value: the byte-level pre-tokenizer's pattern, {L} and {N} being letter and number ranges.
_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+")
# General punctuation, Japanese syllables, common ideographs, Hangul: beyond _STABLE, but old.
_OLD_RANGES = ((0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5),
               (0xAC00, 0xD7A3))


def _ranges(kind: str) -> str:
    out, start = [], None
    spans = [(0, _STABLE - 1), *_OLD_RANGES]
    for low, high in spans:
        for cp in range(low, high + 2):
            inside = cp <= high and unicodedata.category(chr(cp))[0] == kind
            if inside and start is None:
                start = cp
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
                start = None
    return "".join(out)


class WordBpe:
    """Ids of words and texts under one tokenizer file (byte-level BPE)."""

    def __init__(self, path: str, cache_words: int = 400_000):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a plain byte-level BPE tokenizer is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._model = self.tokenizer.model
        self._find = re.compile(_PATTERN.format(L=_ranges("L"), N=_ranges("N"))).findall
        old = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ((0, _STABLE - 1), *_OLD_RANGES))
        self._odd = re.compile(f"[^{old}]").search
        self._added = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split \
            if self.special else None
        shown = byte_letters()
        self._letters = {b: shown[b] for b in range(256)}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._packed: dict[str, bytes] = {}
        self._cache_words = cache_words

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words; they join up to the text."""
        if self.special and any(s in text for s in self.special):
            out: list[str] = []
            for i, part in enumerate(self._added(text)):
                out += [part] if i % 2 else self._split_plain(part)
            return out
        return self._split_plain(text)

    def _split_plain(self, text: str) -> list[str]:
        if self._odd(text):
            return [text[a:b] for _, (a, b) in
                    _merged(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))]
        return self._find(text)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of :meth:`split`, uncached."""
        if word in self.special:
            return (self.special[word],)
        letters = word.encode().decode("latin-1").translate(self._letters)
        return tuple([t.id for t in self._model.tokenize(letters)])

    def ids(self, text: str) -> list[int]:
        cache, out = self._cache, []
        for word in self.split(text):
            got = cache.get(word)
            if got is None:
                if len(cache) >= self._cache_words:
                    cache.clear()
                got = self.word(word)
                if len(word) <= 64:
                    cache[word] = got
            out += got
        return out

    def packed(self, text: str, width: int) -> bytes:
        """Ids of a text as little-endian integers of ``width`` bytes: words that the
        cache lacks are encoded first, then the text is one join over the cache."""
        words, cache = self.split(text), self._packed
        if len(cache) >= self._cache_words:
            cache.clear()
        new = set(words).difference(cache)
        for word in new:
            ids = self.word(word)
            cache[word] = struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids)
        out = b"".join(map(cache.__getitem__, words))
        if len(new) > self._cache_words:      # one text of very many words
            cache.clear()
        for word in new:
            if len(word) > 64:                # rare, and large together
                cache.pop(word, None)
        return out

    def pieces(self) -> list[bytes]:
        """Bytes of each id's piece; an added token stands for its own string."""
        back = {c: b for b, c in byte_letters().items()}
        out = [b""] * self.size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = piece.encode() if piece in self.special else bytes(back[c] for c in piece)
        return out


def _merged(parts):
    """Pre-tokenizer parts whose offsets name distinct character spans."""
    return [(p, span) for p, span in parts if span[1] > span[0]]


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    a printable Latin-1 character is itself, the others take 256, 257, ... in order."""
    plain = [b for b in range(256)
             if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    out.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return out


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One instance per worker process and tokenizer file."""
    sys.setswitchinterval(0.05)
    return WordBpe(path)
