"""Whole texts to token ids by a tokenizers file, through a bounded cache of pieces."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Unicode White_Space, as the tokenizers' patterns understand \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Latin letters (without one that becomes two characters in lower case), and ASCII marks without the apostrophe: between
#: one and the other the patterns of both files always cut, as they do at white space.
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: Each piece starts and ends where the file's pattern cuts; a run with the one space before it, white space before runs.
_BYTE_LEVEL_PIECES = re.compile(f" ?[{_LETTERS}]+(?=[{_MARKS}{_WS}]|\\Z)|[{_MARKS}]+(?=[{_WS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
#: The same for words whose white space is dropped; only spaces and line ends are taken for white space here.
_WORD_PIECES = re.compile(f"[{_LETTERS}]+(?=[{_MARKS} \\n]|\\Z)|[{_MARKS}]+(?=[ \\n]|\\Z)|[^ \\n]+").findall
_LETTERS_ALONE = re.compile(f" ?[{_LETTERS}]+").fullmatch


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet for str.translate: a byte that is a visible Latin-1 character is that character, the others follow from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()
#: Pieces held at most; the cache starts anew beyond it.
CACHE_PIECES = 1_000_000
#: Characters of a piece that is kept, at most.
LONG_PIECE = 64


def byte_level_pieces(text: str) -> list[str]:
    """The text cut at some of the places where the byte-level pattern cuts it."""
    return _BYTE_LEVEL_PIECES(text)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them: the file's added tokens, where a text holds them, are one id each.

    A text is cut at those, and else only where the file's own pattern always cuts. Each distinct piece goes through the
    library once and is kept. Files of other kinds than the two known ones are not cut at all.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kind = config.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in kind.get("pretokenizers", [])]
        if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not config.get("normalizer"):
            self.pieces = _BYTE_LEVEL_PIECES
            self.plain = lambda piece: piece
        elif steps == ["Split", "ByteLevel"] and kind["pretokenizers"][0].get("invert") and config["model"].get("end_of_word_suffix"):
            # Words that end with the file's own suffix, white space dropped: no match holds a space or a line end.
            self.pieces = _WORD_PIECES
            self.plain = str.lower
        else:
            self.pieces = lambda text: [text]
            self.plain = None
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        if sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian numbers")
        self.cache: dict[str, bytes] = {}
        added = config.get("added_tokens") or []
        # Tokens that take white space along, or that are looked for in normalised text or as words, are left to the library.
        self.single = len(self.pieces("a b")) == 1 or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.added = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in added}
        self.at_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of self.kind."""
        if self.single:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.at_added and self.at_added.search(text):
            out, at = [], 0
            for m in self.at_added.finditer(text):
                out += self._encode_plain(text[at : m.start()]), self.added[m[0]]
                at = m.end()
            return b"".join([*out, self._encode_plain(text[at:])])
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        pieces, cache = self.pieces(text), self.cache
        coded = list(map(cache.get, pieces))
        if None in coded:
            if len(cache) > CACHE_PIECES:
                cache.clear()
            new = self._learn({x for x, c in zip(pieces, coded, strict=True) if c is None})
            coded = [new[x] if c is None else c for x, c in zip(pieces, coded, strict=True)]
        return b"".join(coded)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces; those that are not long stay in the cache."""
        new, out, cache, tokenize, kind = [], {}, self.cache, self.tokenizer.model.tokenize, self.kind.char
        for x in pieces:
            # Letters alone are one match, and what the file's model gets is known: the word in the bytes' own alphabet,
            # in lower case if the file says so.
            if not _LETTERS_ALONE(x):
                new.append(x)
                continue
            word = self.plain(x)
            ids = cache.get(word)
            if ids is None:
                ids = array(kind, [t.id for t in tokenize(word.encode().decode("latin-1").translate(_ALPHABET))]).tobytes()
            out[x] = ids
        if new:
            many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for x, e in zip(new, many(new, add_special_tokens=False), strict=True):
                out[x] = array(kind, e.ids).tobytes()
        cache.update((x, ids) for x, ids in out.items() if len(x) <= LONG_PIECE)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's one encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
