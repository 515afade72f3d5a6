"""Token ids of whole texts by the tokenizers library, with a bounded cache of word encodings.

Both pre-tokenizers met here never join text across a single space between two non-space
characters, so a text is cut there, each distinct piece goes through the library's own model,
and the ids of a text are the joined ids of its pieces; texts of some megabytes are cut together by Arrow, and
each of their distinct pieces is looked up once. Texts that don't allow it, texts with the
name of a special token, and tokenizer files of any other build, go through the library's encode().
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of the two generations of a cache; bounds the memory of a worker.
CACHE_ENTRIES = 100_000

#: Bytes of text whose pieces are looked up together, and of the longest text that goes that way.
RUN_BYTES, LONGEST = 8 << 20, 64 << 20

#: Characters on which regex engines disagree whether they are white space.
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: Pieces with characters beyond U+024F go through the library: classes of later ones differ between Unicode versions.
_BEYOND = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: Those, and the characters below that have a small letter beyond U+024F.
_BEYOND_LOWER = re.compile("[\x1c-\x1f\x85\u0130\u023a\u023e\u0250-\U0010ffff]")
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: The published pre-tokenisation patterns of the two builds (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Marks that are a pre-token of their own after a word.
_STOPS = frozenset(",.;:!?")
#: Runs of these are one pre-token after a word.
_MARKS = string.punctuation.replace("'", "")


class _Odd(Exception):
    """The text can't be cut into pieces."""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
SPACE = _LETTERS[0x20]


class _Kept(dict):
    """A cache of two generations: what is in use moves to the young one, the old one is dropped as it fills."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.made(piece)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class _Pre(_Kept):
    """Ids of a pre-token as little-endian 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def made(self, piece: str) -> bytes:
        letters = piece.replace(" ", SPACE) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()


class _Words(_Kept):
    """Ids of a word of letters below U+0250 after a space."""

    def __init__(self, model, prefix: str, lower: bool):
        super().__init__()
        self.tokenize, self.prefix, self.lower = model.tokenize, prefix, lower

    def made(self, word: str) -> bytes:
        if self.lower:
            word = word.lower()
        return array("I", [t.id for t in self.tokenize(self.prefix + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)))]).tobytes()


class _Pieces(_Kept):
    """Ids of a piece between spaces."""

    def __init__(self, pre: _Pre, whole, find, prefix: str, strict: bool, normal=None):
        super().__init__()
        self.pre, self.whole, self.find, self.prefix, self.strict, self.normal = pre, whole, find, prefix, strict, normal

    def made(self, piece: str) -> bytes:
        if self.strict and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise _Odd
        if self.normal:
            text = self.normal(piece)
        else:
            text = self.prefix + piece
        if _BEYOND.search(text):
            if _ODD.search(piece):
                raise _Odd
            return self.whole(self.prefix + piece)
        if piece.isalpha():  # one pre-token
            return self.pre.made(text)
        if piece[-1:] in _STOPS and piece[:-1].isalpha():
            return self[piece[:-1]] + self.pre[piece[-1]]
        return b"".join([self.pre[x] for x in self.find(text)])


class Encoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids as little-endian uint32 bytes.

    Texts in which the name of a special token stands go through the library whole, which gives that token's id.
    Null is empty.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = [x.get("type") for x in pre.get("pretokenizers", [])]
        plain_model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        added = [x for x in spec.get("added_tokens", []) if x.get("normalized") or not x.get("content")]
        self.names = [x["content"] for x in spec.get("added_tokens", []) if x.get("content")]
        self.kind = ""
        model = _Pre(self.tokenizer.model)
        if plain_model and not added and pre.get("type") == "ByteLevel" and not normal and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.kind, find = "byte", regex.compile(BYTE_PATTERN).findall
            self.words, self.far = _Words(self.tokenizer.model, SPACE, False), _BEYOND.search
            self.head = _Pieces(model, self.whole, find, "", False)
            self.rest = _Pieces(model, self.whole, find, " ", True)
            self.loose = _Pieces(model, self.whole, find, " ", False)
        elif plain_model and not added and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN:
            self.kind, find = "word", regex.compile(WORD_PATTERN).findall
            self.words, self.far = _Words(self.tokenizer.model, "", True), _BEYOND_LOWER.search
            normalise = self.tokenizer.normalizer.normalize_str
            # characters below U+0250 are composed already
            self.rest = _Pieces(model, self.whole, find, "", False, lambda s: normalise(s) if _BEYOND.search(s) else s.lower())

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(name in text for name in self.names):
            return self.whole(text)
        try:
            if self.kind == "word":
                return b"".join(map(self.rest.__getitem__, text.split(" ")))
            if self.kind == "byte":
                pieces = text.split(" ")
                try:
                    if pieces[0] and not pieces[0][-1].isspace():
                        return self.head[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
                except _Odd:
                    pass
                pieces = _PLAIN_SPACE.split(text)
                return self.head[pieces[0]] + b"".join(map(self.loose.__getitem__, pieces[1:]))
        except _Odd:
            pass
        return self.whole(text)

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """ids() of each text; of texts that stand together each distinct piece is looked up once."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        runs = np.cumsum(sizes, dtype=np.int64) // RUN_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            if self.kind and a < b and sizes[a:b].max() <= LONGEST:
                yield from self._together(texts.slice(a, b - a))
            else:
                yield from (self.ids(x.as_py()) for x in texts.slice(a, b - a))

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        pieces = pc.split_pattern(texts, " ")
        begins, coded = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        firsts, ends = begins[:-1], begins[1:]
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = self._found(distinct)
        odd = np.array([x is None for x in found])[which]
        starts, heads = firsts, None
        if self.kind == "byte":  # no space before the first piece
            starts, heads = firsts + 1, [distinct[k] for k in which[firsts].tolist()]
            odd[firsts] = [not x or x[-1].isspace() or _ODD.search(x) is not None for x in heads]
        alone = np.logical_or.reduceat(odd, firsts)  # texts that go through ids()
        for name in self.names:
            alone |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        _, at, data = pa.array(found, pa.binary()).take(coded.indices).buffers()
        at, data = np.frombuffer(at, np.int32), memoryview(data or b"")
        for k, (a, b) in enumerate(zip(at[starts].tolist(), at[ends].tolist())):
            if alone[k]:
                yield self.ids(texts[k].as_py())
            else:
                ids = data[a:b].tobytes()
                yield self.head[heads[k]] + ids if heads else ids

    def _found(self, distinct: list[str]) -> list[bytes | None]:
        """Ids of pieces after a space; None for one that can't be cut."""
        words, pre, out = self.words, self.rest.pre, []
        for piece in distinct:
            word = piece if piece.isalpha() else piece.rstrip(_MARKS)
            ids = words.get(word)
            if ids is None:
                if not word.isalpha() or not word.isascii() and self.far(word):
                    try:
                        out.append(self.rest[piece])
                    except _Odd:
                        out.append(None)
                    continue
                ids = words[word]
            out.append(ids if len(word) == len(piece) else ids + pre[piece[len(word) :]])
        return out

    def whole(self, text: str) -> bytes:
        """Ids by the library's encode()."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_tokenizer(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
