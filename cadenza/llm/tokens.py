"""Encoding by public tokenizers, with the ``tokenizers`` library.

The tokenizers used here never merge across the white space between words, so a text's ids are the ids of its
units, in order: a unit is a word, for byte-level vocabularies with the white space before it. Each worker process
keeps the ids of units that it has met (a bounded number of bytes); only new ones go to the library. A new unit of
plain Latin characters is split into the vocabulary's pieces, and the library's model merges those that are new;
any other new unit goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from array import array
from collections.abc import Callable

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The word vocabulary's pieces and normalizer (fixed values), and the characters for which Python's lower case is
#: the library's, composing changes nothing and all Unicode versions agree on what a letter is.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
NOT_SIMPLE = re.compile("[^\x00-\x1b\x20-\x7e\xa0-į‐-‧€]")
#: A word with the white space before it, or the white space at a text's end. Byte-level pre-tokenizers cut before
#: white space that follows a word, whatever stands before and after.
UNIT = re.compile(r"\s*\S+|\s+")
#: Single marks that end words: pieces of their own.
MARKS = (".", ",", ";", ":", "!", "?")
#: White space to Python but not to the library (fixed values): texts with these are encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Bytes that a generation of remembered units may take, and the longest unit that is remembered.
MOST_BYTES, LONGEST_UNIT = 100_000_000, 100
#: Bytes of an entry beside the characters of its key and the ids of its value, about.
ENTRY = 200
#: Whether this machine's own numbers are those that files hold.
NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered(dict):
    """What ``make`` yields for a key (bytes), remembered in two generations of at most ``most`` bytes each: when the
    younger one is full it becomes the older one, which is let go; what is met again is taken over."""

    def __init__(self, make: Callable[[str], bytes], most: int = MOST_BYTES):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = len(key)
        if size <= LONGEST_UNIT:
            if self.held > self.most:
                self.remember(key, value)
            else:
                self.held += ENTRY + size + len(value)
                self[key] = value
        return value

    def remember(self, key: str, value: bytes) -> None:
        if self.held > self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += ENTRY + len(key) + len(value)
        self[key] = value


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes() if NATIVE else struct.pack(f"<{len(ids)}I", *ids)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def known_pieces(tokenizer, byte_level: bool) -> re.Pattern | None:
    """The pattern by which the vocabulary splits lower-cased (word) or given (byte-level) text into pieces; none if
    the vocabulary isn't of a kind known here."""
    import json

    import regex

    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
        return None
    if byte_level:
        fits = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]
        return regex.compile(PATTERN) if fits else None
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = before.get("pretokenizers", [])
    fits = steps == NORMALIZERS and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": WORD_PATTERN}
    return regex.compile(WORD_PATTERN) if fits and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"] else None


class UnitEncoder:
    """Texts to ids (little-endian unsigned 32-bit, as bytes), exactly those that the library gives for whole texts
    with add_special_tokens=False.

    byte_level: the vocabulary keeps white space (a unit has that before its word); else white space is dropped.
    """

    def __init__(self, path: str, byte_level: bool):
        self.tokenizer, self.byte_level = load(path), byte_level
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = known_pieces(self.tokenizer, byte_level)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.tokenize = self.model.tokenize
        self.units = Remembered(self.encode_unit)  # pieces too: a piece is a unit of itself

    def encode_whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_unit(self, unit: str) -> bytes:
        if self.pattern is not None and unit.isascii():  # most units: letters alone, or a space and letters
            if unit.isalpha():
                plain = unit if self.byte_level else unit.lower()
                return self.units[plain] if plain != unit else as_bytes([t.id for t in self.tokenize(unit)])
            if self.byte_level and unit[0] == " " and unit[1:].isalpha():
                return as_bytes([t.id for t in self.tokenize(self.symbols[32] + unit[1:])])
        if self.pattern is None or not (unit.isascii() or NOT_SIMPLE.search(unit) is None):
            return self.encode_whole(unit)
        plain = unit if self.byte_level else unit.lower()
        letters = plain[1:] if self.byte_level and plain[0] == " " else plain
        if letters.isalpha():
            if plain != unit:
                return self.units[plain]
        elif letters[-1:] in MARKS and letters[:-1].isalpha():
            return self.units[plain[:-1]] + self.units[plain[-1]]
        else:
            pieces = self.pattern.findall(plain)
            if len(pieces) != 1 or pieces[0] != unit:
                return b"".join([self.units[p] for p in pieces])
        # a piece: its bytes as the vocabulary writes them go to the model
        if letters.isalpha() and unit.isascii():
            unit = unit if letters is plain else self.symbols[32] + letters
        else:
            unit = "".join([self.symbols[b] for b in unit.encode("utf-8", "surrogatepass")])
        return as_bytes([t.id for t in self.model.tokenize(unit)])

    def must_be_whole(self, text: str) -> bool:
        return ("<|" in text and any(s in text for s in self.specials)) or any(c in text for c in ODD_SPACE)

    def encode(self, text: str) -> bytes:
        if self.must_be_whole(text):
            return self.encode_whole(text)
        return b"".join(map(self.units.__getitem__, UNIT.findall(text) if self.byte_level else text.split()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [*map(self.encode, texts)]


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(path: str, byte_level: bool) -> UnitEncoder:
    """This process's encoder for a vocabulary file."""
    if (path, byte_level) not in _encoders:
        _encoders[path, byte_level] = UnitEncoder(path, byte_level)
    return _encoders[path, byte_level]
