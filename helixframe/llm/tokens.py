"""Exact tokenization of large corpora with a public tokenizer file.

A corpus repeats its words far more often than it invents new ones, and the tokenizers split a text
into independent words before they merge. ``WordTokenizer`` sends each new word through the library
(normalizer, pre-tokenizer, model) and remembers the ids; a text whose white space could bind its
words differently, or that holds the string of an added token, goes through the library whole. The
result equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` id by id.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_LOADED: dict[str, WordTokenizer] = {}
#: Characters of text whose words are looked up together.
BLOCK = 1 << 23
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")


# Fixed values of the byte-level format: its word pattern, and the printable letter that stands for each byte.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BYTE_LETTERS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def _pattern(path: str):
    """The word pattern of a byte-level pre-tokenizer; None for any other, which the library then runs."""
    with open(path) as f:
        parts = json.load(f)["pre_tokenizer"]
    parts = parts.get("pretokenizers", [parts])
    if len(parts) == 1 and parts[0]["type"] == "ByteLevel" and parts[0].get("use_regex", True) and not parts[0]["add_prefix_space"]:
        return regex.compile(BYTE_LEVEL_WORDS)
    if len(parts) == 2 and parts[0]["type"] == "Split" and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True) and parts[1]["type"] == "ByteLevel" and not (parts[1].get("use_regex", True) or parts[1]["add_prefix_space"]):
        return regex.compile(parts[0]["pattern"]["Regex"])
    return None


class _Words(dict):
    """Ids of words; ``find`` is asked for a word once."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class WordTokenizer:
    """``keeps_space``: byte-level pre-tokenizers put one leading space into the word that follows."""

    def __init__(self, path: str, remember: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.pattern = _pattern(path)
        # strings of added tokens are found before any word is cut; normalized ones in any case or form
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.loose = [self.normalizer.normalize_str(t.content) if self.normalizer else t.content for t in added if t.normalized]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.remember = remember
        self.keeps_space = len(self._library(" a")) > 0 and self._library(" a") != self._library("a")
        self.line_end = self._pack(self._library("\n"))
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str("AZ") == "az"
        self.young, self.old = _Words(self._new), {}  # where spaces count: words after a space, and after a line end with that line end
        self.joins = self.keeps_space and self.pattern is not None and self.normalizer is None
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _split(self, word: str) -> list[str]:
        """The pre-tokenizer's pieces of one word, in the alphabet of the model."""
        if self.pattern is None:
            return [piece for piece, _ in self.splitter.pre_tokenize_str(word)]
        return [p if p.isascii() and p.isprintable() and " " not in p else p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in self.pattern.findall(word)]

    def _ids(self, word: str, space: str = "") -> bytes:
        """Ids of a word with the space before it; the model sees each different piece once."""
        text = word if self.normalizer is None or self.lowers and word.isascii() and word.islower() else self.normalizer.normalize_str(word)
        pieces, ids = self.pieces, []
        for piece in self._split(space + text):
            part = pieces.get(piece)
            if part is None:
                part = pieces[piece] = array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
            ids.append(part)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def _new(self, word: str) -> bytes:
        """Ids of a word that ``young`` lacks."""
        known = self.old.get(word)
        if known is not None:
            return known
        if not self.keeps_space:
            return self._ids(word)
        return self.line_end + self._ids(word[1:]) if word[0] == "\n" else self._ids(word, " ")

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of the pattern, which ``pieces`` keeps."""
        letters = (chr(BYTE_LETTERS[32]) + piece[1:] if piece[0] == " " else piece) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = self.pieces[piece] = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def _learn(self, words: list[str]) -> None:
        """Cut many new words as one text: a word's first piece is the only one that starts with a space or line end."""
        known, done = self.pieces, []
        for piece in self.pattern.findall("".join([w if w[0] == "\n" else " " + w for w in words])):
            ids = known.get(piece) or self._piece(piece)
            if piece[0] in " \n":
                done.append(ids)
            else:
                done[-1] += ids
        self.young.update(zip(words, done, strict=True))

    def _forget(self) -> None:
        """Keep two generations of words: what was not met again in the last one goes."""
        if len(self.young) > self.remember:
            self.old = dict(self.young)
            self.young.clear()
        if len(self.pieces) > 2 * self.remember:
            self.pieces.clear()

    def _regular(self, text: str) -> bool:
        """Whether words are bound by single spaces and line ends only, so that each stands alone."""
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or (any(c in text for c in ODD_ASCII) if text.isascii() else ODD_SPACE.search(text)))

    def _plain(self, text: str) -> str | None:
        """``text`` as words of ``young`` with one space between them; None where the library must see it whole."""
        if any(t in text for t in self.added) or self.loose and any(t in (self.normalizer.normalize_str(text) if self.normalizer else text) for t in self.loose):
            return None
        if not self.keeps_space:
            return (text.lower() if self.lowers and text.isascii() else text).replace("\n", " ")
        return "\n" + text.replace("\n", " \n") if self._regular(text) else None

    def _block(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of a few texts: each different word is looked up once, its ids are copied to where it stands."""
        plain = [self._plain(text) if text else None for text in texts]
        split = pc.split_pattern(pa.array([p for p in plain if p is not None], pa.large_string()), " ")
        words = split.values.dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.joins:
            self._learn([w for w in different if w not in self.young and w not in self.old])
        known = list(map(self.young.__getitem__, different))
        self._forget()
        ends = np.cumsum([0, *map(len, known)], dtype=np.int64) // self.type.itemsize
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(known), self.type))).take(words.indices)
        ends = ids.offsets.to_numpy()[split.offsets.to_numpy()]
        found, at = ids.values.to_numpy(), 0
        skip = len(self.line_end) // self.type.itemsize if self.keeps_space else 0
        for text, p in zip(texts, plain, strict=True):
            if p is None:
                yield np.array(self._library(text) if text else [], self.type)
            else:
                yield found[ends[at] + skip : ends[at + 1]]
                at += 1

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text without special tokens, as ``self.type``; null reads as empty."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= BLOCK:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def encode(self, text: str | None) -> bytes:
        """The packed ids of one text."""
        return next(self._block([text])).tobytes()


def tokenizer_at(path: str) -> WordTokenizer:
    """One instance per worker process: what it remembers serves later tasks too."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
