"""Pieces of words that a vocabulary of lower-cased words encodes by themselves.

``word_bpe`` vocabularies compose (NFC), lower-case, and cut a text into runs of letters, single
digits, runs of other signs and English endings (``'s``). Cutting words at those places already,
and lower-casing them, leaves far fewer distinct strings to encode than words have: ``Tide,``,
``(tide)`` and ``TIDE`` share one piece. Only places that are certain from the bytes beside them
are used, between characters of ASCII and the letters of U+00C0 to U+00FF:

* a letter before any other sign, and both sides of a digit, end a match of the split pattern;
* so does any sign before a letter, but an apostrophe may start an ending;
* none of these characters joins the one before it, so composing does not cross such a place. A
  letter is lower-cased only if the next character cannot join it (is below U+0300).

A word that holds an added token (in any case) stays as it is, as does every word of a vocabulary
with other rules.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tidemark.llm.piece_cache import ENCODE_AT_ONCE, PieceCache
from tidemark.llm.words import SPACE, Texts, gather, split

NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
JOINED = 256  # pieces that go to the library as one text

_OTHER, _LETTER, _ENDING, _DIGIT, _SIGN, _QUOTE, _SPACE = range(7)
_START, _END, _CUT = 1, 2, 4


def _tables() -> tuple[bytes, bytes]:
    """Class of a byte, and by the classes before and behind a place (3 bits each) whether a piece
    starts or ends there, and whether it cuts a word."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x21:0x7F] = _SIGN
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[[c for x in "strvmld" for c in (ord(x), ord(x.upper()))]] = _ENDING
    kind[0x30:0x3A] = _DIGIT
    kind[0x27] = _QUOTE
    kind[SPACE] = _SPACE
    cut = np.zeros((8, 8), bool)
    cut[_LETTER : _ENDING + 1, _DIGIT : _QUOTE + 1] = True
    cut[_DIGIT, _LETTER : _QUOTE + 1] = True
    cut[_SIGN : _QUOTE + 1, _DIGIT] = True
    cut[_SIGN, _LETTER : _ENDING + 1] = True
    cut[_QUOTE, _LETTER] = True
    marks = np.where(cut, _START | _END | _CUT, 0).astype(np.uint8)
    marks[_SPACE, :_SPACE] = _START
    marks[:_SPACE, _SPACE] = _END
    return kind.tobytes(), marks.tobytes().ljust(256, b"\0")


_CLASS, _MARKS = _tables()


class Pieces(NamedTuple):
    """Byte ranges of ``data`` in the order of the texts; those of text i start at ``first[i]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _mapped(values: np.ndarray, table: bytes) -> np.ndarray:
    """``table[values]``; bytes are translated faster than numpy takes them."""
    return np.frombuffer(bytearray(values).translate(table), np.uint8)


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte, and where the last bytes of the letters from U+00C0 are."""
    kind = _mapped(data, _CLASS)
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    behind = data[wide]
    wide = wide[(behind >= 0x80) & (behind != 0x97) & (behind != 0xB7)]
    kind[wide] = kind[wide - 1] = _LETTER
    return kind, wide


def _marks(kind: np.ndarray) -> np.ndarray:
    """What happens before a byte, for all but the first."""
    return _mapped(kind[:-1] << 3 | kind[1:], _MARKS)


def one_match(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the pieces, each with a space behind it, are one match of the split pattern."""
    kind, _ = _classes(data)
    more = (kind == _OTHER) | (kind == _QUOTE)
    more[1:] |= _marks(kind) >= _CUT
    return ~np.logical_or.reduceat(more, first)


def added_tokens(vocabulary: str) -> list[bytes] | None:
    """Lower-cased added tokens of a vocabulary file with the rules above, None for other rules."""
    with open(vocabulary, encoding="utf-8") as file:
        known = json.load(file)
    if any(known.get(k) for k in ("truncation", "padding", "post_processor")) or known["model"].get("dropout"):
        return None
    if known["normalizer"] != NORMALIZER or known["pre_tokenizer"] != PRE_TOKENIZER:
        return None
    tokens = []
    for token in known["added_tokens"]:
        content = token["content"].encode()
        plain = not any(token[k] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        spaced = np.frombuffer(content + b" ", np.uint8)
        if not plain or not content.isascii() or re.search(rb"\s", content) or one_match(spaced, np.array([0]))[0]:
            return None
        tokens.append(content.lower())
    return tokens


def pieces(texts: Texts, added: list[bytes] | None) -> Pieces:
    """Pieces of all words; whole words if ``added`` is None."""
    data, bounds = texts
    n = data.size
    if added is None or not n:
        words = split(texts)
        return Pieces(data, words.start, words.end, words.first)
    kind, wide = _classes(data)
    following = np.zeros_like(data)
    following[:-1] = data[1:]
    following[bounds[1:] - 1] = 0
    alone = following < 0xCC  # lead byte of U+0300
    folded = data + ((data - np.uint8(65) < 26) & alone).view(np.uint8) * np.uint8(32)
    upper = wide[(data[wide] < 0x9F) & alone[wide]]
    folded[upper] += 32

    lowered, held = data.tobytes().lower() if added else b"", []
    for token in added:
        at = lowered.find(token)
        while at >= 0:
            held.append(at)
            at = lowered.find(token, at + 1)
    if held:
        words = split(texts)
        for i in np.unique(np.searchsorted(words.start, held, side="right") - 1).tolist():
            span = slice(words.start[i], words.end[i])
            folded[span], kind[span] = data[span], _OTHER

    marks = _marks(kind)
    starts, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    starts[1:n], ends[1:n] = marks & _START, marks & _END
    some = np.flatnonzero(np.diff(bounds))
    first, last = bounds[some], bounds[some + 1]
    starts[first[kind[first] != _SPACE]] = True
    ends[last[kind[last - 1] != _SPACE]] = True
    start = np.flatnonzero(starts)
    return Pieces(folded, start, np.flatnonzero(ends), np.searchsorted(start, bounds))


class Encoder(PieceCache):
    """Ids of pieces by the tokenizers library. Pieces that are one match each go to it many at a
    time, with spaces between them, and are told apart by the number of the match of each id."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.added = Tokenizer.from_file(vocabulary), added_tokens(vocabulary)
        self.bits = (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length()
        super().__init__(self._singly, np.uint16 if self.bits <= 16 else np.uint32)

    def _singly(self, chunks: list[bytes]) -> list[list[int]]:
        texts = [c.decode("utf-8") for c in chunks]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As the class above, but only distinct keys are sorted: words repeat."""
        coded = pa.array(keys).dictionary_encode()
        found, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        example, rank = np.empty(found.size, np.int64), np.empty(found.size, np.int64)
        example[inverse] = np.arange(keys.size)
        order = np.argsort(found)
        rank[order] = np.arange(found.size)
        return found[order], example[order], rank[inverse]

    def _joined(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(flat ids, ids per piece) of pieces with a space behind each; None if they do not tell."""
        first = np.concatenate(([0], end[:-1]))[::JOINED].tolist()
        texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(first, [*first[1:], data.size])]
        flat, sizes = [], []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            flat.append(np.array(e.ids, self.dtype))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=1))
        sizes = np.concatenate(sizes)
        return (np.concatenate(flat), sizes) if sizes.size == end.size and sizes.all() else None

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.added is None:
            return super()._encoded(data, start, end)
        flat, sizes = [], []
        for lo in range(0, start.size, ENCODE_AT_ONCE):
            a, b = start[lo : lo + ENCODE_AT_ONCE], end[lo : lo + ENCODE_AT_ONCE]
            size = b - a + 1
            first = np.cumsum(size) - size
            spaced = data.take(np.arange(size.sum()) + np.repeat(a - first, size), mode="clip")
            spaced[first + size - 1] = 0x20
            plain = one_match(spaced, first)
            some = np.flatnonzero(plain)
            got = self._joined(spaced[np.repeat(plain, size)], np.cumsum(size[some])) if some.size else None
            rest = np.flatnonzero(~plain) if got else np.arange(a.size)
            parts = [got] if got else []
            if rest.size:
                parts.append(super()._encoded(data, a[rest], b[rest]))
            ids, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(np.concatenate((some, rest)) if got else rest)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            flat.append(gather(ids, bounds, order)[0])
            sizes.append(counts[order])
        return np.concatenate(flat), np.concatenate(sizes)
