"""Operator 8: byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the encoder stores the one token that ends the prefix's encoding: a
token of the vocabulary that is a suffix of the prefix and may follow the last token of the
shorter prefix. The encoding of any prefix is read by walking back. So bytes can be appended
exactly, and an edit recomputes only the prefixes near it.

Two tokens may be neighbours if no merge across their border comes before the merges that build
them; that is decided from the tokens along the border (their right and left parts).

Edge cases: null texts are empty (no ids, hash of the empty string); repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.arrow import per_text
from tidemark.llm.piece_cache import PieceCache
from tidemark.llm.words import Hasher, Texts, Words, split

SLICE = 2 << 20
NEVER = 1 << 62
MAX_PAIRS = 1 << 18  # remembered pairs of tokens (about 25 MB); it starts anew beyond, no result changes
# White space beyond the bytes that cut a text into segments.
WIDE_SPACE = regex.compile(r"[\x1c-\x1f\x85\p{Z}--\x20]", regex.V1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Prefix states, exact appends and edits for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self.left: dict[int, tuple] = {}  # token -> ((token at its left edge, when it is used up), ...)
        self.right: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        for rank in sorted(self.token):  # parts have lower ranks, so their borders are known
            token = self.token[rank]
            self.left[rank] = self.right[rank] = ((rank, NEVER),)
            parts = self.tokens(self.prefixes(token, below=rank), len(token)) if len(token) > 1 else []
            if len(parts) == 2:
                a, b = parts
                self.left[rank] += ((a, rank), *self.left[a][1:])
                self.right[rank] += ((b, rank), *self.right[b][1:])

    def crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b; ``NEVER`` if there is none."""
        first = NEVER
        for x, x_used in self.right[a]:
            head = self.token[x]
            for y, y_used in self.left[b]:
                rank = self.ranks.get(head + self.token[y], NEVER)
                # at equal ranks the merge further left comes first
                if rank < min(x_used, first) and rank <= y_used:
                    first = rank
        return first

    def follows(self, a: int, b: int, below: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b."""
        key = a << 32 | b
        first = self.pairs.get(key)
        if first is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            first = self.pairs[key] = self.crossing(a, b)
        return first >= below

    def prefixes(self, piece: bytes, last: list[int] | None = None, below: int = NEVER) -> list[int]:
        """Last token of every prefix; ``last`` holds those already known. ``below`` admits only
        tokens of lower rank (used to find the two parts of a token)."""
        last = list(last) if last else [-1]
        known, n = len(last), len(piece)
        last += [-1] * (n + 1 - known)
        pairs, follows = self.pairs, self.follows
        text = piece.decode("latin-1")
        # suffixes of every prefix that are tokens, longest first
        for at, (token, size) in self.suffixes.iter(text, max(0, known - self.longest)):
            end = at + 1
            if end < known or last[end] >= 0 or token >= below:
                continue
            start = end - size
            if start == 0:
                last[end] = token
                continue
            before = last[start]
            if before >= 0:
                first = pairs.get(before << 32 | token)
                if (follows(before, token, below) if first is None else first >= below):
                    last[end] = token
        return last

    def tokens(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            if last[end] < 0:
                raise ValueError("the vocabulary lacks single bytes of this piece")
            out.append(last[end])
            end -= len(self.token[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.tokens(self.prefixes(piece), len(piece))

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Prefix states of ``piece + more``; nothing before the end is computed again."""
        return piece + more, self.prefixes(piece + more, last)

    def edit(self, piece: bytes, last: list[int], lo: int, hi: int, new: bytes) -> tuple[bytes, list[int]]:
        """States after replacing piece[lo:hi]: kept before lo, and copied behind the edit from
        where a full token length of states agrees with the old ones."""
        changed = piece[:lo] + new + piece[hi:]
        shift, states = len(new) - (hi - lo), last[: lo + 1]
        same = 0
        while len(states) <= len(changed):
            end = len(states)
            states = self.prefixes(changed[:end], states)
            old = end - shift
            same = same + 1 if end > lo + len(new) and last[old] == states[end] else 0
            if same >= self.longest and end - same >= lo + len(new):
                return changed, states + last[old + 1 :]
        return changed, states


def segments(texts: Texts) -> Words:
    """Cut texts where a word is followed by white space. No match of the split pattern crosses
    such a place, and white space stays with the word behind it. A text that holds other white
    space than plain spaces and control characters stays whole."""
    words = split(texts)
    first, n = words.first, len(texts.bounds) - 1
    sizes = np.diff(texts.bounds)
    # every word's segment starts where the word before ended; trailing space is a segment
    start = np.empty_like(words.start)
    start[1:] = words.end[:-1]
    some = np.flatnonzero(np.diff(first))
    start[first[:-1][some]] = texts.bounds[:-1][some]
    tail_from = texts.bounds[:-1].copy()
    tail_from[some] = words.end[first[1:][some] - 1]
    wide = np.zeros(n, bool)
    odd = (texts.data >= 0xC2) & (texts.data <= 0xE3) | (texts.data >= 0x1C) & (texts.data <= 0x1F)
    suspects = np.unique(np.searchsorted(texts.bounds, np.flatnonzero(odd), side="right") - 1)
    for i in suspects.tolist():
        wide[i] = WIDE_SPACE.search(texts.text(i).decode("utf-8", "replace")) is not None
    tail = (tail_from < texts.bounds[1:]) & ~wide
    keep = ~wide[words.doc]
    whole = wide & (sizes > 0)
    starts = np.concatenate((start[keep], tail_from[tail], texts.bounds[:-1][whole]))
    ends = np.concatenate((words.end[keep], texts.bounds[1:][tail], texts.bounds[1:][whole]))
    docs = np.concatenate((words.doc[keep], np.flatnonzero(tail), np.flatnonzero(whole)))
    order = np.argsort(starts, kind="stable")
    starts, ends, docs = starts[order], ends[order], docs[order]
    return Words(starts, ends, docs, np.searchsorted(docs, np.arange(n + 1)))


def encoder(ranks_path: str, pattern: str):
    """Function from byte strings to ids: every match of the pattern is encoded by itself."""
    prefix = PrefixEncoder(load_ranks(ranks_path))
    find = regex.compile(pattern).findall

    def encode(chunks: list[bytes]) -> list[list[int]]:
        return [
            [i for piece in find(c.decode("utf-8", "replace")) for i in prefix.encode(piece.encode())]
            for c in chunks
        ]

    return encode, prefix


_LOADED: dict[tuple[str, str], tuple] = {}


def _loaded(ranks_path: str, pattern: str):
    """Encoder and cache of this Python worker; later tasks on it use the encoder again."""
    if (ranks_path, pattern) not in _LOADED:
        encode, prefix = encoder(ranks_path, pattern)
        tokens = [prefix.token.get(i, b"") for i in range(max(prefix.token) + 1)]
        _LOADED[ranks_path, pattern] = PieceCache(encode, np.uint32), prefix, tokens
    return _LOADED[ranks_path, pattern]


def _let_go() -> None:
    """Empty what this Python worker remembers of the texts of a task; it may wait for long, beside
    workers of other steps. The encoder stays: it takes longer to build than many tasks run."""
    for cache, prefix, _ in _LOADED.values():
        cache.clear()
        prefix.pairs.clear()


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] = ("doc_id",), with_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text: n_tokens, ids_sha256, decoded_sha256 (and token_ids)."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("token_ids", pa.list_(pa.int32()))] * with_ids

    def make():
        cache, _, tokens = _loaded(ranks_path, pattern)
        names = [str(i).encode() for i in range(len(tokens))]

        def work(texts: Texts) -> dict:
            parts = segments(texts)
            keys = Hasher(texts.data, False).of(parts.start, parts.end)
            flat, bounds = cache.ids(keys, texts.data, parts.start, parts.end)
            ends = bounds[parts.first]
            sha_ids, sha_text = [], []
            for i in range(len(ends) - 1):
                ids = flat[ends[i] : ends[i + 1]].tolist()
                sha_ids.append(hashlib.sha256(b" ".join([names[t] for t in ids])).hexdigest())
                sha_text.append(hashlib.sha256(b"".join([tokens[t] for t in ids])).hexdigest())
            out = {"n_tokens": np.diff(ends), "ids_sha256": sha_ids, "decoded_sha256": sha_text}
            if with_ids:
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            return out

        return work

    return per_text(docs, list(keep), "text", fields, make, SLICE, _let_go)
