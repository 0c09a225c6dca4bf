"""Operator 2: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one failure
bit per rule; a policy is a versioned mask of enforced rules, so applying another policy or
asking what a rule removes on its own never reads a text again.

Edge cases: a null or empty text has zero measurements and fails ``few_words``; a text without
words fails no ratio rule; repeated rows are judged alike; an empty table gives an empty ledger.
``upper_case`` judges texts with ``CASED_LEAST`` cased letters that are half of all letters or more,
``long_words`` those with at least half of their characters in scripts that put spaces between words.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import per_text, sums
from tidemark.llm.words import Hasher, Texts, mix, split, windows

REPEAT_WINDOW = 8
CASED_LEAST = 20
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_marks", "n_stutter", "n_cased", "n_unspaced",
]

# Symbol characters counted as n_symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
# Scripts written without spaces between words, as the first words of character names.
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "BOPOMOFO", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN", "IDEOGRAPHIC", "YI")
_CASED, _LETTERS, _UPPERS, _NO_SPACE = 1, 2, 4, 8
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True

# Bit number -> (name, fails if true). Bits are never given to another rule.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("upper_case", f"10 * n_upper > 4 * n_letters AND n_cased >= {CASED_LEAST} AND 2 * n_cased >= n_letters"),
    ("exclamations", "5 * n_marks > n_words"),
    ("long_words", "word_chars > 20 * n_words AND 2 * n_unspaced <= word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("stutter", "10 * n_stutter > 3 * n_words"),
]
BASE_RULES = ("few_words", "repeated_windows")
# Policy version -> enforced rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": tuple(name for name, _ in RULES),
}


def mask_of(names) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[n] for n in names)


@cache
def _kinds() -> np.ndarray:
    """Bits of every code point: cased, letter, upper case, of a script without spaces."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(128, kinds.size):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind[0] == "L":
            kinds[i] = _LETTERS | _CASED * (kind in ("Lu", "Ll", "Lt")) | _UPPERS * (kind == "Lu")
        if kind[0] in "LM" or 0x3000 <= i < 0x3040 or 0xFF00 <= i < 0xFF70:
            kinds[i] |= _NO_SPACE * (
                unicodedata.name(c, "").split(" ")[0] in _UNSPACED or 0x3000 < i < 0x3040 or 0xFF00 <= i < 0xFF21
            )
    return kinds


def _wide_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, bits of ``_kinds``) of every character beyond ASCII."""
    at = np.flatnonzero(data >= 0xC2)
    if not at.size:
        return at, np.empty(0, np.uint8)
    lead = data[at].astype(np.int64)
    more = lambda j: np.where(at + j < data.size, data[np.minimum(at + j, data.size - 1)], 0).astype(np.int64) & 63
    two = (lead & 31) << 6 | more(1)
    three = (lead & 15) << 12 | more(1) << 6 | more(2)
    four = (lead & 7) << 18 | more(1) << 12 | more(2) << 6 | more(3)
    code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return at, _kinds()[np.minimum(code, 0x10FFFF)]


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The measurements of every text of a slice."""
    data, bounds = texts
    words = split(texts)
    hasher = Hasher(data, False)
    n = len(bounds) - 1
    starts_char = (data & 0xC0) != 0x80
    inside = np.zeros(data.size + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).view(bool)

    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(data == 10)
    doc_of_break = np.searchsorted(bounds, breaks, side="right") - 1
    line_start = np.concatenate((bounds[:-1], breaks + 1))
    line_doc = np.concatenate((np.arange(n), doc_of_break))
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    last = np.append(line_doc[1:] != line_doc[:-1], True)[: line_doc.size]
    line_end = np.append(line_start[1:] - 1, 0)[: line_doc.size]
    line_end[last] = bounds[line_doc[last] + 1]
    has_word = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    salt = mix(line_doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(hasher.of(line_start, line_end) ^ salt, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup = n_lines - np.bincount(line_doc[first], minlength=n)

    # words covered by windows found twice or more in their text
    word_hash = hasher.of(words.start, words.end)
    window, at = windows(word_hash, words, REPEAT_WINDOW)
    salt = mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    _, inverse, counts = np.unique(window ^ salt, return_inverse=True, return_counts=True)
    found = at[counts[inverse] > 1]
    cover = np.zeros(words.start.size + 1, np.int64)
    np.add.at(cover, found, 1)
    np.subtract.at(cover, found + REPEAT_WINDOW, 1)
    repeated = np.cumsum(cover[:-1]) > 0

    # words equal to the word before
    same = np.append(False, (word_hash[1:] == word_hash[:-1]) & (words.doc[1:] == words.doc[:-1]))

    at, kind = _wide_kinds(data)
    doc = np.searchsorted(bounds, at, side="right") - 1
    wide = lambda bit: np.bincount(doc[kind & bit > 0], minlength=n)
    ascii_letters = sums(_LETTER[data], bounds)

    return {
        "n_words": np.diff(words.first),
        "word_chars": sums(starts_char & in_word, bounds),
        "n_symbols": sums(_SYMBOL[data], bounds),
        "n_dup_lines": n_dup,
        "n_repeat_words": sums(repeated, words.first),
        "n_lines": n_lines,
        "n_upper": sums(_UPPER[data], bounds) + wide(_UPPERS),
        "n_letters": ascii_letters + wide(_LETTERS),
        "n_marks": sums(_MARK[data], bounds),
        "n_stutter": sums(same[: word_hash.size], words.first),
        "n_cased": ascii_letters + wide(_CASED),
        "n_unspaced": wide(_NO_SPACE),
    }


def rule_ledger(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failed``, the bits of the rules that failed."""
    fields = [(m, pa.int64()) for m in MEASURES]
    measured = per_text(docs, list(keep), text, fields, lambda: measure)
    failed = F.lit(0)
    for i, (_, rule) in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0))
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a document breaks no rule that the policy enforces."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(mask_of(POLICIES[policy])) == 0


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per enforced rule: documents that fail it, that only it rejects, and that are kept with
    and without it. Documents are first counted per distinct mask (at most 2^rules rows)."""
    enforced = mask_of(POLICIES[policy])
    masks = ledger.groupBy(F.col("failed").bitwiseAND(enforced).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*[
            F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit"))
            for i, (name, _) in enumerate(RULES)
            if name in POLICIES[policy]
        ])
    ).alias("r")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    bit = F.col("r.bit")
    return masks.select("m", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("m").bitwiseAND(bit) != 0).alias("n_failed"),
        count(F.col("m") == bit).alias("n_only"),
        count(F.col("m") == 0).alias("n_kept"),
        count(F.col("m").bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def judge(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, the measurements, base_failed, failed bits and the policy's verdict ``kept``."""
    ledger = rule_ledger(docs)
    base = F.col("failed").bitwiseAND(mask_of(BASE_RULES)) != 0
    return ledger.select(
        "doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & passes(policy)).alias("kept"),
        "failed", *MEASURES[5:],
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents, with their own columns, that the policy keeps."""
    columns = docs.columns
    ledger = rule_ledger(docs, keep=columns)
    return ledger.filter(passes(policy)).select(*columns)
